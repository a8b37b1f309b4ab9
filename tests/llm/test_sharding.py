import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weirflow.llm import sharding
from weirflow.llm.queries import QUERIES

from .helpers import corpus, frame


def test_op10(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op10_sharding"](spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_seed_decides_and_places_are_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    place = lambda seed, parts: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(df.repartition(parts), 4, seed, 2048).collect()}
    one = place(1, 2)
    assert one == place(1, 5)
    assert one != place(2, 2)
    shard, slot = np.array([one[i] for i in range(3000)]).T
    assert abs(np.corrcoef(np.arange(3000), slot)[0, 1]) < 0.08 and abs(np.corrcoef(np.arange(3000), shard)[0, 1]) < 0.08


def test_places_equal_a_plain_version(spark):
    """Buckets by the seeded hash, the generator's permutation in each, places one after another."""
    rows = [(i, t) for i, t in corpus(2, 60)] + [(3, "again"), (3, None), (None, "x")]
    seed, size = 5, 3000
    total = sum(len((t or "").encode()) for _, t in rows)
    n = max(1, -(-total // size), -(-len(rows) // (size // 128)))
    buckets = {}
    for i, t in rows:
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = h if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), h)
        h = h if t is None else xxhash.xxh64_intdigest(t.encode(), h)
        buckets.setdefault((h - (h >> 63 << 64)) % n, []).append((i, t))
    want = []
    for b in sorted(buckets):
        own = sorted(buckets[b], key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode()))
        want += [own[j] for j in sharding.fisher_yates(len(own), seed, b)]
    out = sharding.shuffled_shards(frame(spark, rows), 4, seed, size).collect()
    found = sorted((r["slot"] * 4 + r["shard"], r["doc_id"], r["text"]) for r in out)
    assert [(i, t) for _, i, t in found] == want


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 3)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shuffled_shards(df, 7, bucket_bytes=4096).collect()
    assert sorted(r["slot"] * 7 + r["shard"] for r in rows) == list(range(2000))


def test_whole_rows_are_kept(spark):
    rows = [*corpus(1, 30), (None, "x"), (None, None), (3, "again"), (3, "again")]
    df = frame(spark, rows)
    out = sharding.shuffled_shards(df, 3, bucket_bytes=2000)
    assert out.columns == [*df.columns, "shard", "slot"]
    assert sorted(map(str, out.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect())[-1] == -(-len(rows) // 3)
    assert sharding.shuffled_shards(df.where("false"), 3).count() == 0


def test_fisher_yates_is_a_permutation():
    one = sharding.fisher_yates(1000, 5, 1)
    assert sorted(one.tolist()) == list(range(1000))
    assert (one == sharding.fisher_yates(1000, 5, 1)).all() and (one != sharding.fisher_yates(1000, 5, 2)).any()
