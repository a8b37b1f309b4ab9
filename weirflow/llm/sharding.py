"""Two-pass external shuffle: records are scattered into memory-sized buckets by a seeded hash, then every bucket is
shuffled by Fisher-Yates and written.

The order of buckets, then of places inside them, is a uniform permutation of the corpus that the seed alone decides;
place p of it belongs to shard p modulo the number of shards. So the shards' row counts are at most one apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_path, spare

SHARDS, SEED = 16, 20240917
#: Text of a bucket; a bucket is shuffled in one task's memory.
BUCKET_BYTES = 8 << 20
PART = 4096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places: numpy's generator swaps each place with a random one not after it."""
    rng = np.random.Generator(np.random.Philox(key=np.array([seed, bucket], np.uint64)))
    order = np.arange(n)
    rng.shuffle(order)
    return order


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard and slot, written as Parquet under path (the shared folder, if none is given) and read again.

    slot counts from 0 in each shard without a gap; shards differ by a row at most. Every row is written once: rows
    with null ids or texts and repeated rows too. A row's bucket follows from seed, doc_id and text, so rows that
    share an id are spread; only rows that are the same meet, in a bucket of their own size. An empty table gives an empty one. Columns of docs that are named shard or slot give way to the new ones.
    """
    docs = docs.drop("shard", "slot")
    spark, names = docs.sparkSession, docs.columns
    own = spare(docs, "bucket")
    size, n = docs.agg(F.sum(F.octet_length(F.col(text_col))), F.count(F.lit(1))).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes), -(-n // (bucket_bytes // 128)))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))
    rows = docs.withColumn(own, F.pmod(key, F.lit(buckets)))

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        bucket = table.column(own)[0].as_py()
        plain = pa.table([table.column(id_col), table.column(text_col), pa.array(np.arange(table.num_rows))], names=["id", "text", "at"])
        order = plain.sort_by([("id", "ascending"), ("text", "ascending")]).column("at").to_numpy()
        place = start.column("first_")[0].as_py() + np.arange(table.num_rows)
        out = table.take(pa.array(order[fisher_yates(table.num_rows, seed, bucket)])).select(names)
        return out.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", shard int, slot long"
    target = path or shared_path(spark, "shards")
    rows.groupBy(own).cogroup(_first_places(rows.select(F.col(own).alias("bucket_"))).groupBy("of_")).applyInArrow(run, schema).write.parquet(target)
    return spark.read.parquet(target)


def _first_places(rows: DataFrame) -> DataFrame:
    """(of_, first_): how many rows are in the buckets before each. Sums run inside parts of PART buckets; only the
    parts' totals come to the driver, one number for PART * BUCKET_BYTES of text."""
    counts = rows.groupBy("bucket_").agg(F.count(F.lit(1)).alias("count_")).withColumn("part_", F.floor(F.col("bucket_") / PART))
    totals, before, at = counts.groupBy("part_").agg(F.sum("count_").alias("n")).collect(), [], 0
    for part, n in sorted(map(tuple, totals)):
        before.append((part, at))
        at += n
    inside = F.sum("count_").over(Window.partitionBy("part_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.sparkSession.createDataFrame(before, "part_ long, before_ long")
    return counts.withColumn("in_", F.coalesce(inside, F.lit(0))).join(F.broadcast(parts), "part_").select(F.col("bucket_").alias("of_"), (F.col("before_") + F.col("in_")).alias("first_"))


def shard_digests(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of shuffled_shards; size is the text's bytes plus one."""
    out = shuffled_shards(docs.select("doc_id", "text"), shards, seed)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
