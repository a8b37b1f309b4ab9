"""Operators and stages on tables with columns of any name, and on rows that share a doc_id."""

import random

import pytest
from pyspark.sql import functions as F

from weirflow.llm import decontaminate, lang_id, license_scan, near_dup, packing, sharding, substring_dedup, suffix_dedup, token_counts

from .helpers import WORDS

NAMES = "late late_ copy dk dk_ dk2 node text_hash kept component n fp fps hot doc_id_ shard slot bucket bucket_ at words license score path fid in_headers length start item_id rejected lang_pred n_words ids h".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    base = " ".join(rng.choices(WORDS, k=120))
    rows = [(1, base), (2, base), (3, " ".join(rng.choices(WORDS, k=30)) + " " + base), (4, base.replace("the", "a", 1)), (4, " ".join(rng.choices(WORDS, k=70))), (2, "quite another text"), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in NAMES}).withColumn("n_chars", F.char_length("text"))


def test_filters_keep_every_column(spark, clashing):
    items = spark.createDataFrame([(1, "quite another text")], "item_id long, text string")
    own = lambda df: sorted((r["doc_id"], (r["text"] or "")[:5]) for r in df.collect())
    outs = [near_dup.keep_first(clashing), substring_dedup.cut_repeats(clashing), decontaminate.drop_contaminated(clashing, items)]
    for out in outs:
        assert out.columns == clashing.columns
        assert {r["late"] for r in out.collect()} == {"own late"}
    texts = [(r["doc_id"], (r["text"] or "")[:5]) for r in clashing.collect()]
    one, two, _, four, other, short, none = texts
    # Of the two rows with doc_id 2 and of the two with 4, only the copies go.
    assert own(outs[0]) == sorted([one, texts[2], other, short, none])
    assert short in own(outs[1]) and other in own(outs[1]) and own(outs[1]).count(two) == 0
    assert own(outs[2]) == sorted(t for t in texts if t != short)
    assert lang_id.keep_known(clashing.withColumn("lang", F.lit("en"))).count() == 6
    assert none and four


def test_reports_ignore_other_columns(spark, clashing):
    n = clashing.count()
    assert near_dup.near_duplicates(clashing).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {f(clashing).count() for f in (near_dup.near_duplicates, substring_dedup.remove_repeats, suffix_dedup.remove_repeats, token_counts.count_tokens)} == {n}
    assert packing.pack(clashing, with_ids=False).count() == n
    files = clashing.withColumns({"fid": F.col("doc_id"), "path": F.concat(F.lit("a/"), "doc_id")})
    assert license_scan.scan(files).count() == n
    out = sharding.shuffled_shards(clashing, 2)
    assert out.columns == [c for c in clashing.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert out.count() == n
