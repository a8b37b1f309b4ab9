import random

import numpy as np
import pytest
from weirflow.llm import near_dup, shared

from .helpers import WORDS, corpus, frame, near, prose


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 80), (2, 5, 80), (3, 2, 60)])
def test_equals_all_pairs(spark, seed, k, percent):
    rows = corpus(seed)
    found = near_dup.near_duplicates(frame(spark, rows), k, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(found) == near(rows, k, percent)


def chain(rng, n, step):
    """Documents of which each differs from the next in some words: ends are far apart."""
    words, out = prose(rng, 120).split(), []
    for i in range(n):
        words = [*words]
        for _ in range(step):
            words[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("step", [1, 2, 3])
def test_chains_and_borderline_pairs(spark, step):
    rng = random.Random(step)
    texts = [t for _ in range(3) for t in chain(rng, 25, step)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(near_dup.near_duplicates(frame(spark, rows), 4, 80)) == near(rows, 4, 80)


def test_blocks_smaller_than_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_FEW", 3)
    monkeypatch.setattr(near_dup, "BLOCK_ALL", 5)
    rows = list(enumerate(chain(random.Random(9), 60, 3)))
    assert got(near_dup.near_duplicates(frame(spark, rows), 4, 80)) == near(rows, 4, 80)


def test_nulls_repeats_and_extra_columns(spark):
    text = " ".join(random.Random(4).choices(WORDS, k=40))
    df = spark.createDataFrame([(7, text, 1), (7, text, 2), (3, text.upper(), 3), (None, text, 4), (5, None, 5), (6, "", 6), (8, "", 7), (9, "a b", 8), (2, "A\tB", 9)], "doc_id long, text string, node int")
    rows = sorted(map(tuple, near_dup.near_duplicates(df, 4, 80).select("doc_id", "component_id", "kept").collect()), key=str)
    assert rows == sorted([(7, 3, False), (7, 3, False), (3, 3, True), (None, None, True), (5, 5, True), (6, 6, True), (8, 8, True), (9, 2, False), (2, 2, True)], key=str)


def test_empty_table(spark):
    assert near_dup.near_duplicates(frame(spark, []), 4, 80).count() == 0


def test_keep_first_keeps_columns(spark):
    rows = corpus(5)
    out = near_dup.keep_first(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in out.collect()} == {i for i, x in near(rows, 5, 80).items() if x[2]}


def test_sketch_fills_every_bin_and_estimates_similarity():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [own[:2000], own[1000:3000], own[:3], own[:0]]
    at = np.r_[0, np.cumsum([len(s) for s in sets])]
    s = near_dup.sketch(np.concatenate(sets), at, 1024)
    assert (s[:3] != near_dup._EMPTY).all() and (s[3] == near_dup._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.06


def test_components_of_a_path(spark):
    path = spark.createDataFrame([*((i, i + 1) for i in range(64)), (200, 100), (100, 100)], "u long, v long")
    found = {r["node"]: r["component"] for r in shared.components(path).collect()}
    assert found == {i: 0 for i in range(65)} | {100: 100, 200: 100}
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0
