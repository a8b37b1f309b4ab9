import random
from collections import Counter

import pytest

from weirflow.llm import decontaminate as d
from weirflow.llm.queries import QUERIES
from weirflow.llm.shared import shared_path

from .helpers import ALNUM, contamination, corpus, frame, lower, prose


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([4, 9, 10, 11, 40]))) for i in range(25)] + [(100, None), (101, "..."), (102, "one"), (103, "The ONE two-three"), (104, prose(rng, 1) * 3)]
    rows = dict(corpus(4, 50))
    for i in range(0, 50, 3):
        words = items[i % 25][1].split()
        part = words[rng.randrange(3) : len(words) - rng.randrange(3)]
        rows[i] = f"{rows[i] or ''} {', '.join(part).upper()}! {rows[i] or ''}"
    rows[900] = " ".join(items[4][1].split()[:9]) + " x " + items[4][1]
    rows[901] = " ".join(reversed(items[4][1].split()[:10]))
    return list(rows.items()), items


def plain_near(rows, items, slop=d.SLOP):
    """{doc_id: number of items with a window all of whose words are about a place of its rarest one}."""
    words = {i: ALNUM.findall(lower(t)) for i, t in rows}
    counts = Counter(w for ws in words.values() for w in ws)
    out = dict.fromkeys(words, 0)
    for _, text in items:
        own = ALNUM.findall(lower(text))
        windows = {tuple(own[s : s + d.WINDOW]) for s in range(max(1, len(own) - d.WINDOW + 1)) if own}
        for i, ws in words.items():
            hit = False
            for window in windows:
                rare, reach = min(window, key=lambda w: (counts[w], w)), len(window) - 1 + slop
                hit |= any(w == rare and set(window) <= set(ws[max(0, p - reach) : p + reach + 1]) for p, w in enumerate(ws))
            out[i] += hit
    return out


@pytest.mark.parametrize("limit", [d.BROADCAST_BYTES, 0])
def test_equals_brute_force(spark, planted, limit):
    """With and without broadcasts."""
    rows, items = planted
    out = d.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    found = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    want, close = contamination(rows, items), plain_near(rows, items)
    assert found == {i: (*x, close[i]) for i, x in want.items()}
    assert sum(x[4] for x in want.values()) > 10
    assert sum(close[i] > x[2] for i, x in want.items()) > 0


def test_dropping_keeps_clean_rows_and_columns(spark, planted):
    rows, items = planted
    out = d.drop_contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in out.collect()} == {i for i, x in contamination(rows, items).items() if not x[4]}


def test_matches(spark):
    docs = frame(spark, [(1, "zero a b c d e f g h i j k nine"), (2, "j i h g f e d c b a"), (3, "a b c")])
    items = spark.createDataFrame([(5, "A b, c d e f g h i j"), (6, "A b, c d e f g h i j k")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["start"], r["n"]) for r in d.phrase_matches(docs, items).collect())
    assert found == [(1, 5, 1, 10), (1, 6, 1, 10), (1, 6, 2, 10)]
    near = {(r["doc_id"], r["item_id"]) for r in d.proximity_matches(docs, items, slop=0).collect()}
    assert near == {(1, 5), (1, 6), (2, 5), (2, 6)}


def test_an_index_is_kept_and_extended(spark, planted):
    """Searches for two benchmarks by one index equal searches by their own; the second adds what the first lacked."""
    rows, items = planted
    docs, path = frame(spark, rows), shared_path(spark, "index-test")
    counted = []
    for part in (items[:10], items[5:]):
        bench = spark.createDataFrame(part, "item_id long, text string")
        by_path, own = (sorted(map(str, d.phrase_matches(docs, bench, path=p).collect())) for p in (path, None))
        assert by_path == own
        near_by_path, near_own = (sorted(map(str, d.proximity_matches(docs, bench, path=p).collect())) for p in (path, None))
        assert near_by_path == near_own
        index = spark.read.parquet(f"{path}/postings")
        counted.append(index.count())
        assert index.distinct().count() == counted[-1]
        assert spark.read.parquet(f"{path}/counts").groupBy("term").count().where("count > 1").count() == 0
    assert counted[0] < counted[1]


def test_nulls_repeats_and_empty_tables(spark):
    items = spark.createDataFrame([(None, "w1 w2"), (3, "w2 w3")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "w1 w2 w3", 0), (1, "w1 w2 w3", 0), (None, "w2 w3", 1), (2, None, 2)], "doc_id long, text string, dk int")
    out = sorted(map(str, (tuple(r)[:4] for r in d.contamination(docs, items).collect())))
    assert out == sorted(map(str, [(1, 3, 3, 1), (1, 3, 3, 1), (None, 2, 2, 1), (2, 0, 0, 0)]))
    assert d.contamination(docs.where("false"), items).count() == 0
    assert {r["n_hit"] for r in d.contamination(docs, items.where("false")).collect()} == {0}
    assert d.drop_contaminated(docs, items.where("false")).count() == 4


def test_no_python_on_the_main_path(spark, data):
    plan = QUERIES["op3_decontaminate"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
