"""Operators on small hand-made tables, with their boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weirflow.functions import scalar
from weirflow.operators import aggregate as a
from weirflow.operators import joins as j
from weirflow.operators import ordering as o
from weirflow.operators import stateless as s
from weirflow.operators import windowing as w

SECOND = 1_000_000


def kv(spark, rows):
    """(k, v, ts) with ts in seconds since 1970."""
    df = spark.createDataFrame([(k, v, float(t)) for k, v, t in rows], "k long, v long, s double")
    return df.select("k", "v", F.timestamp_micros((F.col("s") * SECOND).cast("long")).alias("ts"))


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def some(spark):
    return kv(spark, [(1, 5, 0), (1, 7, 1), (1, 9, 2), (2, 4, 0), (2, 6, 3), (9, 1, 9)]).cache()


# Stateless -------------------------------------------------------------------------------------------------------------


def test_band_excludes_both_bounds(some):
    assert got(s.filter_band(some, "v", 5, 9), "v") == [(6,), (7,)]
    assert got(s.filter_band(some, "v", 100, 200), "v") == []


def test_band_of_keys(some):
    assert got(s.filter_band_keys(some, "k", "v", 1, 9), "v") == [(4,), (6,)]


def test_select_and_side(some):
    assert got(s.tag_side(s.select(some, F.col("v") >= 6), "v", 2), "v", "side") == [(6, 2), (7, 2), (9, 2)]


def test_tokens(spark):
    df = spark.createDataFrame([("don't 'stop' x2y",), ("",), (None,)], "text string")
    assert got(s.tokens(df), "word", "n") == [("DON'T", 1), ("STOP'", 1), ("X", 1), ("Y", 1)]


def test_lines(spark):
    df = spark.createDataFrame([("end of one\nwhole\nalso\nbegun",), ("alone",), (None,)], "text string")
    assert got(s.lines(df), "line") == [("alone",), ("also",), ("begun",), ("end of one",), ("whole",)]
    assert got(s.lines(df, slices=True), "line") == [("also",), ("whole",)]


def test_grep(spark):
    df = spark.createDataFrame([("a1b22", 1), ("none", 2)], "text string, i int")
    assert got(s.grep(df, "[0-9]+", keep=("i",)), "i", "match") == [(1, "1"), (1, "22")]
    assert got(s.grep_groups(df, "([a-z])([0-9])", 2), "match") == [("1",), ("2",), ("a",), ("a1",), ("b",), ("b2",)]


def test_sentiment(spark):
    df = spark.createDataFrame([(1, "good\tgood bad Good"), (2, "not good"), (3, "nothing"), (4, None)], "i int, text string")
    lexicon = spark.createDataFrame([("good", 3), ("bad", -1), ("not good", 50)], "word string, score int")
    want = [(1, 5), (2, 3), (3, 0), (4, 0)]
    assert got(s.sentiment(df, lexicon, "i"), "i", "score") == want
    assert got(s.sentiment_map(df, {"good": 3, "bad": -1, "not good": 50}), "i", "score") == want


def test_par_do_has_a_beginning_and_an_end(spark):
    import pandas as pd

    df = spark.createDataFrame([(1,), (2,), (3,)], "v long").coalesce(1)

    def process(held, frame):
        held.append(len(frame))
        return frame[frame.v > 1]

    out = s.par_do(df, process, "v long", start=list, finish=lambda held: pd.DataFrame({"v": [100 + sum(held)]}))
    assert got(out, "v") == [(2,), (3,), (103,)]


# Windows ---------------------------------------------------------------------------------------------------------------


def test_segment_rows(spark):
    df = spark.createDataFrame([(30, 10, 10), (10, 10, 15), (40, 10, 20), (50, 10, 21), (110, 10, 22), (1, 1, 9)], "k long, v long, t long").withColumn("ts", F.timestamp_seconds("t"))
    out = w.segment(df, "10 seconds", "1970-01-01 00:00:10").groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    assert got(out, F.unix_seconds("window.start").alias("a"), "n") == [(10, 2), (20, 3)]


def test_window_edge_belongs_to_the_later_window(spark):
    out = w.fixed(kv(spark, [(1, 1, 9.999999), (1, 1, 10)]), "10 seconds")
    assert got(out, F.unix_seconds("window.start").alias("a")) == [(0,), (10,)]


def test_sliding_forms_agree(some):
    one = w.sliding(some, SECOND, 3).groupBy("window", "k").agg(F.sum("v").alias("sum"), F.count(F.lit(1)).alias("n"))
    two = w.sliding_sums(some, SECOND, 3, ("k",))
    columns = (F.unix_seconds("window.end").alias("e"), "k", "sum", "n")
    assert got(one, *columns) == got(two, *columns)
    assert (3, 1, 21, 3) in got(two, *columns)


def test_sessions_exactly_a_duration_apart_stay_apart(spark):
    rows = kv(spark, [(1, 1, 0), (1, 1, 3), (1, 1, 5.999999), (1, 1, 9)])
    out = w.by_session(rows, 3 * SECOND).agg(F.count(F.lit(1)).alias("n")).withColumn("end", w.session_end())
    assert got(out, F.unix_micros("window.start").alias("a"), F.unix_micros("end").alias("e"), "n") == [(0, 3 * SECOND, 1), (3 * SECOND, 8_999_999, 2), (9 * SECOND, 12 * SECOND, 1)]


def test_ten_sessions(spark):
    times, t = [], 0
    for i in range(100):
        times.append((1, i, float(t)))
        t += 11 if i % 10 == 9 else 1
    out = w.by_session(kv(spark, times), 3 * SECOND).agg(F.count(F.lit(1)).alias("n"))
    assert [r["n"] for r in out.collect()] == [10] * 10


def test_global_window(some):
    assert w.global_window(some).groupBy("window").count().count() == 1


def test_grouping_needs_one_exchange(some):
    plan = w.group_sorted(w.fixed(some, "1 second"), "k").groupBy("window", "k").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# Aggregates ------------------------------------------------------------------------------------------------------------


def test_sums_and_means(some):
    assert got(a.sum_by(some, "k"), "k", "sum") == [(1, 21), (2, 10), (9, 1)]
    assert got(a.merge_sum_count(a.sum_count(some, "k", "v"), "k"), "k", "sum", "n") == [(1, 21, 3), (2, 10, 2), (9, 1, 1)]
    assert got(a.avg_by(some, "k"), "k", "avg") == [(1, 7.0), (2, 5.0), (9, 1.0)]
    assert got(a.avg_by(some), "n") == [(6,)]


def test_integer_mean_goes_toward_zero(spark):
    df = spark.createDataFrame([(1, -3), (1, -4), (2, 3), (2, 4)], "k long, v long")
    assert got(a.avg_by(df, "k", integer=True), "k", "avg") == [(1, -3), (2, 3)]


def test_median_of_even_and_odd(some):
    assert got(a.median_by(some, "k"), "k", "median") == [(1, 7.0), (2, 5.0), (9, 1.0)]


def test_ranks(spark):
    df = spark.createDataFrame([(1, v, v) for v in range(10)] + [(2, 5, 100), (3, 1, 200), (3, 1, 201)], "k long, v long, i long")
    assert got(a.percentile_by(df, 0.5, "k", tie="i"), "k", "v", "i") == [(1, 5, 5), (2, 5, 100), (3, 1, 201)]
    assert got(a.percentile_by(df, 1.0, "k", tie="i"), "k", "v") == [(1, 9), (2, 5), (3, 1)]
    assert got(a.percentile_value(df, 0.25, "k"), "k", "v") == [(1, 2), (2, 5), (3, 1)]
    assert got(a.top_share_by(df, 0.2, "k", tie="i"), "k", "v") == [(1, 8), (1, 9)]
    assert got(a.top_share_by(df, 0.25, "k", tie="i", largest=False), "k", "v") == [(1, 0), (1, 1)]
    assert got(a.top_share_values(df, 0.5, "k"), "k", "v") == [(1, v) for v in range(5, 10)] + [(3, 1)]


@pytest.mark.parametrize("share", [0.0, 0.001, 0.333, 0.5, 0.999, 1.0])
def test_hot_ranks_equal_sorting(spark, share):
    import random

    rng = random.Random(5)
    rows = [(k, rng.choice([7, rng.randrange(10_000)])) for k in (1, 1, 1, 2) for _ in range(2500)] + [(3, 4), (4, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    want_p, want_t = [], []
    for k in (1, 2, 3):
        v = sorted(x for y, x in rows if y == k)
        n, m = len(v), round(share * 1000) * len(v) // 1000
        want_p.append((k, v[min(m, n - 1)]))
        want_t += [(k, x) for x in v[n - m :]] if m else []
    assert got(a.percentile_by_hot(df, share, "k"), "k", "v") == want_p
    assert got(a.top_share_by_hot(df, share, "k"), "k", "v") == sorted(want_t)
    every = sorted(x for _, x in rows if x is not None)
    assert [r[0] for r in a.percentile_all(df, share).collect()] == [every[min(round(share * 1000) * len(every) // 1000, len(every) - 1)]]


@pytest.mark.parametrize(("share", "want"), [(0.0004, 4), (0.0125, 125), (0.29, 2900), (0.9996, 9996)])
def test_ranks_of_any_share(spark, share, want):
    """n * share is exact: no thousandths, no rounding of floats (0.29 * 10000 is 2899.9... as a float)."""
    df = spark.range(10_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 10_000).alias("v"))
    assert df.limit(1).select(scalar.rank_at(F.lit(10_000), share)).first()[0] == want
    for found in (a.percentile_by(df, share, "k"), a.percentile_value(df, share, "k"), a.percentile_all(df, share), a.percentile_by_hot(df, share, "k")):
        assert [r["v"] for r in found.collect()] == [want]
    for found in (a.top_share_by(df, share, "k"), a.top_share_values(df, share, "k"), a.top_share_by_hot(df, share, "k")):
        assert sorted(r["v"] for r in found.collect()) == list(range(10_000 - want, 10_000))
    assert sorted(r["v"] for r in a.top_share_by(df, share, "k", largest=False).collect()) == list(range(want))


def test_medians_and_ranks_with_null_groups_and_ties(spark):
    rows = [(None, 1, 0), (None, 4, 1), (1, 5, 2), (1, 5, 3), (1, 5, 4), (1, None, 5), (2, None, 6), (3, 7, 7)]
    df = spark.createDataFrame(rows, "k long, v long, i long")
    key = lambda r: (r[0] is not None, r)
    assert sorted(((r["k"], r["median"]) for r in a.median_by(df, "k").collect()), key=key) == [(None, 2.5), (1, 5.0), (3, 7.0)]
    assert a.median_by(df).first()["median"] == 5.0
    assert sorted((tuple(r) for r in a.percentile_by(df, 0.5, "k", tie="i").collect()), key=key) == [(None, 4, 1), (1, 5, 3), (3, 7, 7)]
    assert sorted((tuple(r) for r in a.top_share_by(df, 0.7, "k", tie="i").collect()), key=key) == [(None, 4, 1), (1, 5, 2), (1, 5, 3)]
    assert sorted((tuple(r) for r in a.top_share_by(df, 0.5, "k", tie="i", largest=False).collect()), key=key) == [(None, 1, 0), (1, 5, 2)]
    assert a.median_by(df.where("false"), "k").count() == a.top_share_by(df.where("false"), 0.5, "k").count() == 0


def test_no_rank_is_taken_over_a_whole_group(some):
    """What is ranked are the rows at the cut, and what is ordered the values of the band."""
    for df in (a.median_by(some, "k"), a.percentile_by(some, 0.5, "k"), a.top_share_by(some, 0.5, "k")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "cut_" in plan
        assert "collect_list" not in plan


def test_top_n_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, 5)], "k long, sum long").withColumn("window", F.lit(0))
    assert got(a.top_n(df, 3, "window"), "rank", "k") == [(1, 2), (2, 1), (3, 3)]


def test_rank_limit_comes_before_the_shuffle(some):
    plan = a.top_n(a.sum_by(w.fixed(some, "1 second"), "window", "k"), 2, "window")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sets_and_lists(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "k long, word string")
    assert a.merge_set(df, "k").first()["values"] == ["a", "b"]
    assert got(a.merge_bag(df, "k"), "k", "word", "n") == [(1, "a", 1), (1, "b", 2)]
    assert a.distinct_count(df, "k").first()["n"] == a.distinct_count(df, "k", approximate=True).first()["n"] == 2


@pytest.mark.parametrize("held", [1, 100])
def test_an_aggregate_of_ones_own(spark, held):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(60)], "k long, v long").repartition(4)
    out = a.user_aggregate(df, ("k",), list, lambda s, f: s + f.v.tolist(), lambda x, y: x + y, lambda s: (sum(s), len(s)), "total long, n long", held)
    want = {k: [i for i in range(60) if (i % 3 if i % 5 else None) == k] for k in (None, 0, 1, 2)}
    assert {r["k"]: (r["total"], r["n"]) for r in out.collect()} == {k: (sum(v), len(v)) for k, v in want.items()}
    assert a.user_aggregate(df.where("v < 0"), ("k",), list, lambda s, f: s, lambda x, y: x, lambda s: (0, 0), "total long, n long").count() == 0


def test_ones_own_aggregate_is_called_by_group_not_by_row(spark):
    """Rows of a group that lie far apart come to add together; a state for each task, both zeros one group."""
    calls, name = spark.sparkContext.accumulator(0), "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.range(0, 400, 1, 2).select((F.col("id") % 40 * F.when(F.col("id") < 200, -1.0).otherwise(1.0) * F.when(F.col("id") % 40 == 0, 1).otherwise(F.when(F.col("id") < 200, -1).otherwise(1))).alias("k"), F.col("id").alias("v"))

    def add(state, frame):
        calls.add(1)
        return state + len(frame)

    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        out = a.user_aggregate(df, ("k",), int, add, lambda x, y: x + y, lambda s: (s,), "n long").collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, out)) == [(float(k), 10) for k in range(40)]
    assert calls.value <= 80 + 40


@pytest.mark.parametrize("mode", sorted(a.MODES))
def test_modes_on_an_empty_table(some, mode):
    assert a.windowed(w.fixed(some.where("false"), "1 second"), mode, "k").count() == 0


# Joins -----------------------------------------------------------------------------------------------------------------


def test_join_by_key_adds_and_does_not_multiply(spark):
    left = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "k long, v long")
    right = spark.createDataFrame([(1, 20), (1, 21), (1, 22), (3, 23)], "k long, v long")
    assert got(j.join_by_key(left, right, "k"), "k", "v") == [(1, 10), (1, 11), (1, 20), (1, 21), (1, 22)]
    assert j.join_by_key(left.where("false"), right, "k").count() == 0


def test_threshold_itself_is_out(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "w long, v long")
    limit = spark.createDataFrame([(1, 5), (2, 0)], "w long, v long")
    assert got(j.join_by_filter(rows, limit, "v", "v", "w"), "w", "v") == [(1, 6), (2, 1)]
    assert got(j.join_by_filter_left(limit, rows, "v", "v", "w"), "w", "v") == [(1, 6), (2, 1)]
    assert got(j.join_by_filter(rows, limit.where("w = 1")), "v") == [(6,)]
    assert got(j.above(rows, 5), "v") == [(6,)]


def test_interval_bounds(spark):
    left = kv(spark, [(1, 1, 100), (2, 1, 100)])
    right = kv(spark, [(1, 2, 90), (1, 3, 109.999999), (1, 4, 110), (1, 5, 89.999999), (3, 6, 100)])
    out = j.interval_join(left, right, 10 * SECOND)
    assert got(out, "k", F.col("values")[1].alias("v")) == [(1, 2), (1, 3)]


def test_join_on_time(spark):
    one = spark.createDataFrame([(1, 5), (2, 6)], "t long, v long")
    assert [tuple(r) for r in j.join_on_time(one, one.where("t = 2")).collect()] == [(2, [6, 6])]


# Order -----------------------------------------------------------------------------------------------------------------


def test_sort_and_merge(spark):
    one = spark.createDataFrame([(30, 10), (10, 10), (40, 10)], "k long, v long")
    two = spark.createDataFrame([(100, 10), (5, 10), (50, 10), (10, 11)], "k long, v long")
    assert [r["k"] for r in o.sort(o.concatenate(one, two), "k", "v").collect()] == [5, 10, 10, 30, 40, 50, 100]
    assert [tuple(r) for r in o.merge(one, two, "k").collect()][1:3] == [(10, 11), (10, 10)]


def test_runs(spark):
    out = o.sorted_runs(spark.range(0, 100, 1, 3).select((F.col("id") * 37 % 100).alias("k")), "k")
    runs = out.withColumn("p", F.spark_partition_id()).collect()
    assert len({r["p"] for r in runs}) == 3
    assert all(x["k"] < y["k"] for x, y in zip(runs, runs[1:], strict=False) if x["p"] == y["p"])
    parts = o.partition_by_key(spark.range(100).select((F.col("id") % 7).alias("k")), "k").withColumn("p", F.spark_partition_id())
    assert parts.distinct().count() == 7
    assert len(o.sample_rows(out, 5)) == 5


# Scalars ---------------------------------------------------------------------------------------------------------------


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.pack_ip_pair(F.lit("1.2.3.4-255.0.0.1")).alias("ip"),
        scalar.plug_id(F.lit(3), F.lit(7)).alias("plug"),
        scalar.milli(F.lit(1.2345)).alias("milli"),
        scalar.truncated_mean(F.lit(-7), F.lit(2)).alias("mean"),
        scalar.json_text(F.lit('{"text": "x"}')).alias("text"),
        scalar.json_text(F.lit("{broken")).alias("broken"),
    ).first()
    assert row.asDict() == {"ip": 0x01020304 << 32 | 0xFF000001, "plug": 3 << 16 | 3 << 8 | 7, "milli": 1235, "mean": -3, "text": "x", "broken": None}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "Asia/Kolkata"])
def test_plain_times_are_free_of_zones(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(0,), (1711852200000000,), (1730000000123456,)], "m long").withColumn("t", scalar.plain_time(F.col("m")))
        rows = df.withColumn("back", scalar.micros_of(F.col("t"))).collect()
        assert [r["back"] for r in rows] == [r["m"] for r in rows]
        assert rows[1]["t"] == dt.datetime(2024, 3, 31, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
