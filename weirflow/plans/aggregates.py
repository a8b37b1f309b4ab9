"""Queries of aggregation: per key, over all rows, and the windowed modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregate as a
from ..operators import ordering, stateless
from ..operators import windowing as w
from .registry import EVENTS, ITEMS, events, flat, items, query, table

_SUM, _N = "CAST(sum(v) AS BIGINT) AS sum", "CAST(count(*) AS BIGINT) AS n"


# Per key and over all --------------------------------------------------------------------------------------------------


@query(f"SELECT k, {_SUM} FROM {ITEMS} GROUP BY k")
def sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.sum_by(items(spark, sf_dir), "k")


@query(f"SELECT k, k2, {_SUM}, {_N} FROM {ITEMS} GROUP BY k, k2")
def sum_count_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.sum_count(items(spark, sf_dir), "k", "k2")


@query(f"SELECT k, {_SUM}, {_N} FROM {ITEMS} GROUP BY k")
def sum_count_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.merge_sum_count(a.sum_count(items(spark, sf_dir), "k", "k2"), "k")


@query(f"SELECT k, avg(v) AS avg, {_N} FROM {ITEMS} GROUP BY k")
def avg_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.avg_by(items(spark, sf_dir), "k")


@query(f"SELECT k, CAST(trunc(sum(v - 30) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS avg, {_N} FROM {ITEMS} GROUP BY k")
def avg_by_key_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.avg_by(items(spark, sf_dir).withColumn("v", F.col("v") - 30), "k", integer=True)


@query(f"SELECT DISTINCT k, k2 FROM {ITEMS}")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.unique(items(spark, sf_dir), "k", "k2")


@query(f"SELECT {_SUM} FROM {ITEMS}")
def sum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.sum_by(items(spark, sf_dir))


@query(f"SELECT {_SUM}, {_N} FROM {ITEMS}")
def sum_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.sum_count(items(spark, sf_dir))


@query(f"SELECT {_SUM}, {_N} FROM {ITEMS}")
def merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.merge_sum_count(a.sum_count(items(spark, sf_dir), "k"))


@query(f"SELECT avg(v) AS avg, {_N} FROM {ITEMS}")
def avg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.avg_by(items(spark, sf_dir))


@query(f"SELECT CAST(trunc(sum(v - 30) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS avg, {_N} FROM {ITEMS}")
def avg_all_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.avg_by(items(spark, sf_dir).withColumn("v", F.col("v") - 30), integer=True)


@query(f"SELECT k, CAST(median(v) AS DOUBLE) AS median FROM {ITEMS} GROUP BY k")
def median_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.median_by(items(spark, sf_dir), "k")


@query(f"SELECT CAST(median(v) AS DOUBLE) AS median FROM {ITEMS}")
def median_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.median_by(items(spark, sf_dir))


_RANKED = f"SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY v {{0}}, event_id) AS r FROM {EVENTS}"


@query(f"SELECT event_id, k, v FROM ({_RANKED.format('')}) WHERE r = least(n * 900 // 1000 + 1, n)")
def percentile_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.percentile_by(events(spark, sf_dir), 0.9, "k", tie="event_id").select("event_id", "k", "v")


@query(f"SELECT k, v FROM (SELECT k, v, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY v) AS r FROM {ITEMS}) WHERE r = least(n * 250 // 1000 + 1, n)")
def percentile_by_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.percentile_value(items(spark, sf_dir), 0.25, "k")


_HOT = "(SELECT l_returnflag AS k, CAST(floor(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)"


def _few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_returnflag").alias("k"), F.floor(F.col("l_extendedprice") * 100).cast("long").alias("v"))


@query(f"SELECT k, v FROM (SELECT k, v, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY v) AS r FROM {_HOT}) WHERE r = least(n * 900 // 1000 + 1, n)")
def percentile_by_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys hold all rows: only a narrow band of each is ranked."""
    return a.percentile_by_hot(_few_keys(spark, sf_dir), 0.9, "k")


@query(f"""SELECT k, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS sum, min(v) AS least FROM (
SELECT k, v, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS r FROM {_HOT}) WHERE r <= n * 100 // 1000 GROUP BY k""")
def top_share_by_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = a.top_share_by_hot(_few_keys(spark, sf_dir), 0.1, "k")
    return top.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"), F.min("v").alias("least"))


_FINE = f"""SELECT share, k, v FROM (SELECT share, part, k, v, count(*) OVER w AS n, row_number() OVER (w ORDER BY v) AS r
FROM {_HOT}, (VALUES ('0.0004', 4), ('0.0125', 125), ('0.9996', 9996)) AS s(share, part) WINDOW w AS (PARTITION BY share, k)) WHERE r = least(n * part // 10000 + 1, n)"""


@query(_FINE)
def percentile_at_fine_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that are no whole thousandths."""
    rows = _few_keys(spark, sf_dir)
    return ordering.concatenate(*(a.percentile_by_hot(rows, share, "k").select(F.lit(str(share)).alias("share"), "k", "v") for share in (0.0004, 0.0125, 0.9996)))


@query(f"SELECT event_id, k, v FROM (SELECT event_id, k, v, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY v DESC, event_id) AS r FROM {EVENTS}) WHERE r <= n * 125 // 10000")
def top_fine_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.top_share_by(events(spark, sf_dir), 0.0125, "k", tie="event_id").select("event_id", "k", "v")


@query(f"SELECT v FROM (SELECT v, count(*) OVER () AS n, row_number() OVER (ORDER BY v) AS r FROM {EVENTS}) WHERE r = least(n * 900 // 1000 + 1, n)")
def percentile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.percentile_all(events(spark, sf_dir), 0.9)


@query(f"SELECT event_id, k, v FROM ({_RANKED.format('DESC')}) WHERE r <= n * 100 // 1000")
def top_share_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.top_share_by(events(spark, sf_dir), 0.1, "k", tie="event_id").select("event_id", "k", "v")


@query(f"SELECT event_id, k, v FROM ({_RANKED.format('')}) WHERE r <= n * 100 // 1000")
def bottom_share_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.top_share_by(events(spark, sf_dir), 0.1, "k", tie="event_id", largest=False).select("event_id", "k", "v")


@query(f"SELECT k, {_SUM} FROM {ITEMS} GROUP BY k")
def sum_of_key_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregation's exchange makes the key-aligned partitions, of partial sums."""
    return a.sum_by(items(spark, sf_dir), "k")


@query(f"SELECT k, v, ts FROM {ITEMS}")
def key_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.partition_by_key(items(spark, sf_dir), "k").select("k", "v", "ts")


# Windowed modes --------------------------------------------------------------------------------------------------------

_W = f"(SELECT *, time_bucket(INTERVAL '1 day', ts) AS w_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS w_end FROM {EVENTS})"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.fixed(events(spark, sf_dir), "1 day")


@query(f"SELECT w_start, w_end, k, {_SUM} FROM {_W} GROUP BY ALL")
def windowed_sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.windowed(_daily(spark, sf_dir), "SUM_BYKEY", "k"))


@query(f"SELECT w_start, w_end, {_SUM} FROM {_W} GROUP BY ALL")
def windowed_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.windowed(_daily(spark, sf_dir), "SUM_ALL"))


@query(f"SELECT w_start, w_end, avg(v) AS avg, {_N} FROM {_W} GROUP BY ALL")
def windowed_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.windowed(_daily(spark, sf_dir), "AVG_ALL"))


@query(f"SELECT w_start, w_end, k, avg(v) AS avg, {_N} FROM {_W} GROUP BY ALL")
def windowed_avg_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.windowed(_daily(spark, sf_dir), "AVG_BYKEY", "k"))


@query(f"SELECT w_start, w_end, k, CAST(median(v) AS DOUBLE) AS median FROM {_W} GROUP BY ALL")
def windowed_median_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.windowed(_daily(spark, sf_dir), "MEDV_BYKEY", "k"))


_WR = f"SELECT *, count(*) OVER (PARTITION BY w_start, k) AS n, row_number() OVER (PARTITION BY w_start, k ORDER BY v {{0}}) AS r FROM {_W}"


@query(f"SELECT w_start, w_end, k, v FROM ({_WR.format('DESC')}) WHERE r <= n * 500 // 1000")
def windowed_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.windowed(_daily(spark, sf_dir), "TOPV_BYKEY", "k", share=0.5).select("window", "k", "v"))


@query(f"SELECT w_start, w_end, k, v FROM ({_WR.format('DESC')}) WHERE r <= n * 500 // 1000")
def windowed_top_share_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that streams take."""
    return flat(a.top_share_values(_daily(spark, sf_dir), 0.5, "window", "k"))


@query(f"SELECT w_start, w_end, k, v FROM ({_WR.format('')}) WHERE r = least(n * 500 // 1000 + 1, n)")
def windowed_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.windowed(_daily(spark, sf_dir), "PERCENTILE_BYKEY", "k", share=0.5).select("window", "k", "v"))


@query(f"SELECT w_start, w_end, k, v FROM ({_WR.format('')}) WHERE r = least(n * 500 // 1000 + 1, n)")
def windowed_percentile_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.percentile_value(_daily(spark, sf_dir), 0.5, "window", "k"))


@query(f"SELECT DISTINCT w_start, w_end, k FROM {_W}")
def windowed_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.windowed(_daily(spark, sf_dir), "UNIQUE_BYKEY", "k"))


@query(f"SELECT w_start, w_end, k, {_SUM} FROM {_W} GROUP BY ALL ORDER BY w_start, sum, k")
def windowed_top_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.windowed(_daily(spark, sf_dir), "TOPCOUNT_BYKEY", "k"))


# Reducers ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT s AS w_start, s + INTERVAL '24 hours' AS w_end, {_SUM} FROM (SELECT v, time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * i AS s FROM {EVENTS}, (SELECT unnest(range(4)) AS i)) GROUP BY s")
def sliding_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(w.sliding_sums(events(spark, sf_dir), 6 * 3_600_000_000, 4).drop("n"))


@query(f"SELECT w_end AS t, CAST(sum(v) AS BIGINT) AS v FROM {_W} GROUP BY w_end")
def sums_at_window_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.at_window_end(a.sum_by(_daily(spark, sf_dir), "window"), "sum")


@query(f"SELECT w_start, w_end, string_agg(DISTINCT k2, ',' ORDER BY k2) AS values FROM {_W} GROUP BY ALL")
def merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.merge_set(_daily(spark, sf_dir), "window", value="k2")).withColumn("values", F.array_join("values", ","))


@query(f"SELECT w_start, w_end, k2, {_N} FROM {_W} GROUP BY ALL")
def merged_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.merge_bag(_daily(spark, sf_dir), "window", value="k2"))


@query(f"SELECT w_start, w_end, CAST(count(DISTINCT k) AS BIGINT) AS n FROM {_W} GROUP BY ALL")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.distinct_count(_daily(spark, sf_dir), "window", value="k"))


@query(f"SELECT w_start, w_end, CAST(count(DISTINCT k) AS BIGINT) AS exact, true AS close FROM {_W} GROUP BY ALL")
def distinct_counts_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog++ beside the exact count, and whether it is within a fifth of it."""
    near = _daily(spark, sf_dir).groupBy("window").agg(F.approx_count_distinct("k").alias("n"), F.count_distinct("k").alias("exact"))
    return flat(near.select("window", "exact", (F.abs(F.col("n") - F.col("exact")) <= F.col("exact") * 0.2).alias("close")))


@query(f"SELECT w_start, w_end, k, max(v) - min(v) AS spread, {_N} FROM {_W} GROUP BY ALL")
def own_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = a.reduce_by(_daily(spark, sf_dir), lambda v: F.struct((F.max(v) - F.min(v)).alias("spread"), F.count(F.lit(1)).alias("n")), "window", "k", both="v")
    return flat(found.select("window", "k", "both.spread", "both.n"))


@query(f"SELECT k, k2, {_SUM}, max(v) - min(v) AS spread FROM {EVENTS} GROUP BY k, k2")
def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and spread by an aggregate in Python, with states that tasks combine."""

    def add(state, frame):
        v = frame.v.to_numpy()
        return (state[0] + int(v.sum()), min(state[1], int(v.min())), max(state[2], int(v.max())))

    return a.user_aggregate(
        events(spark, sf_dir).select("k", "k2", "v"), ("k", "k2"), lambda: (0, 1 << 62, -(1 << 62)), add,
        lambda x, y: (x[0] + y[0], min(x[1], y[1]), max(x[2], y[2])), lambda s: (s[0], s[2] - s[1]), "sum long, spread long",
    )


_TOP10 = f"""SELECT w_start, w_end, k, sum, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY w_start ORDER BY sum DESC, k) AS INTEGER) AS rank FROM (
SELECT w_start, w_end, k, {_SUM} FROM {_W} GROUP BY ALL)) WHERE rank <= 10"""


@query(_TOP10)
def top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.top_n(a.sum_by(_daily(spark, sf_dir), "window", "k"), 10, "window"))


# Text --------------------------------------------------------------------------------------------------------------------

_WORDS = """(SELECT time_bucket(INTERVAL '1 second', ts) AS w_start, time_bucket(INTERVAL '1 second', ts) + INTERVAL '1 second' AS w_end, word FROM (
SELECT make_timestamp(doc_id * 50000) AS ts, unnest(regexp_extract_all(upper(regexp_replace(text, '[^\\x00-\\x7F]', '.', 'g')), '[A-Z][A-Z'']*')) AS word FROM documents))"""


def _windowed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, twenty documents a second of event time."""
    docs = table(spark, sf_dir, "documents").select(scalar.plain_time(F.col("doc_id") * 50_000).alias("ts"), "text")
    return w.fixed(stateless.tokens(docs, keep=("ts",)), "1 second")


@query(f"SELECT w_start, w_end, word, {_N} FROM {_WORDS} GROUP BY ALL")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_windowed_words(spark, sf_dir).groupBy("window", "word").agg(F.sum("n").alias("n")))


@query(f"SELECT w_end AS t, CAST(count(*) AS BIGINT) AS v FROM {_WORDS} GROUP BY w_end")
def word_count_at_window_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.at_window_end(_windowed_words(spark, sf_dir).groupBy("window").agg(F.sum("n").alias("n")), "n")


@query(f"SELECT w_start, w_end, CAST(count(DISTINCT word) AS BIGINT) AS n FROM {_WORDS} GROUP BY ALL")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.distinct_count(_windowed_words(spark, sf_dir), "window"))


_NET = f"(SELECT w_start, w_end, (((CAST(10 AS BIGINT) * 16777216 + k) << 32) | (CAST(192 AS BIGINT) * 16777216 + event_id % 7)) AS ippair, v AS rtt FROM {_W})"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _daily(spark, sf_dir)
    name = F.format_string("10.0.%d.%d-192.0.0.%d", F.floor(F.col("k") / 256), F.col("k") % 256, F.col("event_id") % 7)
    return rows.select("window", scalar.pack_ip_pair(name).alias("ippair"), F.col("v").alias("rtt"))


@query(f"SELECT w_start, w_end, ippair, CAST(sum(rtt) AS BIGINT) AS sum FROM {_NET} GROUP BY ALL")
def network_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.sum_by(_probes(spark, sf_dir), "window", "ippair", value="rtt"))


@query(f"""SELECT w_start, w_end, ippair, sum, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY w_start ORDER BY sum DESC, ippair) AS INTEGER) AS rank FROM (
SELECT w_start, w_end, ippair, CAST(sum(rtt) AS BIGINT) AS sum FROM {_NET} GROUP BY ALL)) WHERE rank <= 10""")
def network_latency_top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(a.top_n(a.sum_by(_probes(spark, sf_dir), "window", "ippair", value="rtt"), 10, "window", tie="ippair"))
