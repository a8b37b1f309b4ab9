"""Queries of windowing: fixed, sliding, session and global windows, and grouping by key inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windowing as w
from .registry import EVENTS, events, flat, query

HOUR = 3_600_000_000
_COUNT = "CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS sum"


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return flat(df.groupBy("window", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum")))


@query(f"""SELECT s AS w_start, s + INTERVAL '6 hours' AS w_end, {_COUNT} FROM (SELECT v, time_bucket(INTERVAL '6 hours', ts) AS s FROM {EVENTS}) GROUP BY s""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(w.fixed(events(spark, sf_dir), "6 hours"))


@query(f"""SELECT s AS w_start, s + INTERVAL '6 hours' AS w_end, {_COUNT} FROM (
SELECT v, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-03 01:30:00') AS s FROM {EVENTS} WHERE ts >= TIMESTAMP '2024-01-03 01:30:00') GROUP BY s""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(w.segment(events(spark, sf_dir), "6 hours", "2024-01-03 01:30:00"))


_BY_KEY = f"SELECT s AS w_start, s + INTERVAL '1 day' AS w_end, {{0}}, {_COUNT} FROM (SELECT k, k2, v, time_bucket(INTERVAL '1 day', ts) AS s FROM {EVENTS}) GROUP BY s, {{0}}"


@query(_BY_KEY.format("k"))
def window_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exchange, of partial counts by window and key."""
    return _counted(w.fixed(events(spark, sf_dir), "1 day"), "k")


@query(_BY_KEY.format("k, k2"))
def window_by_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(w.fixed(events(spark, sf_dir), "1 day"), "k", "k2")


@query(_BY_KEY.format("k2"))
def regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by one key are counted anew by another: only partial results move."""
    counts = w.fixed(events(spark, sf_dir), "1 day").groupBy("window", "k", "k2").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"))
    return flat(counts.groupBy("window", "k2").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")))


@query(f"SELECT w_start, w_start + INTERVAL '1 day' AS w_end, k, event_id, v FROM (SELECT k, event_id, v, time_bucket(INTERVAL '1 day', ts) AS w_start FROM {EVENTS})")
def grouped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows themselves, those of a window and key side by side."""
    return flat(w.group_sorted(w.fixed(events(spark, sf_dir), "1 day"), "k").select("window", "k", "event_id", "v"))


_SLIDING = f"""SELECT s AS w_start, s + INTERVAL '24 hours' AS w_end, k, {_COUNT} FROM (
SELECT k, v, time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * i AS s FROM {EVENTS}, (SELECT unnest(range(4)) AS i)) GROUP BY s, k"""


@query(_SLIDING)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(w.sliding(events(spark, sf_dir), 6 * HOUR, 4), "k")


@query(_SLIDING)
def sliding_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slide is summed once; windows are sums of slides."""
    return flat(w.sliding_sums(events(spark, sf_dir), 6 * HOUR, 4, ("k",)))


@query(f"""SELECT k, min(ts) AS w_start, max(ts) + INTERVAL '12 hours' AS w_end, {_COUNT} FROM (
SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY ts, event_id) AS session FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY k ORDER BY ts, event_id) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS opens FROM {EVENTS})) GROUP BY k, session""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = w.by_session(events(spark, sf_dir), 12 * HOUR, ("k",)).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"))
    return found.select("k", F.col("window.start").alias("w_start"), w.session_end().alias("w_end"), "n", "sum")


@query(f"SELECT TIMESTAMP '0001-01-01 00:00:00' AS w_start, TIMESTAMP '9999-12-31 00:00:00' AS w_end, {_COUNT} FROM {EVENTS}")
def global_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(w.global_window(events(spark, sf_dir)))
