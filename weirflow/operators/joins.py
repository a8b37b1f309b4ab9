"""Joins of two keyed inputs, inside a window where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_key(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """For every key on both sides all rows of the left and all of the right: m + n rows, not m * n.

    Both sides are semi-joined with the other's keys; those are made distinct first, so a hot key is one row of the
    side that is looked up and the rows that carry it can be split. Streams, where distinct keys would be another
    state, are semi-joined as they are.
    """
    keys = lambda df: df.select(*on) if df.isStreaming else df.select(*on).distinct()
    return left.join(keys(right), list(on), "left_semi").select(*left.columns).unionByName(right.join(keys(left), list(on), "left_semi").select(*left.columns))


def join_by_filter(rows: DataFrame, threshold: DataFrame, value: str = "v", over: str = "v", *on: str) -> DataFrame:
    """Rows with value > the threshold row's column over, of the same window; equal values are out.

    threshold has one row for each combination of on (one in all, without on).
    """
    limit = threshold.select(*[F.col(c).alias(f"{c}_") for c in on], F.col(over).alias("over_"))
    condition = F.col(value) > F.col("over_")
    for c in on:
        condition &= F.col(c) == F.col(f"{c}_")
    return rows.join(limit, condition).select(*rows.columns)


def join_by_filter_left(threshold: DataFrame, rows: DataFrame, value: str = "v", over: str = "v", *on: str) -> DataFrame:
    """The same with the threshold on the left."""
    return join_by_filter(rows, threshold, value, over, *on)


def above(rows: DataFrame, limit: int, value: str = "v") -> DataFrame:
    """The form with a plain number."""
    return rows.where(F.col(value) > limit)


def interval_join(left: DataFrame, right: DataFrame, width_us: int, key: str = "k", value: str = "v", ts: str = "ts") -> DataFrame:
    """(k, values [left, right], ts of the right) for equal keys and right ts in [left ts - width, left ts + width).

    Time is cut into buckets of the width and the left row put into three of them, so the join is on key and bucket: a
    hot key is spread over its buckets and rows far apart in time never meet. Streams, which need both watermarks and the
    bounds alone, take interval_join_stream.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = left.select(F.col(key).alias("k"), F.col(value).alias("av"), micros(ts).alias("at"))
    a = a.withColumn("b", F.explode(F.sequence(F.floor(F.col("at") / width_us) - 1, F.floor(F.col("at") / width_us) + 1)))
    b = right.select(F.col(key).alias("k"), F.col(value).alias("bv"), micros(ts).alias("bt"), F.col(ts).alias("ts"), F.floor(micros(ts) / width_us).alias("b"))
    return a.join(b, ["k", "b"]).where((F.col("bt") >= F.col("at") - width_us) & (F.col("bt") < F.col("at") + width_us)).select("k", F.array("av", "bv").alias("values"), "ts")


def interval_join_stream(left: DataFrame, right: DataFrame, width: str, key: str = "k", value: str = "v", ts: str = "ts") -> DataFrame:
    """The same on watermarked streams; the time bounds let both sides' state go."""
    a = left.select(F.col(key).alias("k"), F.col(value).alias("av"), F.col(ts).alias("at"))
    b = right.select(F.col(key).alias("bk"), F.col(value).alias("bv"), F.col(ts).alias("bt"))
    on = F.expr(f"k = bk and bt >= at - interval {width} and bt < at + interval {width}")
    return a.join(b, on).select("k", F.array("av", "bv").alias("values"), F.col("bt").alias("ts"))


def join_on_time(left: DataFrame, right: DataFrame) -> DataFrame:
    """(t, values) of two (t, v) inputs at equal times."""
    return left.select("t", F.col("v").alias("lv")).join(right.select("t", F.col("v").alias("rv")), "t").select("t", F.array("lv", "rv").alias("values"))
