"""Windows of event time as a struct column `window`: fixed, sliding, session, global."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, duration: str, ts: str = "ts", start: str | None = None) -> DataFrame:
    return df.withColumn("window", F.window(ts, duration, startTime=start) if start else F.window(ts, duration))


def segment(df: DataFrame, duration: str, base: str, ts: str = "ts") -> DataFrame:
    """Windows counted from base; rows before it are skipped."""
    at = F.lit(base).cast("timestamp_ntz" if dict(df.dtypes)[ts] == "timestamp_ntz" else "timestamp")
    return df.where(F.col(ts) >= at).withColumn("window", F.window(ts, duration, startTime=_offset(base, duration)))


def _offset(base: str, duration: str) -> str:
    """Where base lies in the windows that begin at the epoch."""
    return f"{(pd.Timestamp(base) - pd.Timestamp(0)).value // 1000 % (pd.Timedelta(duration).value // 1000)} microseconds"


def sliding(df: DataFrame, slide_us: int, multi: int, ts: str = "ts") -> DataFrame:
    """Windows of multi slides, one for each slide; a result belongs to the window's end."""
    return df.withColumn("window", F.window(ts, f"{slide_us * multi} microseconds", f"{slide_us} microseconds"))


def sliding_sums(df: DataFrame, slide_us: int, multi: int, keys: tuple[str, ...] = (), value: str = "v", ts: str = "ts") -> DataFrame:
    """Sum and count of sliding windows in two levels: each slide once, then multi slides together.

    A row meets its window once, whatever multi is, and what is repeated are slides' sums: for sums of many rows, the
    cheaper form of sliding().
    """
    base = df.withColumn("slide", F.window(ts, f"{slide_us} microseconds")).groupBy("slide", *keys).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    spread = base.withColumn("window", F.window(F.col("slide.start"), f"{slide_us * multi} microseconds", f"{slide_us} microseconds"))
    return spread.groupBy("window", *keys).agg(F.sum("s").alias("sum"), F.sum("c").alias("n"))


def by_session(df: DataFrame, duration_us: int, keys: tuple[str, ...] = (), ts: str = "ts"):
    """Groups of sessions: a record lasts for duration, and records that overlap share a session.

    Records exactly duration apart do not overlap, so the gap is a microsecond less; session_end() gives it back.
    """
    return df.groupBy(F.session_window(ts, f"{duration_us - 1} microseconds").alias("window"), *keys)


def session_end():
    return F.col("window.end") + F.expr("interval 1 microsecond")


def group_sorted(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a window and key side by side, for what needs the rows themselves: hash partitions by window and first key,
    sorted by all keys. An aggregate should not come through here: its own exchange sends partial results, not rows."""
    return df.repartition("window", keys[0]).sortWithinPartitions("window", *keys)


def regroup(df: DataFrame, key: str) -> DataFrame:
    """An already windowed stream by another key."""
    return group_sorted(df, key)


def global_window(df: DataFrame) -> DataFrame:
    """All rows in one window, from the first to the last moment there is."""
    end = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    return df.withColumn("window", F.struct(F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").alias("start"), end.alias("end")))
