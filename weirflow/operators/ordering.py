"""Sort, merge, union and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """A total order: range partitions, each sorted; give a last key that is unique for one result."""
    return df.orderBy(*keys)


def sorted_runs(df: DataFrame, *keys: str) -> DataFrame:
    """Independently sorted runs, for what needs order inside a partition alone: the partitions that are there, no exchange."""
    return df.sortWithinPartitions(*keys)


def merge(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Two inputs in one order; of equal keys those of the right come first."""
    both = left.withColumn("side_", F.lit(1)).unionByName(right.withColumn("side_", F.lit(0)))
    return both.orderBy(*keys, "side_").drop("side_")


def concatenate(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs, by column name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def partition_by_key(df: DataFrame, key: str) -> DataFrame:
    """Key-aligned partitions: no key is cut. Their number is the session's, and adaptive execution joins small ones."""
    return df.repartition(key)


def sample_rows(df: DataFrame, n: int) -> list:
    """At most n rows to look at, n at most 10,000."""
    return df.limit(min(n, 10_000)).collect()
