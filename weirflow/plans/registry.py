"""The registry that plan modules enter their queries in, and the frames they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The events as keyed records, in SQL: k, k2 and whole-numbered v as in events().
EVENTS = "(SELECT event_id, user_id AS k, event_type AS k2, CAST(floor(value * 100) AS BIGINT) AS v, ts FROM events)"
ITEMS = "(SELECT l_suppkey AS k, l_returnflag AS k2, CAST(l_quantity AS BIGINT) AS v, l_shipdate AS ts FROM lineitem)"


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(events: DataFrame) -> DataFrame:
    """(event_id, k, k2, v, ts): k2v records of the events table or stream, values in hundredths."""
    return events.select("event_id", F.col("user_id").alias("k"), F.col("event_type").alias("k2"), F.floor(F.col("value") * 100).cast("long").alias("v"), "ts")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(table(spark, sf_dir, "events"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, k2, v, ts): kv records of lineitem."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("k2"), F.col("l_quantity").cast("long").alias("v"), F.col("l_shipdate").alias("ts"))


def flat(df: DataFrame) -> DataFrame:
    """The window as two columns, as SQL has them."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *rest)
