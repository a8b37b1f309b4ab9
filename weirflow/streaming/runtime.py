"""Streams: watermarks, pacing, sinks and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.scalar import micros_of, plain_time
from ..storage import new_folder

SLACK = "10 seconds"


def watermarked(df: DataFrame, ts: str = "ts", slack: str = SLACK) -> DataFrame:
    """Event time with a watermark; columns without a time zone are taken as UTC. Rows older than it are dropped one by one."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        df = df.withColumn(ts, F.timestamp_micros(micros_of(F.col(ts))))
    return df.withWatermark(ts, slack)


POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


@contextmanager
def least_watermark(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside: after a join the slower side decides. The session's own setting comes back."""
    before = spark.conf.get(POLICY)
    spark.conf.set(POLICY, "min")
    try:
        yield
    finally:
        spark.conf.set(POLICY, before)


def memory_sink(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Results as a table of the session: for tests and small results."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def console_sink(df: DataFrame, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("console").outputMode(mode).option("truncate", False).start()


def parquet_sink(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Exactly-once files."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def without_zone(df: DataFrame) -> DataFrame:
    """df with its timestamps, and those of a window, as UTC times without a zone; the window becomes two columns."""
    if "window" in df.columns:
        df = df.select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *[c for c in df.columns if c != "window"])
    return df.withColumns({c: plain_time(F.unix_micros(c)) for c, kind in df.dtypes if kind == "timestamp"})


def run_available(df: DataFrame, name: str, available_now: bool = True) -> DataFrame:
    """Works off all that a stream's source holds, in append mode, into files of the shared folder; returns what they hold.
    Sources written in Python want available_now=False."""
    path = new_folder(df.sparkSession, f"stream-{name}")
    query = parquet_sink(df, path, f"{path}-progress", available_now)
    query.awaitTermination() if available_now else drain(query)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_sink(df: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "update", checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Calls each(batch, number) for every micro-batch: where ranking or ordering, which streams lack, is done."""
    writer = df.writeStream.foreachBatch(each).outputMode(mode)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def keyed_state(df: DataFrame, keys: tuple[str, ...], update: Callable, schema: str, state_schema: str, timeout: str = "NoTimeout", mode: str = "update") -> DataFrame:
    """A stateful operator of one's own: update(key, frames, state) gets a key's new rows and its state, which it may get,
    update and remove, and gives frames of schema. timeout is NoTimeout, ProcessingTimeTimeout or EventTimeTimeout."""
    return df.groupBy(*keys).applyInPandasWithState(update, schema, state_schema, mode, timeout)


def drain(query: StreamingQuery) -> None:
    """Works off what is there, then stops."""
    query.processAllAvailable()
    query.stop()


class Throughput(StreamingQueryListener):
    """Rows a second and latency of every trigger, as the engine reports them."""

    def __init__(self) -> None:
        self.seen: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.seen.append({"batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "ms": p.durationMs.get("triggerExecution"), "watermark": p.eventTime.get("watermark")})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
