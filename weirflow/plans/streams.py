"""Queries that run as streams over the standard tables' files, to their end; what they append equals the bounded result
of the windows that the last watermark closed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as a
from ..operators import joins as j
from ..operators import stateless
from ..operators import windowing as w
from ..sources import readers
from ..storage import new_folder
from ..streaming import runtime
from .aggregates import _WORDS
from .joins import grid
from .registry import EVENTS, keyed, query, table

_W = f"(SELECT *, time_bucket(INTERVAL '1 day', ts) AS w_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS w_end FROM {EVENTS})"
_CLOSED = "w_end <= (SELECT max(ts) - INTERVAL '10 seconds' FROM events)"
_N = "CAST(count(*) AS BIGINT) AS n"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").drop("props")
    path = readers.in_event_order(rows, f"{sf_dir}/events.parquet", "ts")
    return runtime.watermarked(keyed(readers.parquet_stream(spark, path, rows.schema)))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.fixed(_events(spark, sf_dir), "1 day")


def _done(df: DataFrame, name: str) -> DataFrame:
    return runtime.run_available(runtime.without_zone(df), name)


@query(f"SELECT event_id, k, v FROM {EVENTS} WHERE v > 2000 AND v < 8000")
def stream_filter_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(stateless.filter_band(_events(spark, sf_dir), "v", 2000, 8000).select("event_id", "k", "v"), "band")


@query(f"SELECT w_start, w_end, k, CAST(sum(v) AS BIGINT) AS sum FROM {_W} WHERE {_CLOSED} GROUP BY ALL")
def stream_sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(a.windowed(_daily(spark, sf_dir), "SUM_BYKEY", "k"), "sum")


@query(f"SELECT w_start, w_end, k, avg(v) AS avg, {_N} FROM {_W} WHERE {_CLOSED} GROUP BY ALL")
def stream_avg_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(a.windowed(_daily(spark, sf_dir), "AVG_BYKEY", "k"), "avg")


@query(f"SELECT w_start, w_end, k, CAST(median(v) AS DOUBLE) AS median FROM {_W} WHERE {_CLOSED} GROUP BY ALL")
def stream_median_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(a.windowed(_daily(spark, sf_dir), "MEDV_BYKEY", "k"), "median")


_WR = f"SELECT *, count(*) OVER (PARTITION BY w_start, k) AS n, row_number() OVER (PARTITION BY w_start, k ORDER BY v {{0}}) AS r FROM {_W} WHERE {_CLOSED}"


@query(f"SELECT w_start, w_end, k, v FROM ({_WR.format('DESC')}) WHERE r <= n * 500 // 1000")
def stream_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(a.windowed(_daily(spark, sf_dir), "TOPV_BYKEY", "k", share=0.5), "top")


@query(f"SELECT w_start, w_end, k, v FROM ({_WR.format('')}) WHERE r = least(n * 500 // 1000 + 1, n)")
def stream_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(a.windowed(_daily(spark, sf_dir), "PERCENTILE_BYKEY", "k", share=0.5), "percentile")


@query(f"SELECT DISTINCT w_start, w_end, k FROM {_W}")
def stream_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(a.windowed(_daily(spark, sf_dir), "UNIQUE_BYKEY", "k"), "unique")


@query(f"""SELECT s AS w_start, s + INTERVAL '24 hours' AS w_end, CAST(sum(v) AS BIGINT) AS sum FROM (
SELECT v, time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * i AS s FROM {EVENTS}, (SELECT unnest(range(4)) AS i))
WHERE s + INTERVAL '24 hours' <= (SELECT max(ts) - INTERVAL '10 seconds' FROM events) GROUP BY s""")
def stream_sliding_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(a.sum_by(w.sliding(_events(spark, sf_dir), 6 * 3_600_000_000, 4), "window"), "sliding")


@query(f"""SELECT * FROM (SELECT k, min(ts) AS w_start, max(ts) + INTERVAL '12 hours' AS w_end, {_N} FROM (
SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY ts, event_id) AS session FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY k ORDER BY ts, event_id) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS opens FROM {EVENTS})) GROUP BY k, session) WHERE {_CLOSED}""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = w.by_session(_events(spark, sf_dir), 12 * 3_600_000_000, ("k",)).agg(F.count(F.lit(1)).alias("n"))
    return _done(found.select("k", F.col("window.start").alias("w_start"), w.session_end().alias("w_end"), "n"), "session")


@query(f"""WITH l AS (SELECT * FROM {_W} WHERE k2 = 'purchase'), r AS (SELECT * FROM {_W} WHERE k2 = 'error')
SELECT w_start, w_end, event_id, k, v FROM l WHERE (w_start, k) IN (SELECT (w_start, k) FROM r)
UNION ALL SELECT w_start, w_end, event_id, k, v FROM r WHERE (w_start, k) IN (SELECT (w_start, k) FROM l)""")
def stream_join_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _daily(spark, sf_dir).where("k2 = 'purchase'"), _daily(spark, sf_dir).where("k2 = 'error'")
    with runtime.least_watermark(spark):
        return _done(j.join_by_key(left, right, "window", "k").select("window", "event_id", "k", "v"), "join")


@query(f"""SELECT l.k, l.v AS left_v, r.v AS right_v, r.ts FROM {EVENTS} l JOIN {EVENTS} r ON l.k = r.k
AND r.ts >= l.ts - INTERVAL '6 hours' AND r.ts < l.ts + INTERVAL '6 hours' WHERE l.k2 = 'purchase' AND r.k2 = 'error'""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _events(spark, sf_dir).where("k2 = 'purchase'"), _events(spark, sf_dir).where("k2 = 'error'")
    found = j.interval_join_stream(left, right, "6 hours")
    with runtime.least_watermark(spark):
        return _done(found.select("k", F.col("values")[0].alias("left_v"), F.col("values")[1].alias("right_v"), "ts"), "interval")


@query(f"""WITH p AS (SELECT w_start, w_end, k2 AS house, k AS plug, avg(v) AS a FROM {_W} WHERE {_CLOSED} GROUP BY ALL), g AS (SELECT w_start, avg(v) AS g FROM {_W} GROUP BY w_start)
SELECT w_start, w_end, house, {_N} FROM p JOIN g USING (w_start) WHERE a > g GROUP BY w_start, w_end, house""")
def stream_grid_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_load on a stream: two aggregations, their join on the window, and an aggregation of that."""
    plugs = a.avg_by(_daily(spark, sf_dir), "window", "k2", "k")
    mean = a.avg_by(_daily(spark, sf_dir), "window").select("window", F.col("avg").alias("g"))
    high = plugs.join(mean, "window").where("avg > g")
    with runtime.least_watermark(spark):
        return _done(high.groupBy("window", F.col("k2").alias("house")).agg(F.count(F.lit(1)).alias("n")), "grid")


@query(f"""SELECT w_start, w_end, k, sum, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY w_start ORDER BY sum DESC, k) AS INTEGER) AS rank FROM (
SELECT w_start, w_end, k, CAST(sum(v) AS BIGINT) AS sum FROM {_W} WHERE {_CLOSED} GROUP BY ALL)) WHERE rank <= 10""")
def stream_top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams have no ranking: a window's sums come in one micro-batch, when it closes, and are ranked there. State goes
    with the watermark."""
    path = new_folder(spark, "top10")
    sums = a.sum_by(_daily(spark, sf_dir), "window", "k")

    def each(batch: DataFrame, number: int) -> None:
        runtime.without_zone(a.top_n(batch, 10, "window")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    runtime.batch_sink(sums, each, "append", f"{path}-progress", available_now=True).awaitTermination()
    return spark.read.parquet(path).drop("batch")


IDLE_MS = 30 * 86_400_000


@query(f"SELECT k, CAST(sum(v) AS BIGINT) AS total, {_N} FROM {EVENTS} GROUP BY k")
def stream_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each key in a state of our own; every micro-batch adds rows, the last of a key counts.

    The state of a key without rows for IDLE_MS of event time goes; the key's next row begins a new total, told from
    the old one by its first time.
    """

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        began, total, n, last = state.get if state.exists else (None, 0, 0, 0)
        for frame in frames:
            micros = frame.ts.astype("datetime64[us]").astype("int64")
            began = int(micros.min()) if began is None else began
            total, n, last = total + int(frame.v.sum()), n + len(frame), max(last, int(micros.max()) // 1000)
        state.update((began, total, n, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame([[*key, began, total, n]], columns=["k", "began", "total", "n"])

    path = new_folder(spark, "totals")
    rows = _events(spark, sf_dir).select("k", "v", "ts")
    totals = runtime.keyed_state(rows, ("k",), update, "k long, began long, total long, n long", "began long, total long, n long, last long", "EventTimeTimeout")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    runtime.batch_sink(totals, each, "update", f"{path}-progress", available_now=True).awaitTermination()
    seen = spark.read.schema("k long, began long, total long, n long, batch int").parquet(path)
    last = seen.groupBy("k", "began").agg(F.max_by("total", "batch").alias("total"), F.max_by("n", "batch").alias("n"))
    return last.groupBy("k").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


@query(f"SELECT w_start, w_end, word, {_N} FROM {_WORDS} WHERE w_end <= (SELECT make_timestamp(max(doc_id) * 50000) - INTERVAL '10 seconds' FROM documents) GROUP BY ALL")
def stream_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all words by window; a window's counts leave the state when it closes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = readers.in_event_order(rows, f"{sf_dir}/documents.parquet", "doc_id")
    docs = readers.parquet_stream(spark, path, rows.schema)
    docs = runtime.watermarked(docs.select(F.timestamp_micros(F.col("doc_id") * 50_000).alias("ts"), "text"))
    words = stateless.tokens(w.fixed(docs, "1 second"), keep=("window",))
    return _done(words.groupBy("window", "word").agg(F.sum("n").alias("n")), "words")
