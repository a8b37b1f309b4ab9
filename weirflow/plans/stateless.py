"""Queries of sources, filters, maps, text operators and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import stateless as op
from ..sources import readers
from .registry import EVENTS, events, query, table

#: Scores of some words, for the sentiment operators; they are fixed values of our own.
LEXICON = {"the": 1, "with": 2, "and": 1, "not": -2, "of": -1, "that": 3, "for": -3, "und": 1, "der": -1, "que": 2, "les": -2, "est": 1}
_LEXICON_SQL = ", ".join(f"('{w}', {s})" for w, s in LEXICON.items())


# Filters and projections ---------------------------------------------------------------------------------------------


@query(f"SELECT event_id, k, v, ts FROM {EVENTS} WHERE v > 2000 AND v < 8000")
def filter_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_band(events(spark, sf_dir), "v", 2000, 8000).select("event_id", "k", "v", "ts")


@query(f"SELECT event_id FROM {EVENTS} WHERE k > 3 AND k < 9")
def filter_band_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_band_keys(events(spark, sf_dir), "k", "event_id", 3, 9)


@query(f"SELECT event_id, v FROM {EVENTS} WHERE v >= 2000")
def simple_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.select(events(spark, sf_dir), F.col("v") >= 2000).select("event_id", "v")


@query(f"SELECT v, 1 AS side FROM {EVENTS} UNION ALL SELECT v, 2 FROM {EVENTS}")
def tag_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = readers.fan_out(events(spark, sf_dir), 2)
    return op.tag_side(one, "v", 1).unionByName(op.tag_side(two, "v", 2))


@query(f"SELECT event_id, 2 * v + 1 AS doubled FROM {EVENTS} WHERE v % 2 = 0")
def par_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    def process(offset, frame):
        frame = frame[frame.v % 2 == 0]
        return frame.assign(doubled=2 * frame.v + offset)[["event_id", "doubled"]]

    return op.par_do(events(spark, sf_dir).select("event_id", "v"), process, "event_id long, doubled long", start=lambda: 1)


@query("SELECT event_id, CAST(k AS VARCHAR) AS k, v FROM (SELECT event_id, k, v FROM " + EVENTS + ")")
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.project(events(spark, sf_dir), "event_id", "k", "v").withColumn("k", F.col("k").cast("string"))


# Text ----------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT word) AS BIGINT) AS words FROM (
SELECT doc_id, unnest(regexp_extract_all(upper(text), '[A-Z][A-Z'']*')) AS word FROM (
SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '.', 'g') AS text FROM documents)) GROUP BY doc_id""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = op.tokens(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return words.groupBy("doc_id", "word").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lines(table(spark, sf_dir, "documents"), keep=("doc_id",))


@query("""SELECT doc_id, unnest(list_slice(string_split(text, chr(10)), 2, len(string_split(text, chr(10))) - 1)) AS line
FROM documents WHERE len(string_split(text, chr(10))) > 2""")
def slice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lines(table(spark, sf_dir, "documents"), keep=("doc_id",), slices=True)


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS match FROM pages")
def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.grep(table(spark, sf_dir, "pages"), 'href="[^"]*"', "html", ("page_id",))


@query("""SELECT page_id, match, CAST(count(*) AS BIGINT) AS n FROM (
SELECT page_id, unnest(regexp_extract_all(html, '<([a-z]+) ([a-z]+)=', 0)) AS match FROM pages UNION ALL
SELECT page_id, unnest(regexp_extract_all(html, '<([a-z]+) ([a-z]+)=', 1)) FROM pages UNION ALL
SELECT page_id, unnest(regexp_extract_all(html, '<([a-z]+) ([a-z]+)=', 2)) FROM pages) GROUP BY ALL""")
def grep_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.grep_groups(table(spark, sf_dir, "pages"), "<([a-z]+) ([a-z]+)=", 2, "html", ("page_id",))
    return found.groupBy("page_id", "match").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH l(word, score) AS (VALUES {_LEXICON_SQL}),
t AS (SELECT doc_id, unnest(string_split_regex(text, '[\\t ]')) AS word FROM documents),
s AS (SELECT doc_id, sum(score) AS score FROM t JOIN l USING (word) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(score, 0) AS BIGINT) AS score FROM documents LEFT JOIN s USING (doc_id)""")
def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(sorted(LEXICON.items()), "word string, score int")
    return op.sentiment(table(spark, sf_dir, "documents"), lexicon, "doc_id")


@query(f"""WITH l(word, score) AS (VALUES {_LEXICON_SQL}),
c AS (SELECT conv_id, turn, row_number() OVER () AS i, text FROM conversations),
t AS (SELECT i, unnest(string_split_regex(text, '[\\t ]')) AS word FROM c),
s AS (SELECT i, sum(score) AS score FROM t JOIN l USING (word) GROUP BY i)
SELECT conv_id, turn, CAST(coalesce(score, 0) AS BIGINT) AS score FROM c LEFT JOIN s USING (i)""")
def sentiment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sentiment_map(table(spark, sf_dir, "conversations"), LEXICON).select("conv_id", "turn", "score")


# Scalars -------------------------------------------------------------------------------------------------------------


@query(f"""SELECT event_id, (((CAST(10 AS BIGINT) * 16777216 + (k % 7) * 65536 + (k % 250) * 256 + v % 200) << 32)
| (CAST(192 AS BIGINT) * 16777216 + 168 * 65536 + (event_id % 250) * 256 + 1)) AS ippair FROM {EVENTS}""")
def ip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    name = F.format_string("10.%d.%d.%d-192.168.%d.1", F.col("k") % 7, F.col("k") % 250, F.col("v") % 200, F.col("event_id") % 250)
    return rows.select("event_id", scalar.pack_ip_pair(name).alias("ippair"))


@query(f"SELECT event_id, ((k << 16) | (k << 8) | (event_id % 100)) AS plug, CAST(round(value * 1000) AS BIGINT) AS mw FROM {EVENTS} JOIN (SELECT event_id, value FROM events) USING (event_id)")
def plug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", scalar.plug_id(F.col("user_id"), F.col("event_id") % 100).alias("plug"), scalar.milli(F.col("value")).alias("mw"))


@query(f"SELECT event_id, CAST(trunc((v - 5000) / 7.0) AS BIGINT) AS mean FROM {EVENTS}")
def truncated_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", scalar.truncated_mean(F.col("v") - 5000, F.lit(7)).alias("mean"))


# Sources -------------------------------------------------------------------------------------------------------------


@query(f"""SELECT e.k, e.v, make_timestamp(10000000 + i * 250) AS ts
FROM (SELECT unnest(range(3000)) AS i) JOIN {EVENTS} e ON e.event_id = (i + 10) % (SELECT count(*) FROM events)""")
def pseudo_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = events(spark, sf_dir).select("event_id", "k", "v")
    out = readers.pseudo_source(spark, base, "event_id", 3000, 10_000_000, 250, 10)
    return out.select("k", "v", scalar.plain_time(F.unix_micros("ts")).alias("ts"))


@query(f"""SELECT event_id, make_timestamp(10000000 + event_id // 300 * 3000000 + event_id % 300 * 1000000 // 300) AS ts FROM {EVENTS}""")
def epoch_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.epochs(events(spark, sf_dir), "event_id", 300, gap_us=2_000_000)
    return out.select("event_id", scalar.plain_time(F.unix_micros("ts")).alias("ts"))


@query("SELECT CAST(10000 AS BIGINT) AS n, true AS keys_in_range, true AS values_in_range, true AS rising")
def random_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.random_kv(spark, 10_000, seed=3)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.every(F.col("k").between(1000, 10999)).alias("keys_in_range"), F.every(F.col("v").between(0, 9)).alias("values_in_range"), (F.count_distinct("ts") == 10_000).alias("rising"))


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS slices, CAST(sum(length(part)) AS BIGINT) AS chars, min(part) AS least FROM (
SELECT doc_id, substring(text, first + 1, 1000) AS part FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS first FROM documents)) GROUP BY doc_id""")
def text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = readers.text_slices(table(spark, sf_dir, "documents").select("doc_id", "text"), 1000)
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("slices"), F.sum(F.char_length("text")).cast("long").alias("chars"), F.min("text").alias("least"))


@query("SELECT text FROM conversations WHERE role = 'user'")
def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "user", F.to_json(F.struct("text"))).otherwise(F.lit("{not json"))
    return readers.tweets(rows.select(line.alias("text")))


@query("SELECT CAST(k AS BIGINT) AS k, event_id FROM (SELECT event_id, regexp_extract(props, '[0-9]+') AS k FROM events)")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(scalar.json_text(F.col("props"), "k").cast("long").alias("k"), "event_id")
