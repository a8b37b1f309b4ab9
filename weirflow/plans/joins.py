"""Queries of joins, sorting, merging and union, and pipelines that combine them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregate as a
from ..operators import joins as j
from ..operators import ordering, stateless
from ..operators import windowing as w
from .registry import EVENTS, events, flat, query, table
from .stateless import _LEXICON_SQL, LEXICON

_W = f"(SELECT *, time_bucket(INTERVAL '1 day', ts) AS w_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS w_end FROM {EVENTS})"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = w.fixed(events(spark, sf_dir), "1 day")
    return rows.where("k2 = 'purchase'"), rows.where("k2 = 'error'")


@query(f"""WITH l AS (SELECT * FROM {EVENTS} WHERE k2 = 'purchase'), r AS (SELECT * FROM {EVENTS} WHERE k2 <> 'purchase')
SELECT event_id, k, k2, v FROM l WHERE k IN (SELECT k FROM r) UNION ALL SELECT event_id, k, k2, v FROM r WHERE k IN (SELECT k FROM l)""")
def join_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return j.join_by_key(rows.where("k2 = 'purchase'"), rows.where("k2 != 'purchase'"), "k").select("event_id", "k", "k2", "v")


@query(f"""WITH l AS (SELECT * FROM {_W} WHERE k2 = 'purchase'), r AS (SELECT * FROM {_W} WHERE k2 = 'error')
SELECT w_start, w_end, event_id, k, k2, v FROM l WHERE (w_start, k) IN (SELECT (w_start, k) FROM r)
UNION ALL SELECT w_start, w_end, event_id, k, k2, v FROM r WHERE (w_start, k) IN (SELECT (w_start, k) FROM l)""")
def windowed_join_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return flat(j.join_by_key(left, right, "window", "k").select("window", "event_id", "k", "k2", "v"))


_ABOVE = f"SELECT w_start, w_end, event_id, v FROM {_W} JOIN (SELECT w_start, avg(v) AS g FROM {_W} GROUP BY w_start) USING (w_start) WHERE v > g"


@query(_ABOVE)
def join_by_filter_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = w.fixed(events(spark, sf_dir), "1 day")
    return flat(j.join_by_filter(rows, a.avg_by(rows, "window"), "v", "avg", "window").select("window", "event_id", "v"))


@query(_ABOVE)
def join_by_filter_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = w.fixed(events(spark, sf_dir), "1 day")
    return flat(j.join_by_filter_left(a.avg_by(rows, "window"), rows, "v", "avg", "window").select("window", "event_id", "v"))


@query(f"SELECT event_id, v FROM {EVENTS} WHERE v > (SELECT avg(v) FROM {EVENTS})")
def join_by_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return j.join_by_filter(rows, a.avg_by(rows), "v", "avg").select("event_id", "v")


@query(f"SELECT event_id, v FROM {EVENTS} WHERE v > 4200")
def above_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.above(events(spark, sf_dir), 4200).select("event_id", "v")


@query(f"""SELECT l.k, l.v AS left_v, r.v AS right_v, r.ts FROM {EVENTS} l JOIN {EVENTS} r ON l.k = r.k
AND r.ts >= l.ts - INTERVAL '6 hours' AND r.ts < l.ts + INTERVAL '6 hours' WHERE l.k2 = 'purchase' AND r.k2 = 'error'""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    found = j.interval_join(rows.where("k2 = 'purchase'"), rows.where("k2 = 'error'"), 6 * 3_600_000_000)
    return found.select("k", F.col("values")[0].alias("left_v"), F.col("values")[1].alias("right_v"), "ts")


@query(f"""SELECT t, l.v AS left_v, r.v AS right_v FROM (SELECT w_end AS t, CAST(sum(v) AS BIGINT) AS v FROM {_W} WHERE k2 = 'purchase' GROUP BY w_end) l
JOIN (SELECT w_end AS t, CAST(sum(v) AS BIGINT) AS v FROM {_W} WHERE k2 = 'error' GROUP BY w_end) r USING (t)""")
def join_on_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (a.at_window_end(a.sum_by(x, "window"), "sum") for x in _sides(spark, sf_dir))
    return j.join_on_time(left, right).select("t", F.col("values")[0].alias("left_v"), F.col("values")[1].alias("right_v"))


# Order -------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def sort_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sort(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query(f"SELECT event_id, k, v FROM {EVENTS}")
def sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sorted_runs(events(spark, sf_dir).select("event_id", "k", "v"), "k", "v")


@query(f"SELECT event_id, k, v FROM {EVENTS} ORDER BY k, event_id")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return ordering.merge(rows.where("k2 = 'purchase'"), rows.where("k2 != 'purchase'"), "k", "event_id").select("event_id", "k", "v")


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    two = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return ordering.concatenate(one, two)


# Pipelines -----------------------------------------------------------------------------------------------------------------

_GRID = f"""WITH p AS (SELECT w_start, w_end, k2 AS house, k AS plug, avg(v) AS a FROM {_W} GROUP BY ALL), g AS (SELECT w_start, avg(v) AS g FROM {_W} GROUP BY w_start)
SELECT w_start, w_end, house, CAST(count(*) AS BIGINT) AS n, round(avg(a), 4) AS avg FROM p JOIN g USING (w_start) WHERE a > g GROUP BY w_start, w_end, house"""


def grid(rows: DataFrame) -> DataFrame:
    """Two branches over windowed (k2 = house, k = plug, v): plugs whose mean is over the window's, by house.

    Plug sums serve both branches: the window's mean is taken from them, so rows are aggregated and shuffled once.
    """
    plugs = rows.groupBy("window", "k2", "k").agg(F.sum("v").alias("sum"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("a"))
    mean = plugs.groupBy("window").agg((F.sum("sum") / F.sum("n")).alias("g"))
    high = j.join_by_filter(plugs, mean, "a", "g", "window")
    return high.groupBy("window", F.col("k2").alias("house")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 4).alias("avg"))


@query(_GRID)
def grid_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses by the number and mean of their plugs that are above the window's average."""
    return flat(grid(w.fixed(events(spark, sf_dir), "1 day")))


@query(f"""WITH l(word, score) AS (VALUES {_LEXICON_SQL}),
d AS (SELECT time_bucket(INTERVAL '1 second', make_timestamp(doc_id * 50000)) + INTERVAL '1 second' AS t, text FROM documents),
s AS (SELECT t, sum(coalesce(score, 0)) AS v FROM (SELECT t, unnest(string_split_regex(text, '[\\t ]')) AS word FROM d) LEFT JOIN l USING (word) GROUP BY t),
n AS (SELECT t, count(*) AS v FROM (SELECT t, unnest(regexp_extract_all(upper(regexp_replace(text, '[^\\x00-\\x7F]', '.', 'g')), '[A-Z][A-Z'']*')) FROM d) GROUP BY t)
SELECT t, CAST(s.v AS BIGINT) AS sentiment, CAST(n.v AS BIGINT) AS words FROM s JOIN n USING (t)""")
def tweet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment and word count of the same text, each by window, joined on the window's end."""
    docs = table(spark, sf_dir, "documents").select(scalar.plain_time(F.col("doc_id") * 50_000).alias("ts"), "text")
    docs = w.fixed(docs, "1 second")
    scores = a.at_window_end(a.sum_by(stateless.sentiment_map(docs, LEXICON), "window", value="score"), "sum")
    words = a.at_window_end(stateless.tokens(docs, keep=("window",)).groupBy("window").agg(F.sum("n").alias("n")), "n")
    return j.join_on_time(scores, words).select("t", F.col("values")[0].alias("sentiment"), F.col("values")[1].alias("words"))


@query("""SELECT w_start, w_start + INTERVAL '1 second' AS w_end, match, CAST(count(*) AS BIGINT) AS n FROM (
SELECT time_bucket(INTERVAL '1 second', make_timestamp(page_id * 50000)) AS w_start, unnest(regexp_extract_all(html, 'https?://[a-z.]+')) AS match FROM pages) GROUP BY w_start, match""")
def windowed_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(scalar.plain_time(F.col("page_id") * 50_000).alias("ts"), "html")
    found = stateless.grep(w.fixed(pages, "1 second"), "https?://[a-z.]+", "html", ("window",))
    return flat(found.groupBy("window", "match").agg(F.count(F.lit(1)).alias("n")))
