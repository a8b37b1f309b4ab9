r"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations alone.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. A benchmark item gives windows of WINDOW words
(all its words, if fewer). The index is a folder of two tables: the corpus counts of the test terms, and postings
(term, document, position), sorted by term in each file, of the terms that searches go by: each window's two rarest. It can be
kept; another benchmark then adds only the terms that it lacks. The list of a window's rarest term, moved back by its
offset, is intersected with that of the second one, which leaves little but true occurrences; those are confirmed word by
word in their documents. Proximity matches are places of the rarest term that have all other terms of the window about
them, in any order.

What is broadcast (test terms, windows, found places) is measured first; beyond BROADCAST_BYTES the same joins
shuffle, and adaptive execution splits hot terms.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, folders, remove, shared_path

WINDOW = 10
#: Words that a proximity match may be wider than its window, on either side.
SLOP = 2
BROADCAST_BYTES = 16 << 20
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def raw_words(text: Column) -> Column:
    """The words in their own case; an empty string stands first or last if the text begins or ends in a gap."""
    return F.split(text, _GAP)


def word_count(words: Column) -> Column:
    ends = (F.element_at(words, 1) == "").cast("int") + (F.element_at(words, -1) == "").cast("int")
    return F.coalesce(F.greatest(F.size(words) - ends, F.lit(0)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a key that tells rows of one doc_id apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.withColumn("dk", F.xxhash64(F.col("doc_id"), F.col("text")))


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(wid, words, items): every distinct window of the items' words and the ids of the items that have it."""
    words = F.filter(raw_words(F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)), lambda w: w != "")
    items = benchmark.select(F.col(id_col).alias("item_id"), words.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    one = items.select("item_id", "all", F.explode(starts).alias("s")).select("item_id", F.slice("all", F.col("s"), F.lit(window)).alias("words"))
    return one.groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("wid", F.xxhash64("words"))


def _small(df: DataFrame, row_bytes: int, limit: int) -> bool:
    return df.count() * row_bytes <= limit


def _offer(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


class PositionalIndex:
    """Counts (term, cf) and postings (term, doc_id, dk, pos) of one corpus, in a folder that may be kept for other searches."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.kept = spark, path or shared_path(spark, "index"), path is not None

    def _held(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if name in folders(self.spark, self.path) else None

    def _missing(self, terms: DataFrame, name: str) -> DataFrame | None:
        held = self._held(name)
        missing = terms if held is None else cut(terms.join(held.select("term"), "term", "left_anti"))
        return None if held is not None and missing.isEmpty() else missing

    def counts(self, rows: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
        """(term, cf) of the terms of vocabulary, 0 for those that rows lack."""
        missing = self._missing(vocabulary, "counts")
        if missing is not None:
            corpus = rows.select(F.explode(raw_words(F.col("text"))).alias("w")).select(normal(F.col("w")).alias("term"))
            counts = corpus.join(_offer(missing, small), "term").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
            missing.join(_offer(counts, small), "term", "left").select("term", F.coalesce("cf", F.lit(0)).alias("cf")).write.mode("append").parquet(f"{self.path}/counts")
        return self._held("counts").join(_offer(vocabulary, small), "term", "left_semi")

    def postings(self, rows: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
        """(term, doc_id, dk, pos) of the given terms."""
        missing = self._missing(terms, "posted")
        if missing is not None:
            words = rows.select("doc_id", "dk", F.posexplode(raw_words(F.col("text"))).alias("pos", "w")).withColumn("term", normal(F.col("w")))
            found = words.join(_offer(missing, small), "term").select("term", "doc_id", "dk", "pos")
            found.sortWithinPartitions("term", "dk", "pos").write.mode("append").parquet(f"{self.path}/postings")
            missing.write.mode("append").parquet(f"{self.path}/posted")
        held = self._held("postings")
        return held.join(_offer(terms, small), "term", "left_semi") if self.kept else held

    def done(self) -> None:
        """An index of one search goes."""
        if not self.kept:
            remove(self.spark, self.path)


def ranked_terms(rows: DataFrame, windows: DataFrame, small: bool, index: PositionalIndex) -> DataFrame:
    """(wid, n, t1, o1, t2, o2): the two rarest terms of each window with their offsets, by their counts in rows.

    Windows with a term that rows lack can't occur and are left out; t2 is null for a window of one distinct term.
    """
    terms = windows.select("wid", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    counts = index.counts(rows, cut(terms.select("term").distinct()), small)
    known = terms.groupBy("wid", "n", "term").agg(F.min("off").alias("off")).join(_offer(counts, small), "term")
    lists = known.groupBy("wid", "n").agg(F.array_sort(F.collect_list(F.struct("cf", "term", "off"))).alias("by"))
    first, second = F.col("by")[0], F.get(F.col("by"), F.lit(1))
    return lists.where(first["cf"] > 0).select("wid", "n", first["term"].alias("t1"), first["off"].alias("o1"), second["term"].alias("t2"), second["off"].alias("o2"))


class _Search:
    """Windows of a benchmark looked up in rows: ranked terms and postings, taken once for phrases and proximity."""

    def __init__(self, rows: DataFrame, benchmark: DataFrame, window: int, limit: int, path: str | None = None):
        self.rows, self.limit, self.index = rows, limit, PositionalIndex(rows.sparkSession, path)
        self.windows, self.small = _prepared(benchmark, window, limit)
        self.ranked = cut(ranked_terms(rows, self.windows, self.small, self.index))
        terms = cut(self.ranked.select(F.col("t1").alias("term")).union(self.ranked.where("t2 is not null").select("t2")).distinct())
        self.postings = self.index.postings(rows, terms, self.small)

    def offer(self, df: DataFrame) -> DataFrame:
        return _offer(df, self.small)

    def phrases(self) -> DataFrame:
        """(doc_id, dk, wid, n, start) of every window in every row; start counts from the row's first raw word."""
        rarest = self.ranked.withColumnRenamed("t1", "term")
        at = self.postings.join(self.offer(rarest), "term").select("doc_id", "dk", "wid", "n", (F.col("pos") - F.col("o1")).alias("start"), "t2", "o2").where("start >= 0")
        second = self.postings.select(F.col("dk").alias("dk2"), F.col("doc_id").alias("doc_id2"), F.col("term").alias("term2"), F.col("pos").alias("pos2"))
        same = (F.col("dk") == F.col("dk2")) & F.col("doc_id").eqNullSafe(F.col("doc_id2"))
        two = at.where("t2 is not null").join(second, same & (F.col("t2") == F.col("term2")) & (F.col("start") + F.col("o2") == F.col("pos2")), "left_semi")
        places = cut(at.where("t2 is null").unionByName(two).select("doc_id", "dk", "wid", "n", "start").distinct())
        few = _small(places, 48, self.limit)
        wanted = places.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("wid", "n", "start")).alias("places"))
        # Rows with equal doc_id and text share their dk and their places; one of them is enough.
        found = _of_rows(self.rows, _offer(wanted, few)).select("doc_id", "dk", raw_words(F.col("text")).alias("raw"), "places")
        found = found.select("doc_id", "dk", "raw", F.inline("places"))
        part = F.transform(F.slice("raw", F.col("start") + 1, F.col("n")), normal)
        return found.select("doc_id", "dk", "wid", "n", "start", part.alias("words")).join(self.offer(self.windows.select("wid", "words")), ["wid", "words"]).drop("words")

    def near(self, slop: int) -> DataFrame:
        """(doc_id, dk, wid, pos): places of a window's rarest term that have all its terms at most n - 1 + slop words away."""
        terms = self.ranked.select(F.col("t1").alias("term"), "wid", "n").join(self.windows.select("wid", F.array_distinct("words").alias("words")), "wid")
        at = self.postings.join(self.offer(terms), "term").groupBy("doc_id", "dk").agg(F.collect_set(F.struct("wid", "n", "pos", "words")).alias("places"))
        found = _of_rows(self.rows, at).select("doc_id", "dk", F.transform(raw_words(F.col("text")), normal).alias("all"), "places")

        def close(p: Column) -> Column:
            reach = p["n"] - 1 + slop
            first = F.greatest(p["pos"] - reach, F.lit(0))
            return F.size(F.array_except(p["words"], F.slice("all", first + 1, p["pos"] + reach - first + 1))) == 0

        return found.select("doc_id", "dk", F.inline(F.transform(F.filter("places", close), lambda p: F.struct(p["wid"].alias("wid"), p["pos"].alias("pos"))))).distinct()

    def items(self, found: DataFrame) -> DataFrame:
        return found.join(self.offer(self.windows.select("wid", "items")), "wid")


def _of_rows(rows: DataFrame, marks: DataFrame, how: str = "inner") -> DataFrame:
    """rows with what was found for them, by (doc_id, dk); a null doc_id is one too."""
    marks = marks.withColumnsRenamed({"dk": "dk_", "doc_id": "doc_id_"})
    return rows.join(marks, (F.col("dk") == F.col("dk_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")), how).drop("dk_", "doc_id_")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, item_id, start, n): every occurrence in docs of n consecutive item words, a window, from word start on.

    Null, empty and wordless texts on either side match nothing; repeated rows match once. path keeps the index: it is that
    of one corpus, and later searches of the same docs add what it lacks.
    """
    search = _Search(_keyed(docs, id_col, text_col), benchmark, window, limit, path)
    found = cut(search.items(search.phrases()).select("doc_id", F.explode("items").alias("item_id"), "start", "n"))
    search.index.done()
    return found


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, window: int = WINDOW, limit: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, item_id, pos): places of a window's rarest term with all its other terms, in any order, at most
    n - 1 + slop words away on either side. Nulls, repeats and path as in phrase_matches()."""
    search = _Search(_keyed(docs, id_col, text_col), benchmark, window, limit, path)
    found = cut(search.items(search.near(slop)).select("doc_id", F.explode("items").alias("item_id"), "pos").distinct())
    search.index.done()
    return found


def _prepared(benchmark: DataFrame, window: int, limit: int) -> tuple[DataFrame, bool]:
    windows = cut(item_windows(benchmark, window))
    size = windows.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 24 * F.size("words") + 16 * F.size("items"))).first()[0] or 0
    return windows, size <= limit


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, limit: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near), a row for each row of docs.

    n_hit counts the words inside any occurrence of a window, n_items the items with such windows; items_sha256 is
    of their ids, sorted as strings and comma-joined. n_near counts the items with proximity matches. Null and wordless
    texts have no words, wordless items no windows, items without an id count in n_hit alone. Repeated rows get one row each;
    null ids are kept. Empty tables on either side give no hits. Texts of any length are taken whole; a row's words are one
    task's. Other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    search = _Search(rows, benchmark, window, limit, path)
    found = cut(search.phrases().select("doc_id", "dk", "wid", "n", "start").distinct())
    near = cut(search.near(slop).select("doc_id", "dk", "wid").distinct())
    search.index.done()
    hits = found.select("doc_id", "dk", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p")).groupBy("doc_id", "dk").agg(F.count_distinct("p").alias("n_hit"))
    items = search.items(found.select("doc_id", "dk", "wid").distinct()).select("doc_id", "dk", F.explode("items").alias("item"))
    items = items.groupBy("doc_id", "dk").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    close = search.items(near).select("doc_id", "dk", F.explode("items").alias("item")).groupBy("doc_id", "dk").agg(F.count_distinct("item").alias("n_near"))
    base = rows.select("doc_id", "dk", word_count(raw_words(F.col("text"))).alias("n_words"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return _of_rows(_of_rows(_of_rows(base, hits, "left"), items, "left"), close, "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any occurrence of a window, all columns. Rows with a null, empty or wordless text or a null
    doc_id are judged like others, and each of repeated rows; with an empty benchmark all rows stay."""
    search = _Search(_keyed(docs, "doc_id", "text"), benchmark, window, BROADCAST_BYTES)
    hit = cut(search.phrases().select(F.col("doc_id").alias("doc_id_"), F.col("dk").alias("dk_")).distinct())
    search.index.done()
    few = _small(hit, 32, BROADCAST_BYTES)
    return docs.join(_offer(hit, few), (F.xxhash64(docs["doc_id"], docs["text"]) == hit["dk_"]) & docs["doc_id"].eqNullSafe(hit["doc_id_"]), "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
dk AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM dp),
m AS (SELECT dk.doc_id, dk.n, dk.s, win.item_id FROM dk JOIN win ON dk.n = win.n AND dk.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM m GROUP BY doc_id),
dw AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d),
cf AS (SELECT term, count(*) AS c FROM dw GROUP BY term),
t AS (SELECT DISTINCT k, n, unnest(string_split(k, ' ')) AS term FROM win),
rare AS (SELECT k, n, list(term) AS terms, min({'c': coalesce(c, 0), 'term': term}) AS r FROM t LEFT JOIN cf USING (term) GROUP BY k, n),
place AS (SELECT dw.doc_id, dw.p, k, n, terms FROM rare JOIN dw ON dw.term = r.term WHERE r.c > 0),
near AS (SELECT DISTINCT place.doc_id, k, n FROM place JOIN d ON place.doc_id = d.doc_id WHERE list_has_all(list_slice(d.w, greatest(p - n - 1, 1), p + n + 1), terms)),
nn AS (SELECT near.doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN win ON near.k = win.k AND near.n = win.n GROUP BY near.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
coalesce(its.h, sha256('')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated, CAST(coalesce(nn.n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN nn ON d.doc_id = nn.doc_id
"""
