"""Removal of repeated runs of words by a log-structured fingerprint index.

Every window of SPAN consecutive words has a fingerprint, the least hash of its runs of GRAM words; neighbouring
windows mostly share it, so a document has about one fingerprint for 21 words. Equal windows have equal
fingerprints. The index is a log of immutable runs of postings (fp, doc_id), each bucketed by fp and sorted. A batch of
documents is merge-joined with the runs, which need no exchange for it: fingerprints of the history, or of two documents
of the batch, are shared. The batch becomes a new run; when FAN_IN runs have gathered they are
compacted into one. Only windows under shared fingerprints are then verified, by two independent 64-bit hashes of their
full word sequence, and the least doc_id of each is the one that keeps its words.

A log stays in its folder and can be opened again for the next delivery (FingerprintLog(spark, path)); remove_repeats()
then judges the new documents against all earlier ones and reads again only those texts that share a fingerprint.

Whole copies within a delivery are settled before: of documents with the same word sequence (by SHA-256) only the least
doc_id enters the index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged as rg
from .shared import cut, folders, fresh, remove, shared_path, small_batches, spare

SPAN, GRAM = 50, 10
BATCHES, FAN_IN = 4, 3


class FingerprintLog:
    """Sorted immutable runs of postings (fp, doc_id) in the shared folder, bucketed by fp.

    A run's folder is run-<number>-<buckets>; it counts when it is complete, and a compacted run takes the place of all
    with smaller numbers. So opening a path again finds what earlier sessions have put there.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path or shared_path(spark, "fingerprints"), fan_in
        self.name = f"weirflow_log_{uuid.uuid4().hex}"
        self.runs: dict[int, str] = {}
        found = sorted((int(n.split("-")[1]), n) for n in folders(spark, self.path) if n.startswith("run-"))
        whole = [number for number, n in found if n.endswith("-whole")]
        for number, n in found:
            if not whole or number >= whole[-1]:
                self._table(number, int(n.split("-")[2]), n)

    def _table(self, number: int, buckets: int, folder: str) -> None:
        self.spark.sql(
            f"CREATE TABLE {self.name}_{number} (fp BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        self.runs[number] = folder

    def _write(self, postings: DataFrame, whole: bool = False) -> None:
        number, buckets = max(self.runs, default=0) + 1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folder = f"run-{number:06d}-{buckets}" + "-whole" * whole
        self._table(number, buckets, folder)
        postings.repartition(buckets, "fp").write.mode("append").insertInto(f"{self.name}_{number}")

    def _run(self, number: int) -> DataFrame:
        return self.spark.table(f"{self.name}_{number}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch (fp, doc_id); returns its shared fingerprints (fp): in the history, or in two documents of it."""
        history = list(self.runs)
        self._write(batch)
        own = self._run(max(self.runs))
        seen = own.groupBy("fp").agg((F.min("doc_id") < F.max("doc_id")).alias("shared"))
        for i, number in enumerate(history):
            old = self._run(number).groupBy("fp").agg(F.lit(True).alias(f"old{i}"))
            seen = seen.join(old.hint("merge"), "fp", "left").select("fp", (F.col("shared") | F.coalesce(f"old{i}", F.lit(False))).alias("shared"))
        shared = cut(seen.where("shared").select("fp"))
        if len(self.runs) >= self.fan_in:
            self.compact()
        return shared

    def postings(self, shared: DataFrame) -> DataFrame:
        """(fp, doc_id) of all documents under the fingerprints shared (fp, distinct)."""
        return reduce(DataFrame.unionByName, (self._run(n).join(shared.hint("merge"), "fp") for n in self.runs))

    def compact(self) -> None:
        """All runs into one; the old ones go when the new one is complete."""
        old = dict(self.runs)
        self._write(reduce(DataFrame.unionByName, (self._run(n) for n in old)), whole=True)
        for number in old:
            self._forget(number)

    def _forget(self, number: int) -> None:
        self.spark.sql(f"DROP TABLE {self.name}_{number}")
        remove(self.spark, f"{self.path}/{self.runs.pop(number)}")

    def close(self) -> None:
        """Lets the session forget the log; its files stay."""
        for number in self.runs:
            self.spark.sql(f"DROP TABLE {self.name}_{number}")
        self.runs = {}

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.path)


def _window_prints(hashes: np.ndarray, at: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of every window of span words."""
    n = len(hashes)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.arange(n) + span <= np.repeat(at[1:], np.diff(at)))
    return first, rg.sliding_min(rg.LANE_A.runs(hashes, gram), span - gram + 1)[first]


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int, first: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows of span words that begin at first."""
    return tuple(lane.runs(lane.words(data, starts, ends), span)[first] if len(starts) >= span else np.zeros(0, np.uint64) for lane in (rg.LANE_A, rg.LANE_B))


def _joined(raw: bytes, offs: np.ndarray, i: int) -> bytes:
    return b" ".join(raw[offs[i] : offs[i + 1]].split())


def halves(digests: list[bytes]) -> list[pa.Array]:
    """The first 128 bits of each digest as two columns."""
    both = np.frombuffer(b"".join(d[:16] for d in digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _features(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in rg.blocks(batch.column(1)):
                starts, ends, at = rg.words(data, offs)
                first, prints = _window_prints(rg.LANE_A.words(data, starts, ends), at, span, gram)
                cuts = np.searchsorted(first, at)
                fps = [np.unique(prints[cuts[i] : cuts[i + 1]]) for i in range(b - a)]
                raw = data.tobytes()
                sha = [hashlib.sha256(_joined(raw, offs, i)).digest() for i in range(b - a)]
                lists = rg.flat_lists(np.concatenate(fps).view(np.int64), np.array([len(x) for x in fps]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(at)), pa.array([x.hex() for x in sha]), *halves(sha), lists], ["doc_id", "text_hash", "n_words", "sha", "ca", "cb", "fps"])

    return run


def _verified(span: int, gram: int):
    """Both hashes of every window that has one of the row's shared fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for a, b, data, offs in rg.blocks(batch.column(1)):
                starts, ends, at = rg.words(data, offs)
                first, prints = _window_prints(rg.LANE_A.words(data, starts, ends), at, span, gram)
                cuts, keep = np.searchsorted(first, at), np.zeros(len(first), bool)
                for i in range(b - a):
                    keep[cuts[i] : cuts[i + 1]] = np.isin(prints[cuts[i] : cuts[i + 1]], lists[a + i].values.to_numpy().view(np.uint64))
                first = first[keep]
                one, two = _hashed(data, starts, ends, span, first)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(ids[a:b][np.searchsorted(at, first, side="right") - 1])], ["h1", "h2", "doc_id"])

    return run


def _removed(span: int, with_text: bool):
    """Cuts out the words under the row's windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for a, b, data, offs in rg.blocks(batch.column(1)):
                starts, ends, at = rg.words(data, offs)
                first, _ = _window_prints(starts.astype(np.uint64), at, span, span)
                one, two = _hashed(data, starts, ends, span, first)
                cuts, raw = np.searchsorted(first, at), data.tobytes()
                gone, texts, sha = np.zeros(b - a, np.int64), [], []
                for i in range(b - a):
                    own, late = slice(cuts[i], cuts[i + 1]), lists[a + i].values
                    h1, h2 = (late.field(j).to_numpy().view(np.uint64) for j in (0, 1))
                    order = np.argsort(h1)
                    place = np.minimum(np.searchsorted(h1[order], one[own]), len(h1) - 1)
                    hit = (h1[order][place] == one[own]) & (h2[order][place] == two[own])
                    mask = rg.covered(first[own][hit] - at[i], span, int(at[i + 1] - at[i]))
                    gone[i] = mask.sum()
                    sha.append(hashlib.sha256(_joined(raw, offs, i)).digest())
                    texts.append(b" ".join(compress(raw[offs[i] : offs[i + 1]].split(), (~mask).tolist())))
                out = [t.decode() for t in texts] if with_text else [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *halves(sha), pa.array(gone), pa.array(out, pa.string())], ["doc_id", "ca", "cb", "gone", "out"])

    return run


def shared_postings(features: DataFrame, log: FingerprintLog, batches: int = BATCHES) -> DataFrame:
    """Feeds the log batch after batch; the postings (fp, doc_id) of fingerprints that two or more documents have."""
    cuts = features.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    found, low = [], None
    for high in [*sorted(set(cuts)), None]:
        part = features if low is None else features.where(F.col("doc_id") > low)
        part, low = part if high is None else part.where(F.col("doc_id") <= high), high
        found.append(log.add(part.select(F.explode("fps").alias("fp"), "doc_id")))
    return log.postings(reduce(DataFrame.unionByName, found).distinct())


def _plan(rows: DataFrame, span: int, gram: int, log: FingerprintLog | None, earlier: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of all rows; the first document of each word sequence that recurs; windows to remove, by document."""
    spark = rows.sparkSession
    small_batches(spark)
    features = cut(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_features(span, gram), "doc_id long, text_hash long, n_words long, sha string, ca long, cb long, fps array<long>"))
    usable = features.where(f"n_words >= {span} and doc_id is not null")
    classes = cut(usable.groupBy("ca", "cb").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.any_value("fps").alias("fps")))
    own = log or FingerprintLog(spark)
    wanted = cut(shared_postings(classes.select(F.col("first").alias("doc_id"), "fps"), own).groupBy("doc_id").agg(F.collect_set("fp").alias("fps")))
    if log is None:
        own.drop()
    texts = rows if earlier is None else rows.unionByName(earlier)
    windows = texts.join(wanted, "doc_id").select("doc_id", "text", "fps").mapInArrow(_verified(span, gram), "h1 long, h2 long, doc_id long")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    late = windows.join(fresh(least, "h1", "h2"), ["h1", "h2"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("late"))
    return features, classes.where("first < last").select("ca", "cb", "first"), late


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def remove_repeats(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", log: FingerprintLog | None = None, earlier: DataFrame | None = None
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of docs.

    A word goes if a window of span words over it also starts in a document with a smaller doc_id; windows are judged
    on the input. Words are what stands between U+0020 and U+0009..U+000D. Null and empty texts have no words. Rows
    with a null doc_id neither lose words nor cause a loss; rows of one doc_id don't affect each other. Other columns are
    ignored. An empty table gives an empty result. A text of any length is taken whole, by one task, which holds some
    twenty times its size.

    With a log, docs is a further delivery: it's judged against the earlier documents too (the table of all that the log
    has taken), and the log takes it. Earlier documents are not judged anew. The caller drops or closes the log after
    the result has been used.
    """
    rows = _rows(docs, id_col, text_col)
    features, copied, late = _plan(rows, span, gram, log, None if earlier is None else _rows(earlier, id_col, text_col))
    changed = rows.join(late, "doc_id").mapInArrow(_removed(span, False), "doc_id long, ca long, cb long, gone long, out string").distinct()
    out = features.drop("fps").join(changed, ["doc_id", "ca", "cb"], "left").join(fresh(copied, "ca", "cb"), ["ca", "cb"], "left")
    copy = F.col("doc_id") > F.col("first")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("out", "sha")).alias("kept_sha256"),
    )


def cut_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs, same columns, without the repeated words; texts that lose none stay as they are, documents that lose all go.

    A changed text is its kept words joined by one space, and n_chars, where there is one, follows it. Null and empty
    texts, rows with a null doc_id and rows of one doc_id are as in remove_repeats(); an empty table stays empty.
    """
    features, copied, late = _plan(_rows(docs, "doc_id", "text"), span, gram, None, None)
    copies = features.where("doc_id is not null").join(fresh(copied, "ca", "cb"), ["ca", "cb"]).where("doc_id > first")
    cut_, copy = spare(docs, "late"), spare(docs, "copy")
    late = late.select(F.col("doc_id").alias("doc_id_"), F.col("late").alias(cut_))
    copies = copies.groupBy(F.col("doc_id").alias("doc_id_")).agg(F.collect_set("text_hash").alias(copy))
    # Both joins are on doc_id, so docs is dealt once; of rows that share a doc_id each is judged by its own text.
    kept = docs.join(copies, docs["doc_id"] == copies["doc_id_"], "left").drop(copies["doc_id_"])
    kept = kept.where(F.col(copy).isNull() | ~F.array_contains(copy, F.xxhash64("text"))).drop(copy)
    kept = kept.join(late, kept["doc_id"] == late["doc_id_"], "left").drop(late["doc_id_"])
    names, at_text = docs.columns, docs.columns.index("text")
    at_size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = _removed(span, True)
        for batch in batches:
            lists = batch.column(len(names))
            same = batch.filter(lists.is_null())
            if len(same):
                yield same.select(names)
            some = batch.filter(lists.is_valid())
            if not len(some):
                continue
            core = pa.RecordBatch.from_arrays([pa.array(np.arange(len(some))), some.column(at_text), some.column(len(names))], ["i", "text", "late"])
            texts = pa.concat_arrays([part.column(4) for part in inner(iter([core]))])
            columns = [some.column(i) for i in range(len(names))]
            columns[at_text] = texts
            if at_size is not None:
                columns[at_size] = pc.utf8_length(texts).cast(columns[at_size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=some.select(names).schema).filter(pc.not_equal(texts, ""))

    return kept.select(*names, cut_).mapInArrow(run, docs.schema)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
late AS (SELECT doc_id, s FROM win JOIN (SELECT k, min(doc_id) AS least FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)) USING (k) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM late),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
