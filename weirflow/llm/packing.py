"""Lexical retrieval packing: each seed document's window is filled with its best unused neighbours by BM25.

The inverted index is sharded by content. A document's place is its leading terms, those of the highest BM25 weights by the
document frequencies and mean length of the whole corpus; documents lie in the order of (leading terms, doc_id), and each
stretch of about SHARD_TOKENS of it is a shard: documents that share their most telling terms are in one shard, however large
the corpus is, a hot term is split by those that follow it, and no document is left out. The next unused document of a shard
is the seed; it takes whole sequences as far as it goes, and what is left of the last one is given to the unused documents
of the shard that score best for the seed, each cut where the sequence ends. What is cut off stays unused. A shard's last
documents that would not fill a sequence go on to the next shard of the task, so padding is one sequence for each task.

fill() does the packing of one shard in one process.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as rg
from .shared import shared_path, small_batches
from .token_counts import vocabulary

LENGTH, END, MODEL = 2048, 1, "word_bpe_49k.json"
#: Tokens and documents of a shard at most (one document may be longer); bytes of text that a task of the second step takes.
SHARD_TOKENS, SHARD_DOCS, TASK_BYTES = 1 << 18, 4096, 32 << 20
LEADING = 4
K1, B = 1.2, 0.75
_encoders: dict = {}


class Postings:
    """Document, term and tf of each posting, by document and term; and each document's tokens."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray):
        self.doc, self.term, self.tf, self.sizes = doc, term, tf, sizes

    @classmethod
    def of(cls, ids: np.ndarray, sizes: np.ndarray) -> Postings:
        pairs = np.sort(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 16 | ids.astype(np.int64))
        new = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        return cls(pairs[new] >> 16, pairs[new] & 0xFFFF, np.diff(np.r_[new, len(pairs)]), sizes)

    @property
    def at(self) -> np.ndarray:
        """Where each document's postings begin."""
        return np.searchsorted(self.doc, np.arange(len(self.sizes) + 1))


class Statistics:
    """What BM25 takes from a whole corpus: document frequencies and the mean length."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        self.idf, self.mean = np.log1p((n - df + 0.5) / (df + 0.5)), max(1.0, tokens / max(1, n))

    @staticmethod
    def of(postings: Postings) -> Statistics:
        return Statistics(np.bincount(postings.term, minlength=1 << 16), len(postings.sizes), int(postings.sizes.sum()))

    def weights(self, p: Postings) -> np.ndarray:
        return self.idf[p.term] * p.tf * (K1 + 1) / (p.tf + K1 * (1 - B + B * p.sizes[p.doc] / self.mean))


class Index:
    """The inverted index of a shard: BM25 weights of its documents by term, and each document's terms."""

    def __init__(self, postings: Postings, statistics: Statistics):
        order = np.argsort(postings.term.astype(np.uint16), kind="stable")
        self.terms, self.term_at, self.n = postings.term, postings.at, len(postings.sizes)
        self.doc, self.weight = postings.doc[order].astype(np.int32), statistics.weights(postings)[order]
        self.at = np.r_[0, np.cumsum(np.bincount(postings.term, minlength=1 << 16))]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the terms of the seed."""
        terms = self.terms[self.term_at[seed] : self.term_at[seed + 1]]
        first, sizes = self.at[terms], self.at[terms + 1] - self.at[terms]
        places = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        return np.bincount(self.doc[places], self.weight[places], self.n)


def leading(postings: Postings, weights: np.ndarray, n: int = LEADING) -> np.ndarray:
    """The terms of the n highest weights of each document, the highest first, as one number; of equal weights the smaller term's."""
    out, left, at = np.zeros(len(postings.sizes), np.uint64), weights.copy(), postings.at
    some = np.flatnonzero(np.diff(at))
    for i in range(n):
        if not len(some):
            break
        top = np.maximum.reduceat(left, at[some])
        is_top = left == np.repeat(top, np.diff(at)[some])
        first = np.flatnonzero(is_top)
        first = first[np.r_[True, postings.doc[first[1:]] != postings.doc[first[:-1]]]]
        there = left[first] > 0
        out[some[there]] |= postings.term[first[there]].astype(np.uint64) << np.uint64(16 * (3 - i))
        left[first] = 0
    return out


def fill(index: Index, sizes: np.ndarray, used: np.ndarray, length: int = LENGTH, last: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, tokens), from the tokens that are not used yet; used is brought up to date.

    Unless it's the last shard, documents are left over as soon as all of them together would not fill a sequence.
    """
    free, out, left = used < sizes, [], int((sizes - used).sum())
    for seed in range(len(sizes)):
        while free[seed] and (last or left >= length):
            take = int(min(length, sizes[seed] - used[seed]))
            sequence, room = [(seed, int(used[seed]), take)], length - take
            used[seed] += take
            free[seed] = used[seed] < sizes[seed]
            if room:
                rank = np.where(free, index.scores(seed), -1.0)
                while room:
                    best = int(rank.argmax())
                    if rank[best] < 0:
                        break
                    take = int(min(room, sizes[best] - used[best]))
                    sequence.append((best, int(used[best]), take))
                    used[best] += take
                    room -= take
                    free[best] = used[best] < sizes[best]
                    rank[best] = -1.0
            left -= length - room
            out.append(sequence)
    return out


def _encoder(path: str | None):
    from .bpe import WordEncoder

    if path not in _encoders:
        _encoders[path] = WordEncoder(path or vocabulary(MODEL))
    return _encoders[path]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of numbers as bytes, one value a row."""
    offs = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * values.itemsize, out=offs[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of _lists()."""
    _, _, data, offs = next(rg.blocks(column, 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    return np.frombuffer(data.tobytes(), kind), np.diff(offs) // np.dtype(kind).itemsize


def _tokenised(path: str | None):
    """(doc_id, n, tokens, terms, tf): the ids of each text with the end mark, and its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in rg.blocks(batch.column(1), 2 << 20):
                words, n = _encoder(path).encode(data, offs)
                sizes = n + 1
                ids = np.full(len(words) + len(n), END, np.uint16)
                inner = np.ones(len(ids), bool)
                inner[np.cumsum(sizes) - 1] = False
                ids[inner] = words
                p = Postings.of(ids, sizes)
                terms = np.diff(p.at)
                columns = [batch.column(0).slice(a, b - a), pa.array(sizes), _lists(ids.astype("<u2"), sizes), _lists(p.term.astype("<u2"), terms), _lists(p.tf.astype("<i4"), terms)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "tokens", "terms", "tf"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << 16, np.int64)
    for batch in batches:
        df += np.bincount(_numbers(batch.column(0), "<u2")[0], minlength=1 << 16)
    some = df.nonzero()[0]
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "n"])


def _stored(n: np.ndarray, terms: pa.Array, tf: pa.Array) -> Postings:
    term, sizes = _numbers(terms, "<u2")
    return Postings(np.repeat(np.arange(len(n)), sizes), term.astype(np.int64), _numbers(tf, "<i4")[0].astype(np.int64), n)


def _keyed(statistics: Statistics):
    @F.pandas_udf("long")
    def key(n: pd.Series, terms: pd.Series, tf: pd.Series) -> pd.Series:
        p = _stored(n.to_numpy(), pa.array(terms, pa.binary()), pa.array(tf, pa.binary()))
        return pd.Series((leading(p, statistics.weights(p)) ^ np.uint64(1 << 63)).view(np.int64))

    return key


def _packed(statistics: Statistics, length: int, shard_tokens: int, with_ids: bool):
    """Takes rows in order, shard after shard, and gives pieces."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, held, used = TaskContext.get().partitionId() << 32, [], np.zeros(0, np.int64)

        def shard(last: bool) -> pa.RecordBatch:
            nonlocal sequence, held, used
            table = pa.Table.from_batches(held).combine_chunks()
            doc, n = table.column("doc_id").combine_chunks(), table.column("n").to_numpy()
            used = np.r_[used, np.zeros(len(n) - len(used), np.int64)]
            tokens, _ = _numbers(table.column("tokens").combine_chunks(), "<u2")
            wide, at = tokens.astype("<u4"), np.r_[0, np.cumsum(n)]
            found = fill(Index(_stored(n, *(table.column(c).combine_chunks() for c in ("terms", "tf"))), statistics), n, used, length, last)
            flat = np.array([(d, start, taken, sequence + k) for k, pieces in enumerate(found) for d, start, taken in pieces], np.int64).reshape(-1, 4)
            d, start, taken, of = flat.T
            crc = [zlib.crc32(wide[i:j]) for i, j in zip((at[d] + start).tolist(), (at[d] + start + taken).tolist(), strict=True)]
            ends = np.cumsum(taken)
            first = np.flatnonzero(np.diff(np.r_[-1, of]))
            offset = ends - taken - np.repeat((ends - taken)[first], np.diff(np.r_[first, len(of)]))
            columns = [doc.take(pa.array(d)), *(pa.array(x, pa.int64()) for x in (start, taken, np.array(crc, np.int64), n[d], of, offset))]
            if with_ids:
                places = np.repeat(at[d] + start - ends + taken, taken) + np.arange(taken.sum())
                columns.append(rg.flat_lists(tokens[places].astype(np.int32), taken, pa.int32()))
            sequence += len(found)
            rest = np.flatnonzero(used < n)
            held, used = table.take(pa.array(rest)).combine_chunks().to_batches(), used[rest]
            return pa.RecordBatch.from_arrays(columns, names)

        tokens = docs = 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            at = 0
            while at < len(n):
                fits = min(int(np.searchsorted(np.cumsum(n[at:]), shard_tokens - tokens, "right")), SHARD_DOCS - docs)
                if not docs:
                    fits = max(fits, 1)
                if fits:
                    held.append(batch.slice(at, fits))
                    tokens, docs, at = tokens + int(n[at : at + fits].sum()), docs + min(fits, len(n) - at), at + fits
                if at < len(n):
                    yield shard(False)
                    tokens = docs = 0
        if held:
            yield shard(True)

    return run


def pack(docs: DataFrame, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row for each piece.

    Null and empty texts are their end mark alone. Repeated rows are packed each; rows with a null doc_id come first among
    those of the same leading terms. Ties of scores go to what comes first. An empty table gives no piece; other columns are
    ignored. A text of any length is tokenised whole, by one task, which holds some twenty times its size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(spark)
    where = shared_path(spark, "packing-tokens")
    rows.mapInArrow(_tokenised(path), "doc_id long, n long, tokens binary, terms binary, tf binary").write.parquet(where)
    stored = spark.read.parquet(where)
    n, tokens = stored.agg(F.count(F.lit(1)), F.sum("n")).first()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    if not n:
        return spark.createDataFrame([], schema)
    df = np.zeros(1 << 16, np.int64)
    # A row for each term of the vocabulary at most.
    for r in stored.select("terms").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    statistics = Statistics(df, n, tokens)
    parts = -(-tokens // max(shard_tokens, TASK_BYTES // 4))
    keyed = stored.withColumn("key", _keyed(statistics)("n", "terms", "tf"))
    order = ["key", "doc_id", F.xxhash64("tokens")]
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "tokens").select("doc_id", "n", "tokens", "terms", "tf")
    return placed.mapInArrow(_packed(statistics, length, shard_tokens, with_ids), schema)
