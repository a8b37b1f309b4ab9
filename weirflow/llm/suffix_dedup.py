"""Removal of repeated byte strings by suffix sorting, deep-shallow, of what can be repeated at all.

Every SPAN bytes have a fingerprint, the least hash of their runs of GRAM bytes, which neighbouring starts mostly share.
Only starts under a fingerprint that two documents have are candidates; they go, as short segments, to the partition of
their fingerprint, where equal strings meet. There the suffixes at the starts are sorted: multikey quicksort, by
characters of eight bytes, down to the shallow depth; then each group with a longer common prefix is ordered by a blind
trie, which looks at branching characters alone. Suffixes that stay together over SPAN bytes are equal, and their least
doc_id keeps its bytes. Both work on whole arrays: a step takes all groups of a block further at once.

Whole copies (by SHA-256) are settled before, and equal segments are aggregated before they are sent, so a passage that
many documents share is sorted once. A fingerprint of over HOT segments may still have any number of unlike ones (a
common line of fewer than SPAN bytes): those are dealt by themselves, and their strings are settled by an aggregate and
a join on a digest of each, which tasks can share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as rg
from .shared import cut, fresh, release, remove, shared_path, small_batches
from .substring_dedup import halves

SPAN, GRAM = 50, 16
#: Starts in a segment at most, so that a mask of them is a long; bytes of segments sorted at once.
STARTS, SORT_BYTES = 62, 4 << 20
SHALLOW = 2  # characters of eight bytes
#: A fingerprint of more documents is not sorted in one task.
HOT = 50_000


# Sorting -----------------------------------------------------------------------------------------------------------


def _characters(text: np.ndarray, starts: np.ndarray, span: int) -> list[np.ndarray]:
    """The span bytes from each start as big-endian characters of eight bytes; the last one is cut to what is left."""
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    at = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        at |= padded[i : i + len(at)] << np.uint64(56 - 8 * i)
    out = [at[starts + i] for i in range(0, span, 8)]
    if span % 8:
        out[-1] &= np.uint64((1 << 64) - (1 << 64 - 8 * (span % 8)))
    return out


def suffix_classes(text: np.ndarray, starts: np.ndarray, span: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): the starts in the order of their span bytes, and where in that order a new string begins.

    groups, ascending, are parts that are sorted each by itself.
    """
    chars = np.stack(_characters(text, starts, span))
    n = len(starts)
    head = np.zeros(n, bool)
    head[:1] = True
    if groups is not None:
        head[1:] = groups[1:] != groups[:-1]
    order = np.arange(n)
    quicksort(chars[:SHALLOW], order, head)
    BlindTries(chars, order, head).sort()
    return order, head


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... size[i] places of each i."""
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _parts(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of the groups of more than one."""
    first = np.flatnonzero(head)
    size = np.diff(np.r_[first, len(head)])
    return first[size > 1], size[size > 1]


def quicksort(chars: np.ndarray, order: np.ndarray, head: np.ndarray) -> None:
    """Multikey quicksort of each group of order by all the rows of chars, in place; head marks the groups that come of it.

    In a step each group is parted by a pivot's character into smaller, equal and larger ones; equal ones go on with the
    next character.
    """
    first, size = _parts(head)
    depth, step = np.zeros(len(first), np.int64), 0
    while len(first):
        step += 1
        at = _ranges(first, size)
        own, group = order[at], np.repeat(np.arange(len(first)), size)
        key = chars[depth[group], own]
        pivot = key[np.cumsum(size) - size + (rg.mix(first.astype(np.uint64) + np.uint64(step)) % size.astype(np.uint64)).astype(np.int64)]
        side = (key > pivot[group]).astype(np.int8) + (key >= pivot[group])
        cell = group * 3 + side
        count = np.bincount(cell, minlength=3 * len(first))
        place = np.repeat(first, 3) + (np.cumsum(count.reshape(-1, 3), 1) - count.reshape(-1, 3)).ravel()
        for s in range(3):
            mine = side == s
            rank = np.cumsum(mine)
            before = np.r_[0, rank][np.cumsum(size) - size]
            order[place[cell[mine]] + (rank - 1 - before[group])[mine]] = own[mine]
        head[place[count > 0]] = True
        deeper = np.repeat(depth, 3)
        deeper[1::3] += 1
        go = (count > 1) & (deeper < len(chars))
        first, size, depth = place[go], count[go], deeper[go]


class BlindTries:
    """A blind trie for each group of order, all of whose suffixes have the same first SHALLOW characters.

    A node knows its suffixes (a run of order), and the place where they branch: the first at which one differs from the
    node's leader. Its children, in order, are the distinct characters there; what lies between two branching places is
    never looked at again. Leaves, left to right, are the classes of equal suffixes in order.
    """

    def __init__(self, chars: np.ndarray, order: np.ndarray, head: np.ndarray):
        self.chars, self.order, self.head = chars, order, head
        self.first, self.size = _parts(head)
        self.nodes = 0

    def _branching(self) -> np.ndarray:
        """Where each open node branches; past the end if its suffixes are equal."""
        own, lead = self.order[_ranges(self.first, self.size)], np.repeat(self.order[self.first], self.size)
        place = np.full(len(own), len(self.chars), np.int8)
        for i in range(len(self.chars) - 1, SHALLOW - 1, -1):
            place[self.chars[i][own] != self.chars[i][lead]] = i
        return np.minimum.reduceat(place, np.cumsum(self.size) - self.size)

    def sort(self) -> None:
        while len(self.first):
            self.nodes += len(self.first)
            branch = self._branching()
            inner = branch < len(self.chars)
            self.first, self.size, branch = self.first[inner], self.size[inner], branch[inner]
            if not len(self.first):
                return
            at = _ranges(self.first, self.size)
            own, node = self.order[at], np.repeat(np.arange(len(self.first)), self.size)
            char = self.chars[branch[node], own]
            rank = np.lexsort((char, node))
            self.order[at], char = own[rank], char[rank]
            child = np.r_[True, (node[1:] != node[:-1]) | (char[1:] != char[:-1])]
            self.head[at[child]] = True
            size = np.diff(np.r_[np.flatnonzero(child), len(at)])
            self.first, self.size = at[child][size > 1], size[size > 1]


# Candidates --------------------------------------------------------------------------------------------------------


def _runs(data: np.ndarray, offs: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts under one fingerprint: first start, number of starts, fingerprint, row."""
    n = len(data)
    if n < span:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    eight, lane = rg.eights(data), rg.LANE_A
    full = np.zeros(n - gram + 1, np.uint64)
    for i in [*range(0, gram - 8, 8), gram - 8]:
        full = rg.mix((full ^ eight[i : i + len(full)]) * np.uint64(lane.a))
    first = np.flatnonzero(np.arange(n) + span <= np.repeat(offs[1:], np.diff(offs)))
    prints = rg.sliding_min(full, span - gram + 1)[first]
    if not len(first):
        return first, first, prints, first
    new = np.flatnonzero(np.r_[True, (prints[1:] != prints[:-1]) | (np.diff(first) != 1)])
    starts, sizes, prints = first[new], np.diff(np.r_[new, len(first)]), prints[new]
    if (sizes > STARTS).any():
        parts = -(-sizes // STARTS)
        step = np.arange(parts.sum()) - np.repeat(np.r_[0, np.cumsum(parts)[:-1]], parts)
        starts, left, prints = np.repeat(starts, parts) + step * STARTS, np.repeat(sizes, parts) - step * STARTS, np.repeat(prints, parts)
        sizes = np.minimum(left, STARTS)
    return starts, sizes, prints, np.searchsorted(offs, starts, side="right") - 1


def _sha(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [hashlib.sha256(raw[offs[i] : offs[i + 1]]).digest() for i in range(len(offs) - 1)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in rg.blocks(batch.column(1)):
            sha = _sha(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offs)), pa.array([x.hex() for x in sha], pa.string()), *halves(sha)], ["doc_id", "n_bytes", "sha", "ca", "cb"])


def _prints(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offs in rg.blocks(batch.column(1)):
                _, _, prints, row = _runs(data, offs, span, gram)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(ids[a:b][row])], ["fp", "doc_id"])

    return run


def _segments(span: int, gram: int):
    """The segments under the row's shared fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, hots = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            for a, b, data, offs in rg.blocks(batch.column(1)):
                starts, sizes, prints, row = _runs(data, offs, span, gram)
                cuts, keep, hot = np.searchsorted(row, np.arange(b - a + 1)), np.zeros(len(row), bool), np.zeros(len(row), bool)
                for i in range(b - a):
                    own = prints[cuts[i] : cuts[i + 1]]
                    keep[cuts[i] : cuts[i + 1]] = np.isin(own, lists[a + i].values.to_numpy().view(np.uint64))
                    if len(hots[a + i].values):
                        hot[cuts[i] : cuts[i + 1]] = np.isin(own, hots[a + i].values.to_numpy().view(np.uint64))
                starts, sizes, prints, row, hot = starts[keep], sizes[keep], prints[keep], row[keep], hot[keep]
                length = sizes + span - 1
                at = np.r_[0, np.cumsum(length)]
                flat = data[np.repeat(starts - at[:-1], length) + np.arange(at[-1])]
                seg = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
                ca = halves(_sha(data, offs))[0].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(hot), seg, pa.array(ids[a:b][row]), pa.array(ca[row]), pa.array((starts - offs[row]).astype(np.int32)), pa.array(sizes.astype(np.int32))], ["fp", "hot", "seg", "doc_id", "ca", "start", "n"])

    return run


def _key(column: str) -> F.Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


_SEEN = ["key", "first", "mask", "string"]


def _first_seen(span: int):
    """For each segment (fp, seg, doc_id, hot, key) the mask of its starts whose string a smaller doc_id has; rows come
    sorted by fp. A hot segment's starts are rows of their own instead, a mask of one bit and the string."""

    def placed(table: pa.Table) -> tuple[np.ndarray, ...]:
        _, _, data, at = next(rg.blocks(table.column("seg").combine_chunks(), 1 << 62))
        sizes = np.diff(at) - span + 1
        within = np.arange(sizes.sum()) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        return data, np.repeat(at[:-1], sizes) + within, within, np.repeat(np.arange(len(sizes)), sizes)

    def solve(table: pa.Table) -> pa.RecordBatch:
        doc, fp = table.column("doc_id").to_numpy(), table.column("fp").to_numpy()
        data, starts, within, owner = placed(table)
        order, head = suffix_classes(data, starts, span, fp[owner])
        first = np.minimum.reduceat(doc[owner[order]], np.flatnonzero(head))
        late = np.zeros(len(starts), bool)
        late[order] = first[np.cumsum(head) - 1] < doc[owner[order]]
        mask = np.zeros(len(doc), np.int64)
        np.bitwise_or.at(mask, owner[late], np.int64(1) << within[late])
        return pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), pa.array(doc), pa.array(mask), pa.nulls(len(doc), pa.binary())], _SEEN)

    def spread(table: pa.Table) -> pa.RecordBatch:
        data, starts, within, owner = placed(table)
        flat = data[(starts[:, None] + np.arange(span)).ravel()]
        strings = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.arange(0, len(flat) + 1, span, np.int32)), pa.py_buffer(flat)])
        key = table.column("key").combine_chunks().take(pa.array(owner))
        return pa.RecordBatch.from_arrays([key, pa.array(table.column("doc_id").to_numpy()[owner]), pa.array(np.int64(1) << within), strings], _SEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            hot = batch.filter(batch.column(3))
            for i in range(0, len(hot), 4096):
                yield spread(pa.Table.from_batches([hot.slice(i, 4096)]))
            batch = batch.filter(pc.invert(batch.column(3)))
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.nbytes for x in held) < SORT_BYTES:
                continue
            table = pa.Table.from_batches(held)
            fp = table.column("fp").to_numpy()
            end = int(np.flatnonzero(fp != fp[-1])[-1]) + 1 if fp[0] != fp[-1] else 0
            if end:
                yield solve(table.slice(0, end))
            held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _apply(span: int):
    """Takes the bytes under the row's marked starts out; marks of another text with the row's doc_id are not its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, of = batch.column(2), batch.column(3).to_numpy()
            for a, b, data, offs in rg.blocks(batch.column(1)):
                whole = halves(_sha(data, offs))
                ca = whole[0].to_numpy()
                gone, spans, sha = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), []
                for i in range(b - a):
                    text = data[offs[i] : offs[i + 1]]
                    if of[a + i] == ca[i]:
                        own = marks[a + i].values
                        start, n, mask = (own.field(j).to_numpy().astype(np.int64) for j in range(3))
                        row = np.repeat(np.arange(len(n)), n)
                        step = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
                        hit = mask[row] >> step & 1 == 1
                        cover = rg.covered((start[row] + step)[hit], span, len(text))
                        gone[i], spans[i] = cover.sum(), (np.diff(np.r_[0, cover.astype(np.int8)]) == 1).sum()
                        text = text[~cover]
                    sha.append(hashlib.sha256(text.tobytes()).hexdigest())
                own = of[a:b] == ca
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *whole, pa.array(gone), pa.array(spans), pa.array(sha, pa.string())], ["doc_id", "ca", "cb", "gone", "spans", "out"]).filter(pa.array(own))

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs.

    A byte of the UTF-8 text goes if a string of span bytes over it also starts in a document with a smaller doc_id;
    strings are judged on the input and lie inside one document. Null is empty. Rows with a null doc_id neither lose
    bytes nor cause a loss; rows of one doc_id don't affect each other. Other columns are ignored. An empty table gives an
    empty result. A text of any length is taken whole, by one task, which holds some thirty times its size. span is gram
    at least, and gram eight.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    features = cut(rows.mapInArrow(_features, "doc_id long, n_bytes long, sha string, ca long, cb long"))
    classes = features.where(f"n_bytes >= {span} and doc_id is not null").groupBy("ca", "cb").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    classes = cut(classes)
    firsts = rows.join(classes.select(F.col("first").alias("doc_id")).distinct(), "doc_id")
    # One exchange of fingerprints serves both the aggregate and the join.
    prints = firsts.mapInArrow(_prints(span, gram), "fp long, doc_id long").repartition("fp")
    shared = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("fp", F.when(F.col("n") > hot, F.col("fp")).alias("hot"))
    wanted = cut(prints.join(shared, "fp").groupBy("doc_id").agg(F.collect_set("fp").alias("fps"), F.collect_set("hot").alias("hots")))
    del prints, shared
    release(docs.sparkSession)
    segments = firsts.join(wanted, "doc_id").select("doc_id", "text", "fps", "hots").mapInArrow(_segments(span, gram), "fp long, hot boolean, seg binary, doc_id long, ca long, start int, n int")
    # Equal segments come together in a table, so that the exchange of texts can go before segments are dealt anew.
    path = shared_path(docs.sparkSession, "segments")
    segments.groupBy("fp", "hot", "seg").agg(F.min("doc_id").alias("doc_id")).write.parquet(path)
    release(docs.sparkSession)
    distinct = docs.sparkSession.read.parquet(path)
    distinct = distinct.repartition(F.when(F.col("hot"), F.xxhash64("seg")).otherwise(F.col("fp"))).sortWithinPartitions("fp")
    seen = cut(distinct.select("fp", "seg", "doc_id", "hot", _key("seg").alias("key")).mapInArrow(_first_seen(span), "key binary, first long, mask long, string binary"))
    del distinct
    remove(docs.sparkSession, path)
    release(docs.sparkSession)
    strings = seen.where("string is not null").withColumn("string", _key("string"))
    least = strings.groupBy("string").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").select("string", "least")
    own = least.select(F.concat("string").alias("string"), "least")  # a new column to Spark, so the join has an exchange that can be split
    of_hot = strings.join(own, "string", "left").groupBy("key").agg(F.min("first").alias("first"), F.bit_or(F.when(F.col("first") > F.col("least"), F.col("mask")).otherwise(F.lit(0))).alias("mask"))
    seen = seen.where("string is null").select("key", "first", "mask").unionByName(of_hot)
    keyed = segments.select("doc_id", "ca", "start", "n", _key("seg").alias("key"))
    marked = keyed.join(seen, "key").withColumn("mask", F.when(F.col("doc_id") > F.col("first"), F.lit(-1)).otherwise(F.col("mask"))).where("mask != 0")
    late = marked.groupBy("doc_id", "ca").agg(F.collect_list(F.struct("start", "n", "mask")).alias("marks")).withColumnRenamed("ca", "of")
    changed = rows.join(late, "doc_id").select("doc_id", "text", "marks", "of").mapInArrow(_apply(span), "doc_id long, ca long, cb long, gone long, spans long, out string").distinct()
    copied = classes.where("first < last").select("ca", "cb", "first")
    out = features.join(changed, ["doc_id", "ca", "cb"], "left").join(fresh(copied, "ca", "cb"), ["ca", "cb"], "left")
    copy = F.col("doc_id") > F.col("first")
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("out", "sha")).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, s, b[s:s + 49] AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS s FROM d WHERE octet_length(b) >= 50)),
late AS (SELECT doc_id, s FROM win JOIN (SELECT k, min(doc_id) AS least FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)) USING (k) WHERE doc_id > least),
jump AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50, true) AS fresh FROM late),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS z FROM (SELECT doc_id, s, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM jump) GROUP BY doc_id, run),
n AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS gone FROM runs GROUP BY doc_id),
ends AS (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) + 1 FROM d),
parts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 1) AS first, a - 1 AS last FROM ends),
kept AS (SELECT doc_id, string_agg(hex(b[first:last]), '' ORDER BY first) AS h FROM parts JOIN d USING (doc_id) WHERE last >= first GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
