"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every element of a set is thrown into a random one of T bins with a value that grows with
i; from round T on, round i serves bin i - T alone, so that every bin is filled after 2T rounds at most. A set of
well over T elements fills all bins in the first round or two. Each bin keeps its least value; two sets agree in
a bin with probability equal to their Jaccard similarity, with concentration as for independent MinHash.

Links are exact: candidates come from bands of bins (at a similarity of 0.8, 32 bands of 4; a pair is missed with
probability (1 - 0.8**4)**32 = 5e-8, and with MISSED at most for other thresholds) and are confirmed on the full shingle sets. Sets that are equal form one
node. In a bucket each node is first compared with one centre, the node that shares most buckets; what these
comparisons tie together but leave in different components is then compared exactly, block by block, after nodes
that have too few shingles in common with any other have left; large clusters are parted by rare shingles before. So no
cap is needed, no pair but a link becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as rg
from .shared import components, cut, fresh, release, small_batches

BINS, ROWS = 128, (4, 2, 1)
#: Chance that a pair at the threshold shares no band, at most.
MISSED = 1e-6
#: Nodes in a block when components are compared.
BLOCK_FEW, BLOCK_ALL = 256, 2048
#: Blocks of a cluster at most that is compared as it is; pairs that one copy of their centre's text serves.
BLOCKS, CHUNK = 4, 1000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ROUND = np.arange(1, 2 * 4096 + 1, dtype=np.uint64) * _GOLD
_EMPTY = np.uint64((1 << 64) - 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as sorted 64-bit hashes, with row offsets.

    Words are split at U+0020 and U+0009..U+000D after lower-casing A-Z; fewer than k words are one shingle.
    """
    low = rg.ascii_lower(data)
    starts, ends, at = rg.words(low, offs)
    hashes = rg.LANE_A.words(low, starts, ends)
    first, values = rg.windows(rg.LANE_A, hashes, at, k)
    cuts = np.searchsorted(first, at)
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k))
    whole = [int.from_bytes(rg.LANE_A.digest(hashes[at[i] : at[i + 1]], 8), "little") for i in short.tolist()]
    few, sets, sizes = dict(zip(short.tolist(), whole, strict=True)), [], np.zeros(len(offs), np.int64)
    for i in range(len(offs) - 1):
        s = np.unique(values[cuts[i] : cuts[i + 1]]) if i not in few else np.array([few[i]], np.uint64)
        sets.append(s)
        sizes[i + 1] = len(s)
    return np.concatenate(sets) if sets else values, np.cumsum(sizes)


def sketch(values: np.ndarray, at: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of each row of the ragged sets: (rows, bins); empty sets stay unfilled."""
    n, shift = len(at) - 1, np.uint64(64 - (bins.bit_length() - 1))
    out = np.full(n * bins, _EMPTY, np.uint64)
    rows = np.repeat(np.arange(n), np.diff(at))
    for i in range(2 * bins):
        if not len(rows):
            break
        x = rg.mix(values + _ROUND[i])
        place = rows * bins + ((x >> shift).astype(np.int64) if i < bins else i - bins)
        np.minimum.at(out, place, (np.uint64(i) << np.uint64(55)) | (x & np.uint64((1 << 55) - 1)))
        if i < 4 or i % 8 == 7:
            full = (out.reshape(n, bins) != _EMPTY).all(1)
            left = ~full[rows]
            if not left.all():
                values, rows = values[left], rows[left]
    return out.reshape(n, bins)


def rows_for(percent: int) -> int:
    """Bins of a band: the most that keep what is missed under MISSED."""
    for rows in ROWS:
        if (1 - (percent / 100) ** rows) ** (BINS // rows) <= MISSED:
            return rows
    raise ValueError(f"{BINS} bins don't find pairs of a similarity of {percent} percent")


def band_keys(sketches: np.ndarray, rows: int = 4) -> np.ndarray:
    """One 64-bit key for each band of each sketch; the band's number is part of the key."""
    n, bins = sketches.shape
    parts = sketches.reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(1, bins // rows + 1, dtype=np.uint64) * _GOLD, parts.shape[:2])
    for r in range(rows):
        key = rg.mix(key ^ parts[:, :, r])
    return key


def _digests(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits for each sorted set, as two integers."""
    found = b"".join(rg.LANE_B.digest(values[at[i] : at[i + 1]]) for i in range(len(at) - 1))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _features(k: int, rows: int):
    bands = BINS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in rg.blocks(batch.column(1)):
                values, at = shingle_sets(data, offs, k)
                sizes = np.diff(at)
                keys = band_keys(sketch(values, at), rows).view(np.int64)
                some = sizes > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sizes), *(pa.array(x) for x in _digests(values, at).T.copy()), rg.flat_lists(keys[some].ravel(), some * bands, pa.int64())],
                    ["doc_id", "text_hash", "n_shingles", "ca", "cb", "bands"],
                )

    return run


def _verify(k: int, percent: int):
    """Rows (u, v, chunk, text) come by v and chunk, the centre's first, with u null; a pair is linked or not by its full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            is_centre, ok = batch.column(0).is_null().to_numpy(zero_copy_only=False), np.zeros(len(batch), bool)
            for a, b, data, offs in rg.blocks(batch.column(3)):
                values, at = shingle_sets(data, offs, k)
                for i in range(a, b):
                    x = values[at[i - a] : at[i - a + 1]]
                    if is_centre[i]:
                        centre = x
                    elif 100 * min(len(x), len(centre)) >= percent * max(len(x), len(centre)):
                        both = len(np.intersect1d(x, centre, assume_unique=True))
                        ok[i] = 100 * both >= percent * (len(x) + len(centre) - both)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    return run


def _same_set(k: int):
    """Keep the texts whose set is the node's: rows that share a doc_id may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in rg.blocks(batch.column(1)):
                found = _digests(*shingle_sets(data, offs, k))
                part = batch.slice(a, b - a)
                same = (found[:, 0] == part.column(2).to_numpy()) & (found[:, 1] == part.column(3).to_numpy())
                yield part.select(["node", "text"]).filter(pa.array(same))

    return run


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for a, b, data, offs in rg.blocks(batch.column(1)):
                values, at = shingle_sets(data, offs, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[a:b], np.diff(at))), pa.array(values.view(np.int64))], ["node", "s"])

    return run


def _with_bounds(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """open_ without the nodes that can't have a link: less than percent of their shingles are in another node of open_.

    Twice, as what a leaving node alone shared with one other then counts no more.
    """
    for _ in range(2):
        sets = texts.join(open_.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_shingles(k), "node long, s long")
        common = sets.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("s")
        held = sets.join(fresh(common, "s"), "s").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
        open_ = cut(open_.join(held, "node").where(f"100 * common >= {percent} * n").drop("common"))
    return open_


def _links_of_block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        node, part, few = (table.column(c).to_numpy() for c in ("node", "component", "few"))
        lists = table.column("set").combine_chunks()
        at, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        sizes = np.diff(at)
        names, ids = np.unique(values, return_inverse=True)
        left, right = np.flatnonzero(few), np.flatnonzero(~few)
        there = np.zeros(len(names), np.int32)
        flat = np.concatenate([ids[at[j] : at[j + 1]] for j in right]) if len(right) else ids[:0]
        edges = np.r_[0, np.cumsum(sizes[right])]
        u, v = [], []
        for i in left if len(right) else ():
            own = ids[at[i] : at[i + 1]]
            there[own] = 1
            both = np.add.reduceat(there[flat], edges[:-1])
            there[own] = 0
            hit = right[(100 * both >= percent * (sizes[i] + sizes[right] - both)) & (part[right] != part[i])]
            u.append(np.repeat(node[i], len(hit)))
            v.append(node[hit])
        return pa.table({"u": np.concatenate(u) if u else node[:0], "v": np.concatenate(v) if v else node[:0]})

    return run


def _by_prefix(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """open_ with a row for each shingle s of a node's prefix: its rarest shingles, as many as leave less than percent of the
    set. Two linked nodes have one of them in common; what a whole cluster shares is common and comes last."""
    held = texts.join(open_.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_shingles(k), "node long, s long")
    df = held.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    sets = held.join(fresh(df, "s"), "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))
    n = F.size("all")
    rare = sets.select("node", F.explode(F.slice("all", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)).alias("r")).where("r.df > 1").select("node", "r.s")
    return open_.drop("s").join(rare, "node")


def _across(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components of one cluster, exactly: its nodes outside the largest component against all.

    A cluster of more than BLOCKS blocks is parted first, into the nodes that share a shingle of their prefixes: so work
    does not grow with the square of a cluster, but with those of its rare shingles. Both sides of a part are dealt into
    blocks of bounded size and each pair of blocks is one group's work on whole sets; a pair of nodes is never a row
    unless it is a link.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in rg.blocks(batch.column(1)):
                values, at = shingle_sets(data, offs, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rg.flat_lists(values.view(np.int64), np.diff(at), pa.int64())], ["node", "set"])

    few = F.col("component") != F.col("largest")
    part = ["cluster", "s"]

    def counted(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(*part).agg(F.sum(few.cast("long")).alias("a"), F.count(F.lit(1)).alias("b"), F.min("component").alias("low"), F.max("component").alias("high"))
        return counts.where("a > 0 and low < high").select(*part, F.ceil(F.col("a") / BLOCK_FEW).alias("a"), F.ceil(F.col("b") / BLOCK_ALL).alias("b"))

    open_ = open_.withColumn("s", F.lit(0).cast("long"))
    counts = cut(counted(open_))
    big = counts.where(F.col("a") * F.col("b") > BLOCKS)
    rows = open_.join(fresh(counts.where(F.col("a") * F.col("b") <= BLOCKS), *part), part)
    if not big.isEmpty():
        parted = cut(_by_prefix(open_.join(fresh(big.select("cluster"), "cluster"), "cluster", "left_semi"), texts, k, percent))
        rows = rows.unionByName(parted.join(fresh(counted(parted), *part), part))
    held = texts.join(open_.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(sets, "node long, set array<long>")
    rows = rows.select("node", *part, "component", few.alias("few"), "a", "b").join(held, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    left = rows.where("few").withColumns({"x": own("a"), "y": F.explode(F.sequence(F.lit(0), F.col("b") - 1))})
    right = rows.withColumns({"few": F.lit(False), "y": own("b"), "x": F.explode(F.sequence(F.lit(0), F.col("a") - 1))})
    both = left.unionByName(right).select(*part, "x", "y", "node", "component", "few", "set")
    return both.groupBy(*part, "x", "y").applyInArrow(_links_of_block(percent), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Rows whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id that links reach. Null or wordless texts have no shingle and are linked with nothing; their component
    is their own doc_id. A row with a null doc_id takes part with a null component and is kept. Repeated rows are in
    one component and get one row each. An empty table gives an empty result; other columns are ignored. percent is 11 at
    least. A text of any length is taken whole, by one task, which holds some twenty times its size.
    """
    return _grouped(docs, k, percent, id_col, text_col).drop("text_hash")


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates() with a hash of each row's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    features = cut(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_features(k, rows_for(percent)), "doc_id long, text_hash long, n_shingles long, ca long, cb long, bands array<long>"))
    known = features.where("n_shingles > 0 and doc_id is not null")
    # A node is a number of its own, given to each distinct set; a hash of 64 bits might stand for two of them.
    nodes = known.groupBy("ca", "cb").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.min("n_shingles").alias("n"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    members = nodes.select("node", "rep", F.explode("bands").alias("band"))
    shared = members.select("band").groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(members.join(shared, "band"))
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    centre = members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", (-F.col("rep")).alias("first"), F.col("node").alias("v"))).alias("c")).select("band", "c.v")
    tried = cut(members.join(centre, "band").where("node != v").select(F.col("node").alias("u"), "v").distinct())
    involved = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "rep", "ca", "cb")
    texts = rows.join(involved, F.col("doc_id") == F.col("rep")).select("node", "text", "ca", "cb").mapInArrow(_same_set(k), "node long, text string")
    texts = cut(texts.dropDuplicates(["node"]) if _repeats(rows) else texts)
    del members, shared, degree, centre, involved
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """A centre's pairs are dealt into chunks, and its text goes to each chunk once."""
        chunks = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("m"))
        pairs = pairs.join(fresh(chunks, "v"), "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("m")).alias("chunk"))
        own = pairs.join(texts.withColumnRenamed("node", "u"), "u").select("u", "v", "chunk", "text")
        centres = chunks.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("chunk")).join(texts.withColumnRenamed("node", "v"), "v")
        both = own.unionByName(centres.select(F.lit(None).cast("long").alias("u"), "v", "chunk", "text"))
        both = both.repartition("v", "chunk").sortWithinPartitions("v", "chunk", F.col("u").asc_nulls_first())
        return both.mapInArrow(_verify(k, percent), "u long, v long")

    links = cut(verified(tried))
    parts = cut(components(links))
    # What comparisons with one centre leave in more than one component: all but the largest's nodes against all others.
    group = tried.select(F.col("v").alias("cluster"), F.col("u").alias("node")).unionByName(tried.select(F.col("v").alias("cluster"), F.col("v").alias("node")).distinct())
    placed = cut(group.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).join(nodes.select("node", "n"), "node"))
    per_part = placed.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"))
    split = per_part.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("size", "component")).alias("largest")).where("parts > 1")
    open_ = _with_bounds(cut(placed.join(fresh(split.select("cluster", "largest"), "cluster"), "cluster")), texts, k, percent)
    del placed, per_part, split, group
    release(spark)
    more = cut(_across(open_, texts, k, percent))
    if not more.isEmpty():
        parts = cut(components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)))
    del open_, more, texts, tried, links
    release(spark)

    joined = nodes.select("node", "ca", "cb", "rep").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    of_set = joined.join(least, "component").select("ca", "cb", "least")
    out = features.select("doc_id", "text_hash", "n_shingles", *(F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("ca", "cb"))).join(fresh(of_set, "ca", "cb"), ["ca", "cb"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _repeats(rows: DataFrame) -> bool:
    """Whether a doc_id occurs twice."""
    return not rows.groupBy("doc_id").count().where("count > 1").isEmpty()


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps: one document of each component, all columns. Of rows that share a
    doc_id each goes or stays by its own text."""
    gone = _grouped(docs, k, percent, "doc_id", "text").where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    same = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 3), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pair JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 80 * (nu.n + nv.n - c)),
reach AS (SELECT u AS a, v AS b FROM links UNION SELECT a, v FROM reach JOIN links ON b = u),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
