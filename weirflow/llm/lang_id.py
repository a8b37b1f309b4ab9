"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its subwords: byte n-grams of 2 to 4 inside its words, with word ends as a
boundary, hashed into BUCKETS. The model is trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows, about PER_LANG for each language. A fifth of the sample is kept from training: on it the temperature of
the softmax is fitted, and the least score that still counts as known. As the model is linear, embeddings and softmax
weights are multiplied out for prediction; whole texts are scored by sums over their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as rg
from .shared import small_batches

BUCKETS, DIM, SIZES = 1 << 16, 16, (2, 3, 4)
#: The sample's bounds: so many rows of a language are expected in it, of at most so many languages, and so many in all.
PER_LANG, MAX_LANGS, SAMPLE_ROWS = 500, 1000, 20_000
#: Languages that are summed up at once, so that no array is as large as subwords times languages.
LANG_BLOCK = 16
UNKNOWN = "und"
#: At most this share of the calibration rows is rejected, and no score that is clearly over an even chance.
REJECTED_SHARE, UNSURE = 0.001, 0.2
_LETTER = regex.compile(r"\p{L}")
_BOUND = np.uint8(32)


def subwords(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every subword, row by row."""
    n = len(offs) - 1
    text = rg.ascii_lower(data)
    accent = np.flatnonzero((text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3)) + 1
    text[accent] += np.uint8(32)
    letter = ((text >= 97) & (text <= 122)) | (text >= 128)
    # One boundary before each row and one at the end, so that no n-gram reaches into the next row.
    place = np.arange(len(text)) + np.repeat(np.arange(1, n + 1), np.diff(offs))
    padded = np.full(len(text) + n + 1, _BOUND, np.uint8)
    padded[place] = np.where(letter, text, _BOUND)
    inside = padded != _BOUND
    wide, found, where = padded.astype(np.uint32), [], []
    key = wide
    for size in range(2, max(SIZES) + 1):
        key = key[:-1] | wide[size - 1 :] << np.uint32(8 * (size - 1))
        m = len(key)
        good = inside[:m] | inside[size - 1 :]
        for j in range(1, size - 1):
            good &= inside[j : j + m]
        at = np.flatnonzero(good)
        k = key[at] * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        k ^= k >> np.uint32(15)
        k *= np.uint32(0x2C1B3C6D)
        found.append((k >> np.uint32(32 - (BUCKETS.bit_length() - 1))).astype(np.int32))
        where.append(at)
    edges = offs + np.arange(n + 1)
    rows = [np.searchsorted(at, edges) for at in where]
    return found, rows


def lettered(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows with a letter of any script."""
    low = data | np.uint8(32)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((low >= 97) & (low <= 122), out=seen[1:])
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = bool(_LETTER.search(data[offs[i] : offs[i + 1]].tobytes().decode()))
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, langs): embeddings times softmax weights, over the temperature
    bias: np.ndarray
    least: float

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(rows, langs) calibrated probabilities."""
        n = len(offs) - 1
        total, count = np.zeros((n, len(self.langs))), np.zeros(n)
        for buckets, edges in zip(*subwords(data, offs), strict=True):
            some = np.flatnonzero(np.diff(edges))
            for a in range(0, len(self.langs) if len(some) else 0, LANG_BLOCK):
                part = slice(a, a + LANG_BLOCK)
                total[some, part] += np.add.reduceat(self.weights[buckets, part], edges[some], axis=0, dtype=np.float64)
            count += np.diff(edges)
        return softmax(total / np.maximum(count, 1)[:, None] + self.bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in rg.blocks(batch.column(2)):
            found, rows = subwords(data, offs)
            ids, shares = [], []
            for i in range(b - a):
                own, n = np.unique(np.concatenate([f[e[i] : e[i + 1]] for f, e in zip(found, rows, strict=True)]), return_counts=True)
                ids.append(own)
                shares.append((n / max(1, n.sum())).astype(np.float32))
            sizes = np.array([len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), rg.flat_lists(np.concatenate(ids), sizes, pa.int32()), rg.flat_lists(np.concatenate(shares), sizes, pa.float32())], ["h", "lang", "ids", "shares"])


def sample(rows: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> list:
    """Subword shares of about per_lang rows of each of the commonest max_langs languages of rows (h, lang, text); of fewer,
    if those were more than SAMPLE_ROWS in all. What comes to the driver is a row's distinct subwords, BUCKETS at most."""
    small_batches(rows.sparkSession)
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not counts:
        return []
    per_lang = min(per_lang, SAMPLE_ROWS // len(counts))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))])
    taken = rows.where(F.pmod("h", F.lit(1 << 20)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 20))
    found = taken.mapInArrow(_counts, "h long, lang string, ids array<int>, shares array<float>").collect()
    return sorted((r for r in found if len(r["ids"])), key=lambda r: (r["h"], r["lang"], r["ids"][:3]))


def train(rows: list, epochs: int = 12, rate: float = 40.0, seed: int = 7) -> Model | None:
    """Fit on the rows of sample(); every fifth calibrates."""
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    rng, code = np.random.default_rng(seed), {x: i for i, x in enumerate(langs)}
    data = [(np.array(r["ids"]), np.array(r["shares"], np.float32), code[r["lang"]]) for r in rows]
    held = data[::5] if len(data) >= 10 * len(langs) else []
    fit = [x for i, x in enumerate(data) if not held or i % 5]
    emb, out, bias = np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 0.5, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // 32)):
            mean = np.stack([fit[i][1] @ emb[fit[i][0]] for i in part])
            grad = softmax(mean @ out + bias)
            grad[np.arange(len(part)), [fit[i][2] for i in part]] -= 1
            grad /= len(part)
            back = grad @ out.T
            out -= 0.01 * lr * (mean.T @ grad)
            bias -= 0.001 * lr * grad.sum(0)
            for i, g in zip(part, back, strict=True):
                emb[fit[i][0]] -= lr * fit[i][1][:, None] * g
    check = held or fit
    logits = np.stack([s @ emb[i] for i, s, _ in check]) @ out + bias
    truth = np.array([c for _, _, c in check])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    best = softmax(logits / temperature).max(1)
    least = min(float(np.quantile(best, REJECTED_SHARE)), UNSURE + (1 - UNSURE) / len(langs))
    return Model(langs, (emb @ out / temperature).astype(np.float32), bias / temperature, least)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model | None:
    """A model from the labelled rows of docs outside the held-out third."""
    rows = docs.where((F.crc32(F.col(id_col).cast("string")) % 3 != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return train(sample(rows.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), per_lang))


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in rg.blocks(batch.column(1)):
                known = lettered(data, offs)
                if model is None:
                    known[:] = False
                names, best = np.full(b - a, UNKNOWN, object), np.zeros(b - a)
                if known.any():
                    p = model.scores(data, offs)
                    names[known] = np.array(model.langs, object)[p.argmax(1)][known]
                    best[known] = p.max(1)[known]
                rejected = best < model.least if model else np.ones(b - a, bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(best), pa.array(rejected | ~known)], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected), a row for each row of docs, from its whole text alone.

    Null texts and texts without a letter are und, with score 0, and rejected; so is any other text whose calibrated
    score is below the model's least, which keeps its nearest language. Without labelled rows all is und. Repeated
    rows get one row each, null ids stay, other columns are ignored, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs whose language is known, all columns; texts are judged where they lie, without a shuffle.

    Null, empty and letterless texts go, and those that the model rejects; without labelled rows all go. Each of repeated
    rows and rows with a null doc_id are judged by their text. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    inner, columns = _predict(model or fit(docs)), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            core = pa.RecordBatch.from_arrays([batch.column(columns.index("doc_id")), batch.column(columns.index("text"))], ["doc_id", "text"])
            for part in inner(iter([core])):
                yield batch.slice(at, len(part)).filter(pa.array(~part.column(3).to_numpy(zero_copy_only=False)))
                at += len(part)

    return docs.mapInArrow(run, docs.schema)
