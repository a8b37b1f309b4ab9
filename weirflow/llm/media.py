"""Media columns: texts stored as lossless WebP pictures, read back as pixel arrays, with a feature of each."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .shared import small_batches

#: A payload is a whole number of rows of so many samples; a picture has at most webp.MAX_SIDE of them.
ROW = 576


def _stored(payload: np.ndarray) -> bytes:
    """One file, or several one after another for payloads over MAX_SIDE rows."""
    step = ROW * webp.MAX_SIDE
    return b"".join(webp.encode_samples(payload[i : i + step], ROW) for i in range(0, len(payload), step))


def _pixels(media: bytes) -> np.ndarray:
    """All samples of the files in media."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append((webp.decode(media[at:end]).ravel() >> np.uint32(8)).astype(np.uint8))
        at = end
    return np.concatenate(out)


def feature(samples: np.ndarray) -> str:
    """An average hash: which of 64 equal parts of the samples are lighter than the whole, as 16 hex digits."""
    parts = np.add.reduceat(samples.astype(np.float64), np.arange(64) * len(samples) // 64)
    sizes = np.diff(np.r_[np.arange(64) * len(samples) // 64, len(samples)])
    return np.packbits(parts / sizes > samples.mean()).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with 255 to whole rows, as a picture's green samples.

    Null is empty and one row of filling. Null ids and repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a in range(0, len(batch), 256):
                sizes, media = [], []
                for t in texts.slice(a, 256).to_pylist():
                    raw = (t or "").encode()
                    sizes.append(len(raw))
                    media.append(_stored(np.frombuffer(raw + b"\xff" * (-len(raw) % ROW if raw else ROW), np.uint8)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame, with_samples: bool = True) -> DataFrame:
    """What the pictures of store() hold: digests of the samples and of the file, a feature, and the samples themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                rows, samples = [], []
                for m in part.column(2).to_pylist():
                    p = _pixels(m)
                    raw = p.tobytes()
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
                    samples.append(raw)
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                extra = [pa.array(samples, pa.binary())] if with_samples else []
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, *extra], names + ["samples"] * with_samples)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + ", samples binary" * with_samples)
