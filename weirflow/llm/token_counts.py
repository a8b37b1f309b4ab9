"""Token counts of whole texts for a public tokenizer, by rank-synchronous merging of batched pre-tokens (bpe.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as rg
from .shared import small_batches

MODEL, LIMIT = "piece_bpe_32k.model", 4096
_counters: dict = {}


def vocabulary(name: str) -> str:
    """Where the public tokenizers' file is; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _counter(path: str | None, name: str):
    from .bpe import PieceCounter

    key = path or name
    if key not in _counters:
        _counters[key] = PieceCounter(path or vocabulary(name))
    return _counters[key]


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None, name: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs, in one pass without a shuffle.

    Null counts as empty, which has no tokens. Null ids and repeated rows stay; other columns are ignored. The
    model's file is path, or name among the public tokenizers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, name)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b, _, offs in rg.blocks(texts):
                n = counter.counts(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(offs[1:] - offs[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
