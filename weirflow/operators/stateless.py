"""Filters, maps and text operators: no state, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import words


def filter_band(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows with low < column < high; both bounds are outside."""
    return df.where((F.col(column) > low) & (F.col(column) < high))


def filter_band_keys(df: DataFrame, key: str, row_id: str, low: int, high: int) -> DataFrame:
    """The ids of the rows whose key lies inside the band."""
    return filter_band(df, key, low, high).select(row_id)


def select(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def tag_side(df: DataFrame, column: str, side: int) -> DataFrame:
    """(value, side): marks which input of a join a row comes from."""
    return df.select(F.col(column), F.lit(side).alias("side"))


def tokens(df: DataFrame, column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, word, n = 1) for every word of the text, in upper case."""
    found = df.select(*keep, F.explode(words(F.col(column))).alias("word"))
    return found.select(*keep, F.upper("word").alias("word"), F.lit(1).cast("long").alias("n"))


def lines(df: DataFrame, column: str = "text", keep: tuple[str, ...] = (), slices: bool = False) -> DataFrame:
    """One row for a line; of raw slices the first, partial line and an unterminated last one are left out."""
    parts = F.split(F.col(column), "\n")
    whole = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))) if slices else parts
    return df.select(*keep, F.explode(whole).alias("line"))


def grep(df: DataFrame, pattern: str, column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every match of the pattern; matches don't overlap."""
    return df.select(*keep, F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("match"))


def grep_groups(df: DataFrame, pattern: str, groups: int, column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every capture group, 0 to groups, of every match."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(i)) for i in range(groups + 1)]))
    return df.select(*keep, F.explode(found).alias("match"))


def sentiment(df: DataFrame, lexicon: DataFrame, row_id: str, column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sum of the lexicon's scores of a row's tokens, split at blanks and tabs, case and all; 0 if none is in it.

    lexicon is (word, score); words of several tokens never match. It is joined by size: small ones are broadcast by
    the optimiser, and rows without any entry are kept by the outer join on the row's id.
    """
    scored = df.select(row_id, F.explode(F.split(F.col(column), "[\t ]")).alias("word")).join(lexicon, "word")
    return df.select(row_id, *keep).join(scored.groupBy(row_id).agg(F.sum("score").alias("score")), row_id, "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))


def sentiment_map(df: DataFrame, lexicon: dict[str, int], column: str = "text") -> DataFrame:
    """The same without a shuffle, for a lexicon of a few hundred words: a literal map looked up in place; streams take it too."""
    table = F.create_map(*[x for w, s in sorted(lexicon.items()) for x in (F.lit(w), F.lit(s).cast("long"))])
    total = F.aggregate(F.split(F.col(column), "[\t ]"), F.lit(0).cast("long"), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(0).cast("long")))
    return df.withColumn("score", F.coalesce(total, F.lit(0).cast("long")))


def par_do(df: DataFrame, process: Callable, schema: str, start: Callable | None = None, finish: Callable | None = None) -> DataFrame:
    """A function over Arrow batches as pandas frames, with a call before and after each partition's rows.

    process takes (context, frame) and returns a frame of any length; start returns the context; finish may return rows.
    """

    def run(frames):
        context = start() if start else None
        for frame in frames:
            yield process(context, frame)
        last = finish(context) if finish else None
        if last is not None:
            yield last

    return df.mapInPandas(run, schema)


def project(df: DataFrame, *columns: str) -> DataFrame:
    """Extract, re-key and gather are all projections here; unused columns are never read."""
    return df.select(*columns)
