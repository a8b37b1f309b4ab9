"""The corpus pipeline: language identification, near and exact deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and further ones of any name that docs has.

In every stage an empty table stays empty, a row with a null doc_id is kept or dropped by its text alone, and rows that share a
doc_id are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import decontaminate, lang_id, near_dup, packing, substring_dedup
from weirflow.llm.shared import remove, shared_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learned from the labelled rows of docs, rejects go; so do null, empty and
    letterless texts."""
    return lang_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays, that of the
    least doc_id; texts without words are no duplicates, and repeated rows of it stay together."""
    return near_dup.keep_first(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id has are cut out; a document that is left without
    a word goes, one that loses nothing stays as it is."""
    return substring_dedup.cut_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (or a whole shorter item) go; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, with their token ids; a null or empty text is its end mark."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontaminated),
    ("packing", packed),
]
#: Learned models, sketches and greedy packing are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each one's result by way of the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
