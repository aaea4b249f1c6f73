"""A training corpus from raw documents: clean, without near duplicates and repeated passages, mixed by source and packed.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; all but the last have the columns of ``documents``, and
any others of ``docs``, whatever their names. All take nulls in any column,
empty and very long texts, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.ngram_join import one_of_each
from quillrank.llm.packing import pack_documents
from quillrank.llm.source_mix import mixed_documents
from quillrank.llm.span_dedup import dedup_spans
from quillrank.llm.tables import discard, read, stash, temporary
from quillrank.llm.toxicity_knn import without_toxic


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts, which show nothing toxic, stay. Equal texts go or stay together."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return without_toxic(docs, labels)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document of the smallest doc_id stays, of rows that share it the text that comes first; null ids and texts without words stay."""
    return one_of_each(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; repeated passages go from all texts but the first. Null stays null, and a text may become empty."""
    return _counted(dedup_spans(docs, counts=False))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch of each document taken; texts without words have nothing to take and go, and a null source is one of its own."""
    return _counted(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is its end token alone, and every row is packed for itself."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: Tokens can't be made in SQL; tests compare the whole pipeline with plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written, and what it was made of goes."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary() as keep:
            docs = keep(stash(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
