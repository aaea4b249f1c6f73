"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.edit_embedding import fingerprint_documents
from quillrank.llm.importance import ORACLE_IMPORTANCE, importance_resample
from quillrank.llm.ngram_join import ORACLE_JOIN, ngram_join
from quillrank.llm.packing import pack_documents
from quillrank.llm.prefix_trie import ORACLE_TRIE, prefix_trie
from quillrank.llm.quality_qda import fold, score_quality
from quillrank.llm.quality_trees import quality_rules
from quillrank.llm.ring_sharding import shard_documents
from quillrank.llm.source_mix import ORACLE_MIX, mix_sources
from quillrank.llm.span_dedup import dedup_spans
from quillrank.llm.tables import read
from quillrank.llm.toxicity_knn import score_toxicity
from quillrank.llm.url_filter import filter_urls, labelled_urls
from quillrank.llm.warc import ORACLE_WARC, archive_pages
from quillrank.stored import fresh_folder


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_rules(read(spark, sf_dir, "documents"), labels)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(read(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"), n=4, percent=85)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), labelled_urls(spark))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(read(spark, sf_dir, "documents"), shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(read(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archive_pages(read(spark, sf_dir, "pages"), fresh_folder(spark, "warc"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_quality_classifier, op3_ngram_join, op4_mix_sources, op5_span_dedup, op6_packing, op7_url_filter, op8_ring_shards, op9_edit_fingerprints, op10_toxicity, op11_importance_resampling, op12_warc, op13_conversation_trie)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": ORACLE_JOIN.format(docs="documents", n=4, percent=85), "op4_mix_sources": ORACLE_MIX.format(docs="documents"), "op11_importance_resampling": ORACLE_IMPORTANCE.format(docs="documents", target="benchmark"), "op12_warc": ORACLE_WARC.format(pages="pages"), "op13_conversation_trie": ORACLE_TRIE.format(conversations="conversations")}
