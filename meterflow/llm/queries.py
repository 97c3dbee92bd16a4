"""The registered query of each operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extraction, filters, lines, negatives, pieces, projections, quality, secrets, simhash, substrings, toxicity
from .common import checkpointed, table


def _held_out(scores: DataFrame, threshold: float) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = quality.fit_ranking(docs, labels)
    known = checkpointed(quality.strengths(docs, ranking))
    return _held_out(quality.score(known, quality.at_threshold(ranking, known, labels)), quality.AT_THRESHOLD)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_lines(docs, lines.LineIndex.build(docs, 10))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projections.embedding_links(table(spark, sf_dir, "embeddings"), 0.93)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), k=3, bits=3)
    return out.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"), 13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _held_out(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0, negatives.Mining())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(*filters.text_relations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_quality, op2_line_dedup, op3_sentencepiece, op4_secret_scan, op5_decontaminate, op6_embedding_dedup, op7_simhash, op8_substring_dedup, op9_token_counts, op10_toxicity, op11_html_extraction, op12_hard_negatives, op13_filter_audit]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return ORACLES
