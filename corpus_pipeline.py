"""A cleaning pipeline over `documents`: each stage calls one operator and gets what the stage before it kept, reread from Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm import decontaminate, lines, pieces, simhash, toxicity
from meterflow.llm.common import bounded, checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic score of 0.5 or more. The labels are those of sf_dir, the texts what the stage gets."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least 10 of them hold; n_chars follows the text, columns named as the operator's counts stay."""
    bounded(spark)
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_dropped")}
    kept = lines.drop_lines(docs.withColumnsRenamed(own), lines.LineIndex.build(docs, 10)).drop("n_lines", "n_dropped")
    kept = kept.withColumnsRenamed({new: old for old, new in own.items()})
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that similarities of 0.8 or more over words of five link."""
    bounded(spark)
    return simhash.near_similar(docs, k=5, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks with four fifths of its words."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, input_ids, n_tokens and round_trip of each document."""
    bounded(spark)
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express the fitted model, SimHash or the tiles; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage keeps is a Parquet table in the shared checkpoint folder."""
    checkpointed(spark.range(0))  # sets the folder where it is unset
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
