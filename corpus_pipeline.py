"""Corpus pipeline: score, deduplicate, scrub and pack the documents table.

Every stage but the last returns the columns of documents and works on all rows that the stage
before it kept.  Stages write nothing but what their operators do; :func:`run` hands Parquet from
one to the next, so a lost executor costs one stage at most.

Defined results: null texts pass the filters like empty texts and are packed as the end id alone;
an empty table stays empty; columns beyond those of documents are dropped; rows that repeat an id are
separate documents, and each decision is about its own row: of two equal rows one is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, jaccard_join, packing, pii, quality_classifier
from larkspur.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


ROW = "__row"


def rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row: its id where all ids are there and differ, else one that is stored."""
    seen = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if len(set(seen)) == 1:
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.select(ROW), ROW, "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier predicts as label 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = rows(docs)
    return only(docs, quality_classifier.classify(docs, labels, keep=[ROW]).where("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id."""
    docs = rows(docs)
    return only(docs, exact_dedup.exact_dedup(docs, keep=[ROW]).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents keep the one with the smallest id.

    Documents without words have no shingles and are linked with nothing: all stay.
    """
    docs = rows(docs)
    found = jaccard_join.similar_components(docs, id_col=ROW)
    named = found.select(F.col("doc_id").alias(ROW), "component_id").join(docs.select(ROW, "doc_id"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)).alias("first")
    return only(docs, named.groupBy("component_id").agg(first).select(f"first.{ROW}"))


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the text."""
    found = pii.find_pii(docs, keep=["text", "lang", "source"])
    clean = found.withColumn("text", pii.redact(F.coalesce("text", F.lit("")), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 1024 tokens, one row per piece."""
    import public_tokenizers

    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("pii", scrub), ("packing", pack)]

# Scores, redaction and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
