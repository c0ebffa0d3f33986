"""A corpus pipeline of five operators: each stage works on all that its predecessor kept.

An empty table passes through all stages.  Columns other than doc_id, text and n_chars are kept as they
are until the last stage, whatever their names, and texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_size, shared_table
from tidemark.llm.decontaminate import keep_clean
from tidemark.llm.jaccard_join import linked_keys, row_keys
from tidemark.llm.quality import keep_good
from tidemark.llm.secret_scan import redact
from tidemark.llm.sentencepiece_codec import encode_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; each row, repeated or without an id, is judged by itself.

    Null and empty texts are judged by their structure.  Without labels every score is 0.5 and nothing goes.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, 0.8) one row stays: that of the smallest doc_id.

    Rows without an id come before all others, in any order; further rows of an id come after all others, so of a
    repeated row one stays.  Empty and null texts are similar to nothing and stay, each of them.
    """
    keyed, key = row_keys(docs)
    gone = linked_keys(keyed, key, width=5, num=80).where("component_id <> doc_id").select(F.col("doc_id").alias(key))
    return join_by_size(keyed, shared_table(gone), key, "left_anti", 16).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; each row is judged by itself, and texts without words stay."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays, null and empty texts as they are, and n_chars (null for a null text) follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to; null and empty texts have none."""
    return encode_digest(docs, tokens=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: Not expressible in SQL (a trained classifier comes first); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
