"""A training corpus from documents: toxicity filter, near-duplicates, secrets, mix, packing."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, secrets, simhash, toxicity
from tidemark.llm.common import scratch, table
from tidemark.llm.entry import tokenizer


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate group."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in mix order over files and rows."""
    return mixing.in_mix_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences. Rows read from files are packed in runs of their order there, which is the mix order, so every
    stretch of sequences has the target weights; rows from elsewhere in like documents' shards."""
    order = ["_part", "_file", "_row"]  # files by number: names sort part-100000 before part-99999
    try:
        part = "try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as long) as _part"
        docs = docs.selectExpr("doc_id", "text", part, "_metadata.file_name as _file", "_metadata.row_index as _row")
    except AnalysisException:
        order = None
    return packing.pack(docs, tokenizer(), order=order)


STAGES = [("toxicity", not_toxic), ("simhash", distinct), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]

#: SQL cannot express the learnt scores and the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again."""
    base = f"{scratch(spark)}-{uuid.uuid4().hex[:6]}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
