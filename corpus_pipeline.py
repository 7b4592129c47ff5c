"""A corpus pipeline: each stage takes what its predecessor kept, as a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echogrid.llm import jaccard, mixing, packing, quality, secrets
from echogrid.llm.common import drop_stages, n_staged, stage
from echogrid.shipping import shipped


@shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail as a whole go."""
    return quality.clean(docs)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share four fifths of their five-word shingles the one with the smallest id stays.

    Links come from op5's fingerprints and are verified; pairs beyond their radius come from a prefix join.
    """
    return jaccard.deduplicated(docs)


@shipped
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


@shipped
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go, so that sources come near their target weights."""
    return mixing.mixed_documents(docs)


@shipped
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, each with its place in a sequence."""
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written, and then the tables that it and the one before have written are deleted."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), n_staged()
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
            drop_stages(spark, since, docs)
    return docs
