"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  The first
four return the columns of documents; the last returns packed pieces.

Defined cases are those of the operators: a null text is an empty one (it fails
the word rule and goes), documents without an id are judged like others, equal
documents leave one, very long texts are read whole, an empty table gives no
pieces, and extra columns stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcast.llm import _shared, decontaminate, neardup, packing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return quality.keep_passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.keep_clean(docs, _shared.table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; every document stays."""
    return secrets.redact_secrets(docs)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of full token windows."""
    return packing.public_pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", retrieval_packing),
]

#: Tokenisation and retrieval cannot be expressed in SQL; tests hold each stage on a small table against what it must do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = _shared.materialize(docs, f"stage{k}")
    return docs
