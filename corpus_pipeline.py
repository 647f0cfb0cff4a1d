"""A training corpus from ``documents``: filter, deduplicate, redact, pack.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir).  ``run``
applies them in order and writes each result as Parquet to the shared folder
before the next stage reads it.  All stages but the last return the columns of
``documents``; the last returns the pieces with their windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import near_copies, packing, quality_classifier, quality_rules, secret_scan
from canopy.llm.common import materialise, scratch_path, table


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(docs)


def drop_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.Ledger(spark, scratch_path(spark, "ledger")))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs)


STAGES = [
    ("quality_rules", drop_by_rules),
    ("quality_classifier", drop_by_classifier),
    ("simhash_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("packing", pack_windows),
]

#: SQL expresses neither the classifier nor the tokenizer; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
