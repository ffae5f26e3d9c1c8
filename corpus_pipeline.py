"""The corpus pipeline: documents in, packed sequences out. Each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from texmill.llm import near_copies, packing, quality_classifier, quality_rules, secret_scan
from texmill.llm.text import id_remainder
from texmill.storage import stash, table


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are outliers of their language and source."""
    return quality_rules.judged(docs, with_text=True).filter("kept").select("_doc.*")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores under 0.3."""
    forest = quality_classifier.trained(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0)
    return quality_classifier.scored(docs, forest, with_text=True).filter(F.col("score") >= 0.3).select("_doc.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of near duplicates (Jaccard >= 0.8 over five-word shingles), once."""
    rows = stash(near_copies.sketched(docs))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = near_copies.grouped(rows).groupBy("component").agg(F.min(order).alias("first")).select("first._row")
    return rows.join(first, "_row", "left_semi").select("_doc.*")


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the spans of secrets; live-looking ones and copied examples get different marks."""
    found = secret_scan.scanned(docs, with_text=True)
    text = secret_scan.redacted(F.col("_doc.text"), F.col("_spans"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents' tokens into pieces and packs these into sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: Robust covariance, boosted trees and near-duplicate components are beyond SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
