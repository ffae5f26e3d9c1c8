"""The opN queries: each applies its operator, with production parameters, to the whole of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from texmill.llm import bpe, fingerprints, hmm, license_scan, packing, quality_classifier, quality_rules, secret_scan, simhash, wordpiece
from texmill.llm.text import id_remainder
from texmill.storage import stash, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality_rules.judged(docs)
    first = ("_doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*first, F.col("d2").alias("distance2"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stash(simhash.fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    out = simhash.grouped(rows)
    return out.select("_doc.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    of = lambda *kinds: F.filter("_spans", lambda s: s["kind"].isin([secret_scan.KINDS.index(k) for k in kinds]))
    base = ("assign", "access", "hex")
    return secret_scan.scanned(docs).select(
        F.col("_doc.doc_id").alias("doc_id"),
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(secret_scan.listed(of(*base)), 256).alias("base_sha256"),
        secret_scan.listed(F.col("_spans")).alias("spans"),
        F.size(F.filter("_spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("_spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.licensed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["first_word"].cast("string"), m["end_word"].cast("string")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(told, ",").alias("licenses"))


def op7_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_classifier.trained(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0)
    score = F.col("score")
    held = id_remainder(F.col("_doc.doc_id"), 5) == 0
    return quality_classifier.scored(docs, forest).select("_doc.doc_id", held.alias("held_out"), score, (score >= 0.3).cast("int").alias("predicted"))
