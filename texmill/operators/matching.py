"""Best match of each row among the rows near its place: a band join on buckets, then the best by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from texmill.functions.tokens import letters, similarity
from texmill.storage import stash

BAND = 40


def band_pairs(left: DataFrame, right: DataFrame, band: int = BAND) -> DataFrame:
    """left(doc_id, seq, ...) with each right(doc_id, seq as found_seq, ...) of its document at most band places from where
    its place falls when both are stretched to one length.

    A band alone would be a nested loop; buckets as wide as the band make it an equi-join, and each right row lies in one
    bucket, so no pair comes twice.
    """
    width = 2 * band + 1
    sizes = left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_left")).join(right.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_right")), "doc_id")
    centre = F.rint(F.col("seq") * (F.col("n_right") / F.greatest(F.lit(1), F.col("n_left")))).cast("long")
    near = left.join(sizes, "doc_id").withColumn("centre", centre)
    bucket = lambda c: F.floor(c / width)
    near = near.withColumn("bucket", F.explode(F.sequence(bucket(F.col("centre") - band), bucket(F.col("centre") + band))))
    filed = right.withColumnRenamed("seq", "found_seq").withColumn("bucket", bucket(F.col("found_seq")))
    pairs = near.join(filed, ["doc_id", "bucket"]).filter(F.abs(F.col("found_seq") - F.col("centre")) <= band)
    return pairs.drop("bucket", "centre", "n_left", "n_right")


def matched(originals: DataFrame, found: DataFrame, band: int = BAND) -> DataFrame:
    """originals(doc_id, seq, text, tokens, ...) with found_seq, found_text and score of the most similar of
    found(doc_id, seq, text, tokens) in the band; the first on ties, none if nothing is similar at all.

    Both are read for the alphabet, the pairs and the result, and tokens are costly to make, so they are written first."""
    originals, found = stash(originals), stash(found.select("doc_id", "seq", "text", "tokens"))
    alphabet = originals.select("doc_id", F.explode("tokens").alias("t")).union(found.select("doc_id", F.explode("tokens").alias("t")))
    alphabet = alphabet.groupBy("doc_id").agg(F.sort_array(F.collect_set("t")).alias("alphabet"))  # tokens of one document
    coded = lambda df: df.join(alphabet, "doc_id").withColumn("code", letters(F.col("tokens"), F.col("alphabet"))).drop("alphabet")
    left = coded(originals).select("doc_id", "seq", "code")
    right = coded(found).select("doc_id", "seq", F.col("text").alias("found_text"), F.col("code").alias("found_code"))
    pairs = band_pairs(left, right, band).withColumn("score", similarity(F.col("code"), F.col("found_code"))).filter("score > 0")
    best = pairs.groupBy("doc_id", "seq").agg(F.max_by(F.struct("found_seq", "found_text", "score"), F.struct("score", -F.col("found_seq"))).alias("best"))
    out = originals.join(best, ["doc_id", "seq"], "left")
    return out.select(*originals.columns, "best.found_seq", "best.found_text", F.coalesce("best.score", F.lit(0.0)).alias("score"))
