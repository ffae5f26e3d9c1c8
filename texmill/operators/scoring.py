"""Roll-ups of matched formulas: summaries, by kind, worst rows, and change against a stored baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from texmill.functions.tokens import kinds


def measures(score: Column) -> list[Column]:
    """formulas, exact_pct and similarity_pct of a group; zero for an empty one."""
    exact = F.avg(F.when(score >= 1.0, 100.0).otherwise(0.0))
    return [F.count(score).alias("formulas"), F.coalesce(exact, F.lit(0.0)).alias("exact_pct"), F.coalesce(100 * F.avg(score), F.lit(0.0)).alias("similarity_pct")]


def by_kind(matches: DataFrame) -> DataFrame:
    """A row for each kind; a formula counts in each of its kinds."""
    each = matches.select("score", F.explode(kinds(F.col("tokens"), F.col("text"), F.col("display"))).alias("kind"))
    return each.groupBy("kind").agg(*measures(F.col("score")))


def report(matches: DataFrame) -> DataFrame:
    """by_kind and a row for all, in one pass over the matches."""
    labels = F.concat(kinds(F.col("tokens"), F.col("text"), F.col("display")), F.array(F.lit("total")))
    return matches.select("score", F.explode(labels).alias("kind")).groupBy("kind").agg(*measures(F.col("score")))


def total(matches: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for all formulas, their scores rounded to four places as a report stores them; and of errors(doc_id, errors)
    the sum and how many papers have none. Papers that were not compiled (null) count in neither."""
    compiled = errors.agg(F.sum("errors").alias("latex_errors"), F.count_if(F.col("errors") == 0).alias("clean_papers"))  # one row
    return matches.agg(*measures(F.round("score", 4))).withColumn("kind", F.lit("total")).join(F.broadcast(compiled))


def worst(matches: DataFrame, n: int = 15, least_tokens: int = 5) -> DataFrame:
    """The n lowest scores of each document, and of those the formulas of enough tokens: fewer than n rows are possible."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("score", "seq"))
    return matches.withColumn("_place", place).filter((F.col("_place") <= n) & (F.size("tokens") >= least_tokens)).drop("_place")


def against(report: DataFrame, baseline: DataFrame) -> DataFrame:
    """report(kind, exact_pct) with the change from baseline(kind, exact_pct): null if new, zero if under 0.05 points."""
    known = baseline.select("kind", F.col("exact_pct").alias("baseline_pct"))
    change = F.col("exact_pct") - F.col("baseline_pct")
    return report.join(known, "kind", "left").withColumn("change", F.when(F.abs(change) < 0.05, 0.0).otherwise(change))
