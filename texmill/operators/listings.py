"""Listings: line numbers and blank rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

NUMBER = r"^\s*(\d{1,4})(?:\s|$)"


def without_line_numbers(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, line) less the numbers before them, where every filled line of a document has one and they
    never fall; all lines are cut at the same column, where the shortest number ends."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    filled = lines.filter(F.trim("line") != "")
    number = F.regexp_extract("line", NUMBER, 1).try_cast("int")
    seen = filled.withColumn("k", number).withColumn("falls", F.coalesce(F.lag("k").over(w) > F.col("k"), F.lit(False)))
    ends = F.length(F.regexp_extract("line", NUMBER, 0))
    told = seen.groupBy("doc_id").agg((F.bool_and(F.col("k").isNotNull()) & ~F.bool_or("falls")).alias("ok"), F.min(ends).alias("cut"))
    cut = F.when(F.col("ok") & (F.trim("line") != ""), F.substr("line", F.col("cut") + 1, F.length("line"))).otherwise(F.col("line"))
    return lines.join(told, "doc_id", "left").select("doc_id", "line_no", cut.alias("line"))


def blank_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """rows(keys, block, y, line) with blanks: how many empty rows stand before each, by the least step of its block."""
    w = Window.partitionBy(*keys, "block").orderBy("y")
    stepped = rows.withColumn("step", F.col("y") - F.lag("y").over(w))
    least = F.min("step").over(Window.partitionBy(*keys, "block"))
    return stepped.withColumn("least", least).select(*keys, "block", "y", "line", F.coalesce(F.rint(F.col("step") / F.col("least")).cast("int") - 1, F.lit(0)).alias("blanks"))


def fenced(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, text): the rows of each block with the blank ones between them, as fenced code."""
    spaced = blank_rows(rows, *keys).withColumn("line", F.concat(F.repeat(F.lit("\n"), F.col("blanks")), F.col("line")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda x: x["line"])
    return spaced.groupBy(*keys, "block").agg(F.concat(F.lit("```\n"), F.array_join(lines, "\n"), F.lit("\n```")).alias("text"))
