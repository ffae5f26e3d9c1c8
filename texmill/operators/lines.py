"""Operators on lines in order: running heads, islands, neighbours, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from texmill.functions.markdown import DOT_LEADER, TOC_TITLE, stripped


def numbered_lines(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no (from 0), line for each line of texts(keys, text)."""
    return texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def running_heads(pages: DataFrame, share: float = 0.6, least_pages: int = 3) -> DataFrame:
    """(doc_id, line, n): lines among the first or last two of enough pages of a document. A short page may count a line twice."""
    useful = F.filter(F.transform(F.split("text", "\n"), stripped), lambda x: x != "")
    edge = F.concat(F.slice("u", 1, 2), F.slice("u", F.greatest(F.size("u") - 1, F.lit(1)), 2))
    each = pages.withColumn("u", useful).select("doc_id", F.explode(edge).alias("line"))
    counted = each.filter(F.length("line").between(3, 120)).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    enough = F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))
    return counted.join(sizes, "doc_id").filter((F.col("pages") >= least_pages) & enough).select("doc_id", "line", "n")


def without_running_heads(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_no, text) without the lines that repeat."""
    repeated = running_heads(pages).groupBy("doc_id").agg(F.collect_set("line").alias("heads"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("heads"), stripped(x)))
    return pages.join(repeated, "doc_id", "left").select("doc_id", "page_no", F.when(F.col("heads").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def islands(rows: DataFrame, keys: list[str], order: str, inside: Column) -> DataFrame:
    """rows where inside holds, with island: the order value at which their unbroken run begins."""
    w = Window.partitionBy(*keys).orderBy(order)
    begins = inside & ~F.coalesce(F.lag(inside).over(w), F.lit(False))
    return rows.withColumn("island", F.last(F.when(begins, F.col(order)), ignorenulls=True).over(w)).filter(inside)


def toc_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, n_rows, leaders, after_title, is_toc) of the tables in lines(doc_id, line_no, line)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    filled = stripped(F.col("line")) != ""
    blocks = islands(lines, ["doc_id"], "line_no", F.ltrim(F.col("line")).startswith("|"))
    blocks = blocks.groupBy("doc_id", F.col("island").alias("first_line")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("line").rlike(DOT_LEADER)).alias("leaders"))
    solid = lines.filter(filled).withColumn("title", F.col("line").rlike(TOC_TITLE))
    near = solid.withColumn("after_title", F.coalesce(F.max(F.col("title").cast("int")).over(w.rowsBetween(-3, -1)), F.lit(0)) == 1)
    found = blocks.join(near.select("doc_id", F.col("line_no").alias("first_line"), "after_title"), ["doc_id", "first_line"])
    return found.withColumn("is_toc", (F.col("n_rows") >= 3) & ((F.col("leaders") >= F.col("n_rows") * 0.3) | F.col("after_title")))


def display_candidates(lines: DataFrame) -> DataFrame:
    """Lines that are one formula of six characters or more between blank lines or at an edge, as display formulas."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    body = F.regexp_extract("line", r"^\s*\$(.+?)\$\s*$", 1)
    blank = lambda c: F.coalesce(stripped(c) == "", F.lit(True))
    alone = blank(F.lag("line").over(w)) & blank(F.lead("line").over(w))
    out = lines.withColumn("body", body).withColumn("alone", alone).filter((F.length("body") >= 6) & F.col("alone"))
    return out.select("doc_id", "line_no", F.concat(F.lit("$$"), stripped(F.col("body")), F.lit("$$")).alias("display"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """(doc_id, ranges): the page indexes (from 0) of pages(doc_id, page) written as 1-3,5."""
    w = Window.partitionBy("doc_id").orderBy("page")
    run = pages.distinct().withColumn("run", F.col("page") - F.row_number().over(w))
    ends = run.groupBy("doc_id", "run").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    told = F.when(F.col("a") == F.col("b"), (F.col("a") + 1).cast("string")).otherwise(F.concat_ws("-", (F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("a", told.alias("t"))))
    return ends.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias("ranges"))


def same_words(headings: DataFrame, page_lines: DataFrame) -> DataFrame:
    """headings(doc_id, heading_no, tokens) whose words are those of one to three page lines in another order, with that order.

    page_lines(doc_id, line_no, tokens). Bags are compared by an equi-join on sorted words; fewer lines and earlier ones first.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    ahead = [F.lead("tokens", k).over(w) for k in (1, 2)]
    sized = page_lines.withColumns({"t2": ahead[0], "t3": ahead[1]})
    joined = [(1, F.col("tokens")), (2, F.concat("tokens", "t2")), (3, F.concat("tokens", "t2", "t3"))]
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("lines"), t.alias("words")) for n, t in joined)))
    candidates = sized.select("doc_id", "line_no", one.alias("c")).filter(F.col("c.words").isNotNull())
    candidates = candidates.select("doc_id", F.array_sort("c.words").alias("bag"), F.struct("c.lines", "line_no").alias("place"), F.col("c.words").alias("words"))
    wanted = headings.filter(F.size("tokens") >= 2).withColumn("bag", F.array_sort("tokens"))
    pairs = wanted.join(candidates, ["doc_id", "bag"]).filter(F.col("words") != F.col("tokens"))
    return pairs.groupBy("doc_id", "heading_no").agg(F.min_by("words", "place").alias("words"))
