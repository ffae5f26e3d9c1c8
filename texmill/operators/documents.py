"""Document analytics: compiler logs, outlines, warnings, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from texmill.functions import latex as tx
from texmill.functions.markdown import stripped


def log_problems(lines: DataFrame, boxes: bool = False) -> DataFrame:
    """(doc_id, line_no, severity, message, file, line) of compiler logs lines(doc_id, line_no, line).

    An error line waits for its line hint: the first hint after it, if no other problem comes between. Equal problems of a
    document (severity, message, line) are told once, whichever file they name.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    text = F.regexp_replace("line", r"\s+$", "")
    get = lambda pattern, k: F.regexp_extract("text", pattern, k)
    is_file = F.col("text").rlike(tx.FILE_LINE) & ~F.lower("text").rlike("^(package|latex)")
    is_warning = F.col("text").rlike(tx.WARNING) & ~F.col("text").rlike(tx.NOISE)
    kind = (
        F.when(is_file, "file").when(F.col("text").rlike(tx.BANG), "bang").when(F.col("text").rlike(tx.LINE_HINT), "hint").when(is_warning, "warning")
        .when(F.col("text").rlike(tx.BOXES) & F.lit(boxes), "box").when(F.col("text").rlike(tx.MISSING_FILE), "missing")
    )
    marked = lines.withColumn("text", text).withColumn("kind", kind).filter(F.col("kind").isNotNull())
    # a hint after a hint, or after anything but an error, belongs to none; what follows an error decides if it has a line
    following = F.lead(F.struct("kind", "text")).over(w)
    marked = marked.withColumn("next", following).filter("kind <> 'hint'")
    hint = F.when(F.col("next.kind") == "hint", F.regexp_extract("next.text", tx.LINE_HINT, 1))
    number = lambda c: c.try_cast("int")
    package = get(tx.WARNING, 1)
    warned = stripped(get(tx.WARNING, 2))
    message = (
        F.when(F.col("kind") == "file", stripped(get(tx.FILE_LINE, 3)))
        .when(F.col("kind") == "bang", stripped(get(tx.BANG, 1)))
        .when(F.col("kind") == "warning", F.when(package != "", F.concat(F.lit("["), package, F.lit("] "), warned)).otherwise(warned))
        .when(F.col("kind") == "box", stripped(F.col("text")))
        .otherwise(F.concat(F.lit("file not found: "), get(tx.MISSING_FILE, 1)))
    )
    line = (
        F.when(F.col("kind") == "file", number(get(tx.FILE_LINE, 2)))
        .when(F.col("kind") == "bang", number(hint))
        .when(F.col("kind") == "warning", number(F.regexp_extract("text", r"on input line (\d+)", 1)))
        .when(F.col("kind") == "box", F.coalesce(number(get(tx.BOXES, 2)), number(get(tx.BOXES, 3))))
    )
    severity = F.when(F.col("kind") == "warning", "warning").when(F.col("kind") == "box", "info").otherwise("error")
    file = F.when(F.col("kind") == "file", get(tx.FILE_LINE, 1))
    found = marked.select("doc_id", "line_no", severity.alias("severity"), message.alias("message"), file.alias("file"), line.alias("line"))
    return first_of(found, ["doc_id", "severity", "message", "line"], "line_no")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row, by order, of each group of equal keys (null equals null). An aggregate, so that a hot group is not sorted."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*(c if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns))


def headings(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title) of the section commands and frames in lines(doc_id, line_no, line); not in comments."""
    kind = F.regexp_extract("line", tx.SECTION, 1)
    levels = F.create_map(*(F.lit(x) for pair in tx.LEVELS.items() for x in pair))
    section, frame = tx.balanced_title(F.regexp_extract("line", tx.SECTION, 2)), tx.balanced_title(F.regexp_extract("line", tx.FRAME, 1))
    level = F.when(kind != "", F.try_element_at(levels, kind)).when(F.col("line").rlike(tx.FRAME), 3)
    title = F.when(kind != "", F.when(section == "", kind).otherwise(section)).otherwise(F.when(frame == "", F.lit("slide")).otherwise(frame))
    found = lines.filter(~F.ltrim(F.col("line")).startswith("%")).withColumn("level", level).filter(F.col("level").isNotNull())
    return found.select("doc_id", "line_no", "level", title.alias("title"))


def outline(found: DataFrame) -> DataFrame:
    """headings with parent_line: the nearest heading before of a lower level, null at the top.

    A running last value for each lower level; the nearest of them all is the parent. One window, no self-join.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(w).alias(f"last_{k}") for k in range(5)]
    seen = found.select("*", *last)
    lower = [F.when(F.col("level") > k, F.col(f"last_{k}")) for k in range(5)]
    return seen.select("doc_id", "line_no", "level", "title", F.array_max(F.array(*lower)).alias("parent_line"))


def lint(lines: DataFrame, silenced: tuple[str, ...] = tx.SILENCED) -> DataFrame:
    """(doc_id, line, code, message) of checker output lines such as 3:1:12:text, without the silenced codes."""
    parts = F.split("line", ":", 4)
    found = lines.withColumn("p", parts).filter((F.size("p") == 4) & F.get("p", F.lit(0)).rlike(r"^\d+$"))
    code = stripped(F.get("p", F.lit(2)))
    return found.filter(~code.isin(*silenced)).select("doc_id", F.get("p", F.lit(0)).try_cast("int").alias("line"), code.alias("code"), stripped(F.get("p", F.lit(3))).alias("message"))


def converter_warnings(texts: DataFrame) -> DataFrame:
    """(doc_id, formulas, others): how many warnings of texts(doc_id, text) are about formulas, and the other ones."""
    each = F.filter(F.transform(F.split("text", r"(?m)^(?=\[WARNING\])"), stripped), lambda x: x != "")
    about = lambda x: F.contains(x, F.lit("Could not convert TeX math"))
    return texts.withColumn("w", each).select("doc_id", F.size(F.filter("w", about)).alias("formulas"), F.filter("w", lambda x: ~about(x)).alias("others"))


def converter_warning_counts(lines: DataFrame) -> DataFrame:
    """(doc_id, formulas, others) as counts, of lines(doc_id, line_no, line); no log is put together."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = F.count(F.when(F.col("line").startswith("[WARNING]"), 1)).over(w)
    filled, about = F.bool_or(stripped(F.col("line")) != ""), F.bool_or(F.col("line").contains("Could not convert TeX math"))
    each = lines.withColumn("part", part).groupBy("doc_id", "part").agg(filled.alias("filled"), about.alias("about"))
    return each.groupBy("doc_id").agg(F.count_if("about").alias("formulas"), F.count_if(F.col("filled") & ~F.col("about")).alias("others"))


def search(texts: DataFrame, pattern: Column | str, *keys: str) -> DataFrame:
    """keys and hits: how often the pattern (a regular expression) occurs in text."""
    return texts.select(*keys, F.regexp_count("text", F.lit(pattern) if isinstance(pattern, str) else pattern).alias("hits"))


def main_sources(files: DataFrame) -> DataFrame:
    """(doc_id, path, text): of files(doc_id, path, text) the longest with a document class and a document body."""
    main = files.filter(F.col("text").contains("\\documentclass") & F.col("text").contains("\\begin{document}"))
    return main.groupBy("doc_id").agg(F.max_by(F.struct("path", "text"), F.struct(F.length("text"), "path")).alias("m")).select("doc_id", "m.path", "m.text")
