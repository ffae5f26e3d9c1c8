"""The conversion registry as a table, and what batches of files can become. Programs outside Spark stay outside: a
conversion that needs one is listed with its needs and reported as unavailable, never imitated."""

from __future__ import annotations

import shutil

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Key, source suffix, target suffix, program, accepted options; in order of use.
CONVERSIONS = (
    ("pdf2docx", ".pdf", ".docx", "pandoc", "pages extract_images math_reconstruction math_ocr ocr_backend toc keep_latex reference_doc"),
    ("pdf2tex", ".pdf", ".tex", "pandoc", "pages twocolumn extract_images math_reconstruction display_equations math_ocr ocr_backend keep_markdown"),
    ("tex2pdf", ".tex", ".pdf", "pdflatex", "engine clean_aux max_passes synctex"),
    ("tex2docx", ".tex", ".docx", "pandoc", "toc number_sections reference_doc"),
    ("docx2tex", ".docx", ".tex", "pandoc", "twocolumn extract_images"),
    ("docx2pdf", ".docx", ".pdf", "soffice", "via_latex engine"),
)


def registry(spark: SparkSession) -> DataFrame:
    """(pos, key, source, target, program, options, available) of the conversions."""
    rows = [(i, *c[:4], c[4].split(), shutil.which(c[3]) is not None) for i, c in enumerate(CONVERSIONS)]
    return spark.createDataFrame(rows, "pos int, key string, source string, target string, program string, options array<string>, available boolean")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def conversion_of(files: DataFrame, target: str) -> DataFrame:
    """files(path) with the key of the first conversion to target, null if there is none."""
    known = F.broadcast(registry(files.sparkSession).filter(F.col("target") == target).groupBy("source").agg(F.min_by("key", "pos").alias("key")))  # a row a suffix
    return files.withColumn("source", suffix(F.col("path"))).join(known, "source", "left").drop("source")


def common_targets(files: DataFrame) -> DataFrame:
    """(batch_id, targets): formats that every file of files(batch_id, pos, path) can become, in the order of the first file."""
    known = F.broadcast(registry(files.sparkSession).select("source", "target", F.col("pos").alias("rank")))  # six rows
    each = files.withColumn("source", suffix(F.col("path"))).join(known, "source", "left")
    total = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("path", "pos").alias("path"))
    able = each.filter("target is not null").groupBy("batch_id", "target").agg(F.count(F.lit(1)).alias("able"))
    first = total.withColumn("source", suffix(F.col("path"))).join(known, "source", "left").select("batch_id", "n", "target", "rank")
    kept = first.join(able, ["batch_id", "target"], "left").groupBy("batch_id")
    ordered = F.array_sort(F.collect_list(F.when(F.col("able") == F.col("n"), F.struct("rank", "target"))))
    return kept.agg(F.transform(ordered, lambda x: x["target"]).alias("targets"))


def accepted(key: Column, options: Column) -> Column:
    """The options of a map that a conversion takes; the others are dropped."""
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for c in CONVERSIONS for x in (c[0], c[4].split())))
    return F.map_filter(options, lambda name, _: F.array_contains(F.try_element_at(table, key), name))


def batch_status(jobs: DataFrame) -> DataFrame:
    """(batch_id, done, failed, cancelled, total, exit_code) of jobs(batch_id, state); a failure does not stop the others."""
    n = lambda s: F.count_if(F.col("state") == s)
    return jobs.groupBy("batch_id").agg(n("done").alias("done"), n("failed").alias("failed"), n("cancelled").alias("cancelled"), F.count(F.lit(1)).alias("total"), F.when(n("failed") > 0, 1).otherwise(0).alias("exit_code"))


def numbered(jobs: DataFrame) -> DataFrame:
    """jobs with label: k of n within their batch."""
    w = Window.partitionBy("batch_id")
    return jobs.withColumn("label", F.concat_ws(" of ", F.row_number().over(w.orderBy("pos")).cast("string"), F.count(F.lit(1)).over(w).cast("string")))


def outcomes(jobs: DataFrame, run) -> DataFrame:
    """jobs with ok, result and error of run(job row as a dict), each job for itself: expected errors become rows."""
    from collections.abc import Iterator

    import pandas as pd

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    out.append((True, str(run(row)), None, None))
                except Exception as e:
                    out.append((False, None, type(e).__name__, str(e)))
            yield frame.assign(**dict(zip(("ok", "result", "error_class", "error"), map(list, zip(*out, strict=True)) if out else [[]] * 4, strict=True)))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema)
    return jobs.mapInPandas(each, f"{ddl}, ok boolean, result string, error_class string, error string")
