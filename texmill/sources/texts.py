"""Sources and sinks of texts: bytes in unknown encodings, files that include others, lists, unique names, atomic tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType

from texmill.functions.markdown import stripped

INCLUDE = r"\\(?:input|include|subfile)\s*\{([^}]*)\}"


def flattened(files: DataFrame, root: str | Column, depth: int = 8) -> DataFrame:
    """(doc_id, text): the root file of each document with the files that it includes put in place; unknown ones are empty.

    files(doc_id, path, text). A document's sources go together as one map, resolved by text folds, one for each level.
    """
    at = F.lit(root) if isinstance(root, str) else root
    packed = files.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("by_path"))
    out = packed.withColumn("text", F.coalesce(F.try_element_at("by_path", at), F.lit("")))

    def resolved(acc: Column, found: Column) -> Column:
        name = stripped(F.regexp_extract(found, INCLUDE, 1))
        path = F.when(name.endswith(".tex"), name).otherwise(F.concat(name, F.lit(".tex")))
        return F.replace(acc, found, F.coalesce(F.try_element_at("by_path", path), F.lit("")))

    for _ in range(depth):
        calls = F.array_distinct(F.regexp_extract_all("text", F.lit(INCLUDE), F.lit(0)))
        out = out.withColumn("text", F.aggregate(calls, F.col("text"), resolved))
    return out.select("doc_id", F.regexp_replace("text", INCLUDE, "").alias("text"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(id): the lines of a text file without comments and blanks."""
    return ids(spark.read.text(path).withColumnRenamed("value", "line"))


def ids(lines: DataFrame) -> DataFrame:
    """(id) of lines(line): what stands before a #, if anything."""
    return lines.select(stripped(F.substring_index("line", "#", 1)).alias("id")).filter("id <> ''")


def _decoded(data: bytes) -> tuple[str, str, str]:
    """(text, encoding, line end): a mark decides, then UTF-8, then what the text declares, then the common code pages."""
    import re

    text = encoding = None
    if data.startswith(b"\xef\xbb\xbf"):
        text, encoding = data[3:].decode("utf-8", "replace"), "utf-8-sig"
    else:
        said = re.search(rb"\\usepackage\[([\w-]+)\]\{inputenc\}", data)
        named = {b"latin1": "latin-1", b"ansinew": "cp1252", b"cp1252": "cp1252", b"latin9": "iso8859-15", b"utf8": "utf-8"}
        for name in ("utf-8", named.get(said[1].lower(), "cp1252") if said else "cp1252", "latin-1"):
            try:
                text, encoding = data.decode(name), name
                break
            except UnicodeDecodeError:
                continue
    newline = "crlf" if "\r\n" in text else "cr" if "\r" in text else "lf"
    return text.replace("\r\n", "\n").replace("\r", "\n"), encoding, newline


def decoded(blobs: DataFrame) -> DataFrame:
    """blobs(path, content binary) as (path, text, encoding, newline); line ends become line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_decoded(b or b"") for b in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], names=["path", "text", "encoding", "newline"])

    return blobs.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "path string, text string, encoding string, newline string")


def encoded(text: Column, encoding: Column, newline: Column) -> Column:
    """The bytes of a text in its own encoding and line end; fails where the encoding cannot hold a character. Null gives null."""

    @F.arrow_udf(BinaryType())
    def run(texts: pa.Array, encodings: pa.Array, newlines: pa.Array) -> pa.Array:
        ends = {"crlf": "\r\n", "cr": "\r"}
        rows = zip(texts.to_pylist(), encodings.to_pylist(), newlines.to_pylist(), strict=True)
        return pa.array([None if t is None else t.replace("\n", ends.get(n, "\n")).encode(e or "utf-8") for t, e, n in rows], pa.binary())

    return run(text, encoding, newline)


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def docx_parts(blobs: DataFrame) -> DataFrame:
    """(path, document_xml, media) of blobs(path, content) that are zipped documents; null XML for what cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for batch in batches:
            xml, media = [], []
            for data in batch.column("content").to_pylist():
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        xml.append(z.read("word/document.xml").decode("utf-8", "replace"))
                        media.append([n for n in z.namelist() if n.startswith("word/media/")])
                except (zipfile.BadZipFile, KeyError):
                    xml.append(None)
                    media.append([])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(xml, pa.string()), pa.array(media, pa.list_(pa.string()))], names=["path", "document_xml", "media"])

    return blobs.select("path", "content").mapInArrow(run, "path string, document_xml string, media array<string>")


def unique_names(rows: DataFrame) -> DataFrame:
    """rows(path, pos) with name: the path, or where an earlier row has that path its stem with the next number that gives a
    name which no row's path is. Numbers count on, so the names of one path differ; names of other paths have other stems."""
    n = F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1
    stem, suffix = F.regexp_extract("path", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("path", r"^(.*?)(\.[^.]*)?$", 2)
    numbered = F.regexp_extract("path", r"^(.*)_([1-9]\d*)(\.[^.]*)?$", 2).try_cast("int")
    plain = F.regexp_replace("path", r"_[1-9]\d*((?:\.[^.]*)?)$", "$1")
    taken = rows.filter(numbered.isNotNull()).groupBy(plain.alias("_plain")).agg(F.array_sort(F.collect_set(numbered)).alias("_taken"))
    counted = rows.withColumn("_n", n).join(taken, F.col("path") == F.col("_plain"), "left")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), lambda k, t: F.when((F.col("_n") > 0) & (t <= k), k + 1).otherwise(k))
    name = F.when(F.col("_n") == 0, F.col("path")).otherwise(F.concat(stem, F.lit("_"), free.cast("string"), suffix))
    return counted.select(*rows.columns, name.alias("name"))


def write_table(rows: DataFrame, path: str, keep: str = "errorifexists") -> None:
    """rows as Parquet; the commit protocol makes the files appear together, and existing results are never overwritten."""
    rows.write.mode(keep).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """report(mode, kind, ...) as JSON, a folder for each mode; modes that the report does not have stay as they are."""
    spark = report.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        report.write.mode("overwrite").partitionBy("mode").json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def appendix(text: Column, comments: Column) -> Column:
    """text with comment lines put before its last \\end{document}; unchanged without comments or without that end."""
    lines = F.concat(F.array_join(F.transform(comments, lambda c: F.concat(F.lit("% "), F.replace(c, F.lit("\n"), F.lit("\n% ")))), "\n"), F.lit("\n"))
    end = "\\end{document}"
    after = F.substring_index(text, end, -1)
    before = F.substr(text, F.lit(1), F.length(text) - F.length(after) - len(end))
    return F.when(F.contains(text, F.lit(end)) & (F.size(comments) > 0), F.concat(before, lines, F.lit(end), after)).otherwise(text)
