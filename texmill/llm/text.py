"""What several operators share: the white space that separates words, and native expressions on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from texmill.storage import reachable

#: The six characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(text, F.lit(""))


def column(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, with_text: bool = True) -> Column:
    """All columns of docs (text only if asked for) as one struct _doc, so that no name of theirs can clash."""
    return F.struct(*(column(c) for c in docs.columns if with_text or c != "text")).alias("_doc")


def doc_schema(rows: DataFrame, *fields: tuple[str, DataType]) -> StructType:
    """_doc as rows have it, then the fields."""
    return StructType([rows.schema["_doc"], *(StructField(name, kind) for name, kind in fields)])


def words(text: Column) -> Column:
    """Array of the words of a text that is not null; empty if it has none."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def id_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, mod by; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by, F.lit(0))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small in a Python worker even where all texts are long; the same for all operators, as results are lazy."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
