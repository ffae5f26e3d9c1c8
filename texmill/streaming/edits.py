"""Edits as a stream: sessions that end after a pause, the latest text of each document, progress lines. Batch twins alike.

Timestamps must be of type timestamp (a file's timestamps without zone are cast). Late edits beyond the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 1) -> DataFrame:
    """The files that arrive in a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def sessions(edits: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n): runs of edits(key, ts) with pauses under gap; one result each, when the pause is over."""
    timed = edits.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if edits.isStreaming else timed
    found = timed.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def latest(edits: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """(key, value) of the last edit of each key; as a stream in update mode, each key's state is one value."""
    return edits.groupBy(key).agg(F.max_by(value, F.col(order)).alias("value"), F.max(order).alias(order))


class Unsaved(StatefulProcessor):
    """Keeps the text of a document until it is saved: (doc_id, text, saved, edited) rows in, the state's text out, null once saved."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.text = handle.getValueState("text", "text string, edited double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        edits = pd.concat(list(rows)).sort_values("edited")
        last = edits.iloc[-1]
        if self.text.exists() and self.text.get()[1] > last["edited"]:
            return
        if bool(last["saved"]):
            self.text.clear()
            yield pd.DataFrame({"doc_id": [key[0]], "text": [None]})
        else:
            self.text.update((last["text"], float(last["edited"])))
            yield pd.DataFrame({"doc_id": [key[0]], "text": [last["text"]]})

    def close(self) -> None:
        return


def unsaved(edits: DataFrame) -> DataFrame:
    """The unsaved text of each document of a stream edits(doc_id, text, saved, edited)."""
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return edits.groupBy("doc_id").transformWithStateInPandas(Unsaved(), "doc_id long, text string", "Update", "None")


def unsaved_now(edits: DataFrame) -> DataFrame:
    """The batch twin of unsaved(): documents whose last edit is not a save, with its text, the oldest first."""
    last = edits.groupBy("doc_id").agg(F.max_by(F.struct("text", "saved", "edited"), "edited").alias("e"))
    return last.filter(~F.col("e.saved")).select("doc_id", "e.text", "e.edited")


def progress(lines: DataFrame) -> DataFrame:
    """(job_id, page, pages, share) of the lines (job_id, line) that tell the page at work."""
    page, pages = (F.regexp_extract("line", r"(?i)page (\d+) of (\d+)", k).try_cast("int") for k in (1, 2))
    return lines.select("job_id", page.alias("page"), pages.alias("pages"), (page / pages).alias("share")).filter("page is not null")


def coalesced(edits: DataFrame, run, checkpoint: str) -> None:
    """run(batch of the documents edited since the last run) once for each trigger: edits while it runs make one more run."""
    query = edits.writeStream.foreachBatch(lambda batch, n: run(batch.select("doc_id").distinct())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
