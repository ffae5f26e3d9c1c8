"""Session settings that every query of the package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "6g", **extra: str) -> SparkSession:
    """A session for tests and for the bench; a cluster brings its own master and memory."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("texmill")
    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=conf | extra).getOrCreate()
