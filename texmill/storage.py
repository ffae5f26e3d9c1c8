"""Tables, and intermediate results kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; a cluster may ship it with --py-files instead."""
    home, known = str(Path(__file__).parents[1]), spark.sparkContext.environment
    if home not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(filter(None, [home, known.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; works for any path that Spark can read."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Unset: the warehouse on a cluster, a temporary folder in local mode."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_texmill"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="texmill-")
    return _own[app]


def stash(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have ended before
            return
