"""Intermediate tables in the folder that all executors share, and the shipping of this package to them."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set only where that is unset and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (own := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tidewell/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read again.

    Cuts the lineage: the rows no longer depend on shuffle files of executors that may be lost, nor are they computed twice.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these, once nothing reads it any more."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


def clear(spark: SparkSession) -> None:
    """Delete all that ``stored`` wrote; results that were not saved elsewhere are gone after this."""
    _delete(spark, f"{shared_folder(spark)}/tidewell")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()
#: Rows and bytes that go to a Python worker at once: texts and sets are long, and a batch is held on both sides. The defaults are Spark's.
_ARROW = [("spark.sql.execution.arrow.maxRecordsPerBatch", "2000", "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "16777216b", "67108864b")]


def ship(spark: SparkSession) -> None:
    """Give the executors this package, and their Python workers smaller batches, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    for name, value, default in _ARROW:  # only where the user has not chosen otherwise
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)
    top = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="tidewell-zip-"), "tidewell.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
