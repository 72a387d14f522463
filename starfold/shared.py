"""Intermediate tables that survive the loss of an executor.

Loops and plans with several consumers cut their lineage here. The table is written as
Parquet below ``spark.checkpoint.dir``, the folder that all executors share, and read back.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where all is one machine, a temporary one if the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not _one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _FALLBACK.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='spark-shared-')}")


def _one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back; deleted when the session ends."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join's side that is sorted and merged, never broadcast: the planner takes rows made by a generator, or read from a well packed file, for few."""
    return df.hint("merge")


def parts(df: DataFrame, most: int | None = None) -> int:
    """The session's shuffle partitions, or as many more as give each at most ``most`` rows of ``df``."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // most)) if most else least


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the session's shuffle partitions, so that a generator does not unfold a small file in one task."""
    return df.repartition(parts(df))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application; in local mode they import it as the driver does."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    local = _one_machine(spark) and root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    app = spark.sparkContext.applicationId
    if not local and _FALLBACK.get("shipped") != app:
        base = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-package-")), "starfold")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "starfold"))
        _FALLBACK["shipped"] = app
