"""Windowed statistics of event streams.

Each function takes a streaming (or batch) frame with ``ts, event_type, value, user_id``. ``drain``
runs a stream over what is there now and returns its last result as a table in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

C = F.col
STAMP = "yyyy-MM-dd HH:mm:ss"


def events(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """A stream over the event files of a folder; watermarks need times with a zone, the session's."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).withColumn("ts", C("ts").cast("timestamp"))


def tumbling(stream: DataFrame, length: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums for each event type in windows that follow one another."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.date_format("window.start", STAMP).alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, length: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Counts and largest values in overlapping windows."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return w.select(F.date_format("window.start", STAMP).alias("start"), "n", "most")


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of ``gap``."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.date_format("session_window.start", STAMP).alias("start"), "user_id", "n")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The result once all files there now are read: each batch replaces the table (complete) or adds to it (append)."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        target = f"{base}/table" if mode == "complete" else f"{base}/table/batch={number}"  # a batch that runs again writes the same place
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(schema).parquet(f"{base}/table")
