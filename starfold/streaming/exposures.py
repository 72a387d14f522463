"""Detection on a stream of exposures: every new exposure's pixels become a catalog of peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stencil as T
from ..plans.multipass import Options

PIXELS = "exposure string, y long, x long, v double"


def detect_exposures(pixels: DataFrame, o: Options = Options()) -> DataFrame:
    """``exposure, y, x, significance`` of the peaks in each exposure of a batch."""
    k = T.gaussian_kernel(2 * int(o.fwhm) + 1, o.fwhm / 2.3548200450309493)
    found = T.matched_filter(pixels, k, keys=("exposure",)).withColumn("significance", F.col("significance") / o.error)
    peaks = T.local_maxima(found, "significance", keys=("exposure",))
    return peaks.where(F.col("significance") >= o.detect_sigma).select("exposure", "y", "x", "significance")


def watch(spark: SparkSession, inbox: str, catalog: str, checkpoint: str, o: Options = Options()) -> StreamingQuery:
    """Detect on each new file of whole exposures in ``inbox`` and add to the ``catalog`` folder, once each.

    A batch has its own folder, so one that is run again after a failure replaces what it wrote.
    """

    def one(batch: DataFrame, number: int) -> None:
        detect_exposures(batch, o).write.mode("overwrite").parquet(f"{catalog}/batch={number}")

    stream = spark.readStream.schema(PIXELS).parquet(inbox)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
