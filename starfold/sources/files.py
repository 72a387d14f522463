"""Readers of image and calibration files, and the plan folder of tiled runs."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

#: Pixel scale and infinite aperture, in arcsec, and whether a table's radii are in arcsec.
INSTRUMENTS = {"WFC": (0.05, 5.5, False), "HRC": (0.025, 5.5, False), "SBC": (0.03, 4.0, True)}


def read_npy(spark: SparkSession, path: str, rows: int = 512) -> DataFrame:
    """``path, y, x, v`` from NPY files of two-dimensional arrays; slices of rows keep batches small."""

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                image = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, image.shape[0], rows):
                    part = image[at : at + rows].astype(float)
                    y, x = np.indices(part.shape)
                    yield pd.DataFrame({"path": name, "y": y.ravel() + at + 1, "x": x.ravel() + 1, "v": part.ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unfold, "path string, y long, x long, v double")


def parse_energy_table(lines: DataFrame) -> DataFrame:
    """``filter, k, r, ee`` from the lines (``value``) of an encircled-energy table.

    Lines that start with # are comments; the first other line starts with -999.0 and has the radii.
    """
    cells = lines.select(F.split(F.trim(F.col("value")), r"\s+").alias("c")).where(~F.get("c", F.lit(0)).startswith("#") & (F.get("c", F.lit(0)) != ""))
    long = cells.select(F.get("c", F.lit(0)).alias("filter"), F.posexplode(F.slice("c", 2, F.size("c") - 1)).alias("k", "s")).select("filter", "k", C("s").cast("double").alias("u"))
    radii = long.where(C("filter") == "-999.0").select("k", C("u").alias("r"))
    return long.where(C("filter") != "-999.0").join(F.broadcast(radii), "k").select("filter", "k", "r", C("u").alias("ee"))


def reference_curve(table: DataFrame, instrument: str) -> DataFrame:
    """``filter, r, ee`` in pixels: radii past the infinite aperture left out, its end point put in."""
    if instrument not in INSTRUMENTS:
        raise ValueError(f"unknown instrument {instrument}; known: {', '.join(INSTRUMENTS)}")
    scale, infinite, arcsec = INSTRUMENTS[instrument]
    end = infinite / scale
    inside = table.select("filter", (C("r") / scale if arcsec else C("r")).alias("r"), "ee").where(C("r") <= end)
    last = inside.groupBy("filter").agg(F.max("r").alias("m")).where(C("m") < end).select("filter", F.lit(end).alias("r"), F.lit(1.0).alias("ee"))
    return inside.unionByName(last)


def read_energy_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_energy_table(spark.read.text(path))


def plan_tiles(images: DataFrame, core: int, halo: int) -> DataFrame:
    """One row for each tile of each image (``image, ny, nx``): core, padded box, and the identity hash of its inputs."""
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((C(n) - 1) / core)))
    t = images.select("*", span("ny").alias("ty")).select("*", span("nx").alias("tx"))
    box = {"r0": C("ty") * core + 1, "r1": F.least(C("ty") * core + core, C("ny")), "c0": C("tx") * core + 1, "c1": F.least(C("tx") * core + core, C("nx"))}
    t = t.withColumns({k: v.cast("long") for k, v in box.items()})
    t = t.withColumns({"p0": F.greatest(F.lit(1).cast("long"), C("r0") - halo), "p1": F.least(C("r1") + halo, C("ny").cast("long"))})
    key = F.concat_ws("|", "image", "r0", "r1", "c0", "c1", "p0", "p1")
    return t.withColumn("hash", F.sha2(key, 256))


def absent(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Planned tiles without a result of the same hash."""
    return plan.join(results.select("hash").distinct(), "hash", "left_anti")


def write_catalog(catalog: DataFrame, path: str, by: str | None = None) -> None:
    """A catalog as Parquet, one folder for each value of ``by``."""
    out = catalog.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)
