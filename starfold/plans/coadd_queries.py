"""Coadds of exposures that the vectors' rows make up: scaled drops, rejection by weighted medians, noise maps, rotated drops."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coadd as K
from ..registry import query
from ..sources import bindings as B
from .robust_queries import PX

C = F.col
EXTENT = 2.0**40  # a power of two, so that dividing by it is exact
IMAGES = 12

EXPOSURES = f"""{PX}, e AS (SELECT CAST((y - 1) % 12 AS BIGINT) AS image, CAST((y - 1) // 12 + 1 AS BIGINT) AS y, CAST(x AS BIGINT) AS x, v AS data, v / 8 + 0.01 * (y % 7) AS background, 0.02 * (x % 5) AS model, 0.1 + 0.01 * (y % 12) AS rms, CAST(64 - x % 3 AS DOUBLE) AS weight FROM px),
  im AS (SELECT i AS image, i % 2 AS band, 1 + i / 16 AS flux_scale, (i % 4) * 0.25 AS ty, (i % 3) * 0.25 AS tx FROM (SELECT unnest(range(0, 12)) AS i))"""


def drops_sql(p: float) -> str:
    """Axis-aligned drops of side ``p`` on nodes half a pixel wide."""
    side = lambda at, t, of: f"greatest(0.0, least(0.5 * {at} + {t} + 0.25, {of} + {p} / 2) - greatest(0.5 * {at} + {t} - 0.25, {of} - {p} / 2))"
    near = lambda of, t: f"unnest(range(CAST(floor(2 * ({of} - {t})) AS BIGINT) - 2, CAST(floor(2 * ({of} - {t})) AS BIGINT) + 4))"
    return f"""n AS (SELECT e.*, band, flux_scale, ty, tx, {near("e.y", "ty")} AS r FROM e JOIN im USING (image)), m AS (SELECT *, {near("x", "tx")} AS c FROM n),
  d AS (SELECT *, {side("r", "ty", "y")} * {side("c", "tx", "x")} / 0.25 AS a, 0.25 AS f, 0.25 / flux_scale AS fu FROM m WHERE {side("r", "ty", "y")} * {side("c", "tx", "x")} > 0)"""


def exposures(spark: SparkSession, sf: str) -> DataFrame:
    """``image, y, x, data, background, model, rms, weight``: row k of the vectors is a row of image k mod 12."""
    p = B.pixels(spark, sf)
    return p.select(((C("y") - 1) % IMAGES).alias("image"), F.expr(f"(y - 1) div {IMAGES} + 1").alias("y"), "x", C("v").alias("data"), (C("v") / 8 + 0.01 * (C("y") % 7)).alias("background"), (0.02 * (C("x") % 5)).alias("model"), (0.1 + 0.01 * (C("y") % IMAGES)).alias("rms"), (64 - C("x") % 3).cast("double").alias("weight"))


def maps(spark: SparkSession, turn: float = 0.0, scale: float = 0.5) -> DataFrame:
    """Twelve images of two bands on a grid of ``scale`` image pixels, each shifted, and turned by ``turn`` times its number."""
    rows = []
    for i in range(IMAGES):
        co, si = math.cos(turn * i) * scale * EXTENT, math.sin(turn * i) * scale * EXTENT
        rows.append((i, i % 2, 1 + i / 16, [[(i % 4) * 0.25, si], [co]], [[(i % 3) * 0.25, co], [-si]], 0.0, 0.0, EXTENT))
    return spark.createDataFrame(rows, "image long, band long, flux_scale double, my array<array<double>>, mx array<array<double>>, r0 double, c0 double, extent double")


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("coadd_scaled", f"""{EXPOSURES}, {drops_sql(0.8)}, g AS (SELECT band, r, c, image, sum(a / (rms * rms) / (fu * fu)) AS w, sum(a * a / (rms * rms) / (fu * fu)) AS v, sum(a / (rms * rms) / fu * data) AS sd, sum(a / (rms * rms) / fu * background) AS sb, sum(a / (rms * rms) / fu * model) AS sm FROM d GROUP BY band, r, c, image)
  SELECT band, r, c, round(sum(sd) / sum(w), 6) AS data, round(sum(sb) / sum(w), 6) AS background, round(sum(sm) / sum(w), 6) AS model, round(sum(sd - sb - sm) / sum(w), 6) AS residual, round(sqrt(sum(v)) / sum(w), 6) AS rms, round(sum(w), 3) AS weight, count(*) AS nimg FROM g GROUP BY band, r, c""")
def coadd_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Shrunken drops on a grid twice as fine: means, noise, weight and depth for each band."""
    out = K.coadd(exposures(spark, sf), maps(spark), ("data", "background", "model", "residual", "rms", "weight", "nimg"), pixfrac=0.8)
    return r6(out, "data", "background", "model", "residual", "rms").withColumn("weight", F.round("weight", 3))


@query("coadd_weighted_clip", f"""{EXPOSURES}, {drops_sql(1.0)}, g AS (SELECT band, r, c, image, sum(a / (rms * rms) / (fu * fu)) AS w, sum(a / (rms * rms) / fu * data) AS sd, sum(a * weight / (fu * fu)) AS wi, sum(a * a * weight / (fu * fu)) AS vi, sum(a * weight / fu * (data - background - model)) AS sr, sum(a * weight / fu * model) AS sm FROM d GROUP BY band, r, c, image),
  x AS (SELECT band, r, c, image, round(sr / wi, 12) AS x, vi / (wi * wi) + 0.003 * greatest(sm / wi, 0) * greatest(sm / wi, 0) AS v FROM g),
  q AS (SELECT *, sum(1 / v) OVER (PARTITION BY band, r, c ORDER BY x) AS run, sum(1 / v) OVER (PARTITION BY band, r, c) AS p, count(*) OVER (PARTITION BY band, r, c) AS n FROM x),
  z AS (SELECT *, min(CASE WHEN run >= p / 2 THEN x END) OVER (PARTITION BY band, r, c) AS med FROM q),
  bad AS (SELECT DISTINCT band, r + i AS r, c + j AS c, image FROM z, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE n >= 5 AND (x - med) * (x - med) > 1.44 * (v + pi() / 2 / p))
  SELECT band, r, c, round(sum(sd) / sum(w), 6) AS data, count(*) AS nimg FROM g WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.band = g.band AND bad.r = g.r AND bad.c = g.c AND bad.image = g.image) GROUP BY band, r, c""")
def coadd_weighted_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Images far from the weighted median of their stack, and one node around, are left out of the mean."""
    return r6(K.coadd(exposures(spark, sf), maps(spark), ("data", "nimg"), clip=1.2), "data")


@query("coadd_noise", f"""{EXPOSURES}, {drops_sql(1.0)}, t AS (SELECT band, r, c, sum(a / (rms * rms) / (fu * fu)) AS w, sum(a * a / (rms * rms) / (fu * fu)) AS v FROM d GROUP BY band, r, c),
  g AS (SELECT image, y, x, sum(a / w) AS g FROM d JOIN t USING (band, r, c) GROUP BY image, y, x), q AS (SELECT band, r, c, sum(a / (rms * rms) / (fu * fu) * 0.25 * g * g) AS va FROM d JOIN g USING (image, y, x) GROUP BY band, r, c)
  SELECT band, r, c, round(sqrt(v) / w, 6) AS rms, round(sqrt(va), 6) AS rms_aperture FROM t JOIN q USING (band, r, c)""")
def coadd_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Noise of single nodes, and that which holds for sums over wide areas."""
    return r6(K.coadd(exposures(spark, sf), maps(spark), ("rms", "rms_aperture")), "rms", "rms_aperture")


@query("coadd_rotated", None)
def coadd_rotated(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve orientations on one grid, in surface brightness."""
    return r6(K.coadd(exposures(spark, sf), maps(spark, turn=0.1, scale=0.7), ("data", "residual", "rms", "nimg"), pixfrac=0.9, brightness=(40.0, 32.0, 0.11)), "data", "residual", "rms")
