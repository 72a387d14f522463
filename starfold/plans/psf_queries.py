"""Queries of tabulated, gridded and pixel-integrated profiles, and of fits with fixed parameters and weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fit
from ..operators import psf_models as P
from ..registry import query
from ..sources import bindings as B
from .measure_queries import SCENE, scene

C = F.col
K = 4 * math.log(2)
OVER, HALF = 2, 5  # cells a pixel, and the table's half width in pixels
MID = OVER * HALF
#: Unit-flux value of the tables' rule in a cell (gy, gx) from the middle, for a profile of some width; a little lopsided, so that axes show.
CELL = "4 * ln(2) / (pi() * w * w) * exp(-ln(2) * (gy * gy + gx * gx * 1.2) / (w * w)) * (1 + 0.05 * gy / 10.0)"
TAPS = "tp AS (SELECT a, b FROM (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b))"


def weights(t: str) -> str:
    return f"[(-{t}+2*{t}*{t}-{t}*{t}*{t})/2, (2-5*{t}*{t}+3*{t}*{t}*{t})/2, ({t}+4*{t}*{t}-3*{t}*{t}*{t})/2, (-{t}*{t}+{t}*{t}*{t})/2]"


def slopes(t: str) -> str:
    return f"[(-1+4*{t}-3*{t}*{t})/2, (-10*{t}+9*{t}*{t})/2, (1+8*{t}-9*{t}*{t})/2, (-2*{t}+3*{t}*{t})/2]"


def table(width: float) -> P.Tabulated:
    gy, gx = np.mgrid[-MID : MID + 1, -MID : MID + 1].astype(float)
    return P.Tabulated(K / (math.pi * width**2) * np.exp(-math.log(2) * (gy**2 + 1.2 * gx**2) / width**2) * (1 + 0.05 * gy / 10), OVER)


def offsets(spark: SparkSession, sf: str) -> DataFrame:
    """A pixel near each star: ``dy, dx`` from its place; some lie past the table's edge."""
    return B.stars(spark, sf).select("id", "y", "x", "field", (F.rint("y") - C("y") + C("id") % 13 - 6).alias("dy"), (F.rint("x") - C("x") + F.expr("id div 13") % 11 - 5).alias("dx"))


OFFSETS = f"""{B.STARS}, off AS (SELECT id, y - field * 128 AS y, x, round_even(y, 0) - y + id % 13 - 6 AS dy, round_even(x, 0) - x + id // 13 % 11 - 5 AS dx FROM stars),
  pos AS (SELECT id, y, x, 2 * dy + 10 AS cy, 2 * dx + 10 AS cx, abs(dy) <= 5 AND abs(dx) <= 5 AS ok FROM off),
  cell AS (SELECT *, least(19, CAST(floor(cy) AS INT)) AS i, least(19, CAST(floor(cx) AS INT)) AS j FROM pos), frac AS (SELECT *, cy - i AS t, cx - j AS u FROM cell),
  {TAPS}, tap AS (SELECT f.*, {weights("t")}[a + 1] AS wy, {slopes("t")}[a + 1] * 2 AS sy, {weights("u")}[b + 1] AS wx, {slopes("u")}[b + 1] * 2 AS sx,
    least(20, greatest(0, i + a - 1)) - 10.0 AS gy, least(20, greatest(0, j + b - 1)) - 10.0 AS gx FROM frac f, tp WHERE ok)"""


@query("psf_tabulated", f"""WITH {OFFSETS}, s AS (SELECT id, sum(c * wy * wx) AS v, sum(c * sy * wx) AS vy, sum(c * wy * sx) AS vx FROM (SELECT *, {CELL} AS c FROM (SELECT *, 3.0 AS w FROM tap)) GROUP BY id)
  SELECT id, round(coalesce(v, 0.0), 9) + 0.0 AS light, round(coalesce(-vy, 0.0), 9) + 0.0 AS light_y, round(coalesce(-vx, 0.0), 9) + 0.0 AS light_x FROM pos LEFT JOIN s USING (id)""")
def psf_tabulated(spark: SparkSession, sf: str) -> DataFrame:
    """A tabulated profile and its slopes at a pixel of each star."""
    found = P.with_light(offsets(spark, sf), table(3.0))
    return found.select("id", *[F.round(c, 9).alias(c) for c in ("light", "light_y", "light_x")])


def gridded() -> P.Gridded:
    """Sixteen tables at places 40 pixels apart, wider along y and x."""
    at = [(i, j) for i in range(4) for j in range(4)]
    return P.Gridded([table(2.5 + 0.1 * i + 0.2 * j) for i, j in at], [1.0 + 40 * i for i, _ in at], [1.0 + 40 * j for _, j in at])


@query("psf_gridded", f"""WITH {OFFSETS}, node AS (SELECT *, least(2, greatest(0, CAST(floor((y - 1) / 40) AS INT))) AS ni, least(2, greatest(0, CAST(floor((x - 1) / 40) AS INT))) AS nj FROM tap),
  part AS (SELECT *, (y - 1) / 40 - ni AS p, (x - 1) / 40 - nj AS q FROM node), corner AS (SELECT part.*, a, b, least(1.0, greatest(0.0, p)) AS pc, least(1.0, greatest(0.0, q)) AS qc, 2.5 + 0.1 * (ni + a) + 0.2 * (nj + b) AS w FROM part, (SELECT a, b FROM tp WHERE a < 2 AND b < 2)),
  bl AS (SELECT *, CASE WHEN a = 1 THEN pc ELSE 1 - pc END AS fy, CASE WHEN b = 1 THEN qc ELSE 1 - qc END AS fx, CASE WHEN p BETWEEN 0 AND 1 THEN (2 * a - 1) / 40.0 ELSE 0 END AS ey, CASE WHEN q BETWEEN 0 AND 1 THEN (2 * b - 1) / 40.0 ELSE 0 END AS ex, {CELL} AS c FROM corner),
  s AS (SELECT id, sum(c * fy * fx * wy * wx) AS v, sum(c * (ey * fx * wy * wx - fy * fx * sy * wx)) AS vy, sum(c * (fy * ex * wy * wx - fy * fx * wy * sx)) AS vx FROM bl GROUP BY id)
  SELECT id, round(coalesce(v, 0.0), 9) + 0.0 AS light, round(coalesce(vy, 0.0), 9) + 0.0 AS light_y, round(coalesce(vx, 0.0), 9) + 0.0 AS light_x FROM pos LEFT JOIN s USING (id)""")
def psf_gridded(spark: SparkSession, sf: str) -> DataFrame:
    """A profile that varies over the field, blended from its nodes; the slopes hold the change of the blend."""
    at = offsets(spark, sf).withColumn("y", C("y") - C("field") * B.SIDE)
    return P.with_light(at, gridded()).select("id", *[F.round(c, 9).alias(c) for c in ("light", "light_y", "light_x")])


def unit_sql(a: str, fwhm: str) -> str:
    """Simpson's rule with 2,000 steps over the unit interval around ``a``."""
    return f"list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END) * exp(-4 * ln(2) * pow(({a} - 0.5 + k / 2000.0) / {fwhm}, 2)))) / 6000.0 * sqrt(4 * ln(2) / pi()) / {fwhm}"


@query("psf_pixel_gaussian", f"""WITH {B.STARS}, o AS (SELECT id, y - round_even(y, 0) + id % 5 - 2 AS dy, x - round_even(x, 0) + id % 3 - 1 AS dx, CAST(id % 180 AS DOUBLE) AS t, 1.5 + id % 4 * 0.5 AS h, 2.0 + id % 3 * 0.5 AS w FROM stars),
  e AS (SELECT *, dx * cos(radians(t)) + dy * sin(radians(t)) AS u, dy * cos(radians(t)) - dx * sin(radians(t)) AS v FROM o)
  SELECT id, round(({unit_sql("u", "w")}) * ({unit_sql("v", "h")}), 9) AS turned, round(({unit_sql("dx", "w")}) * ({unit_sql("dy", "w")}), 9) AS circular FROM e""")
def psf_pixel_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel-integrated Gaussians, turned and circular."""
    o = B.stars(spark, sf).select("id", (C("y") - F.rint("y") + C("id") % 5 - 2).alias("dy"), (C("x") - F.rint("x") + C("id") % 3 - 1).alias("dx"), (C("id") % 180).cast("double").alias("t"), (1.5 + C("id") % 4 * 0.5).alias("h"), (2.0 + C("id") % 3 * 0.5).alias("w"))
    turned, circular = P.pixel_gaussian(C("dy"), C("dx"), C("h"), C("w"), C("t")), P.pixel_gaussian(C("dy"), C("dx"), C("w"), C("w"), F.lit(0.0))
    return o.select("id", F.round(turned, 9).alias("turned"), F.round(circular, 9).alias("circular"))


IV = "CASE WHEN (y * 3 + x) % 17 = 0 THEN 0.0 ELSE 1.0 / (1 + x % 3) END"


@query("fit_fixed_shape", f"""WITH {SCENE}, wt AS (SELECT y, x, v, {IV} AS iv FROM scene), p AS (SELECT id, v, iv, 4 * ln(2) / (pi() * 9.0) * exp(-4 * ln(2) * (dy * dy + dx * dx) / 9.0) AS m FROM so JOIN wt ON so.py = wt.y AND so.px = wt.x WHERE iv > 0 AND abs(py - round_even(so.y, 0)) <= 5 AND abs(px - round_even(so.x, 0)) <= 5),
  s AS (SELECT id, count(*) AS n, sum(iv) AS s0, sum(iv * m) AS s1, sum(iv * m * m) AS s2, sum(iv * v) AS t0, sum(iv * m * v) AS t1, sum(iv * v * v) AS tt FROM p GROUP BY id), d AS (SELECT *, s0 * s2 - s1 * s1 AS det FROM s),
  r AS (SELECT *, (s0 * t1 - s1 * t0) / det AS flux, (s2 * t0 - s1 * t1) / det AS bkg FROM d)
  SELECT id, round(flux, 3) AS flux, round(bkg, 4) AS bkg, round(sqrt(s0 / det), 5) AS flux_err, round(sqrt(s2 / det), 6) AS bkg_err, round((tt - flux * t1 - bkg * t0) / (n - 2), 3) AS chisq FROM r""")
def fit_fixed_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Fluxes at given places with a given width, by weighted pixels: position and width are fixed, flux and sky are fitted."""
    iv = F.when((C("y") * 3 + C("x")) % 17 == 0, 0.0).otherwise(1.0 / (1 + C("x") % 3))
    image = scene(spark, sf).select("y", "x", "v", iv.alias("iv"))
    sources = B.references(spark, sf).select("id", "y", "x", (C("flux") * 0.7).alias("flux"), F.lit(40.0).alias("bkg"))
    found = fit.fit_stars(sources, image, "gaussian", weight="iv", fixed={"y": None, "x": None, "fwhm": 3.0})
    return found.select("id", F.round("flux", 3).alias("flux"), F.round("bkg", 4).alias("bkg"), F.round("flux_err", 5).alias("flux_err"), F.round("bkg_err", 6).alias("bkg_err"), F.round("chisq", 3).alias("chisq"))
