"""The background's covariance by cell and lag, looked up by sources, and the step that uses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import covariance as V
from ..operators import normal as N
from ..registry import query
from ..sources import bindings as B
from .measure_queries import SCENE, scene
from .robust_queries import PX

C = F.col
BOX, REACH, FWHM = 16, 4, 3.0
LENGTHS = [1.0, 2.0, 4.0, 8.0]
ACF = "exp(-2 * ln(2) * (dy * dy + dx * dx) / 9.0)"
LAGS = ", ".join(f"({dy}, {dx})" for dy, dx in V.fitted_lags(REACH))
CELLS = f"""{PX}, g AS (SELECT y, x, v AS r, 100.0 + (y + x) % 7 AS iv, (y - 1) // 16 AS ci, (x - 1) // 16 AS cj FROM px WHERE (y * 5 + x) % 11 <> 0), lag(dy, dx) AS (VALUES {LAGS}),
  one AS (SELECT ci, cj, sum(r) AS sr, count(*) AS nv, sum(1 / iv) AS nn FROM g GROUP BY ci, cj),
  pr AS (SELECT p.ci, p.cj, dy, dx, sum(p.r * q.r) AS s, sum(p.r) AS a1, sum(q.r) AS a2, count(*) AS np FROM g p, lag, g q WHERE q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.ci, p.cj, dy, dx),
  cells AS (SELECT i AS ci, j AS cj FROM (SELECT unnest(range(0, (SELECT max(ci) + 1 FROM g))) AS i), (SELECT unnest(range(0, (SELECT max(cj) + 1 FROM g))) AS j)),
  wo AS (SELECT c.ci, c.cj, sum(sr) / sum(nv) AS mean, sum(nn) / sum(nv) AS noise FROM cells c JOIN one o ON o.ci BETWEEN c.ci - 1 AND c.ci + 1 AND o.cj BETWEEN c.cj - 1 AND c.cj + 1 GROUP BY c.ci, c.cj),
  wp AS (SELECT c.ci, c.cj, dy, dx, sum(s) AS s, sum(a1) AS a1, sum(a2) AS a2, sum(np) AS np FROM cells c JOIN pr o ON o.ci BETWEEN c.ci - 1 AND c.ci + 1 AND o.cj BETWEEN c.cj - 1 AND c.cj + 1 GROUP BY c.ci, c.cj, dy, dx),
  cov AS (SELECT ci, cj, dy, dx, (s - mean * (a1 + a2) + np * mean * mean) / np - CASE WHEN dy = 0 AND dx = 0 THEN noise ELSE 0 END AS c FROM wp JOIN wo USING (ci, cj)),
  t AS (SELECT ci, cj, ell, c, {ACF} AS u, exp(-(dy * dy + dx * dx) / (2 * ell * ell)) AS v FROM cov, (SELECT unnest({LENGTHS}) AS ell)),
  n AS (SELECT ci, cj, ell, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * c) AS uc, sum(v * c) AS vc, sum(c * c) AS cc FROM t GROUP BY ci, cj, ell),
  opts AS (SELECT ci, cj, ell, unnest([0.0, greatest(uc / uu, 0.0), 0.0, (vv * uc - uv * vc) / (uu * vv - uv * uv)]) AS a, unnest([0.0, 0.0, greatest(vc / vv, 0.0), (uu * vc - uv * uc) / (uu * vv - uv * uv)]) AS b, uu, uv, vv, uc, vc, cc FROM n),
  fits AS (SELECT ci, cj, ell, a, b, cc - 2 * a * uc - 2 * b * vc + a * a * uu + 2 * a * b * uv + b * b * vv AS res FROM opts WHERE a >= 0 AND b >= 0),
  model AS (SELECT ci, cj, ell, a, b FROM fits QUALIFY row_number() OVER (PARTITION BY ci, cj ORDER BY res, ell) = 1)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    px = B.pixels(spark, sf).select("y", "x", C("v").alias("r"), (100.0 + (C("y") + C("x")) % 7).alias("iv"), ((C("y") * 5 + C("x")) % 11 != 0).alias("valid"))
    return V.cell_covariances(px, BOX, REACH, V.gaussian_acf(FWHM), lengths=LENGTHS)


@query("covariance_cells", f"{CELLS} SELECT ci, cj, round(a, 6) AS a, round(b, 6) AS b, CASE WHEN round(b, 6) = 0 THEN 0.0 ELSE ell END AS ell FROM model")
def covariance_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of profile-shaped and of smooth structure in each cell, and the length of the latter where there is any."""
    found = cells(spark, sf).select("ci", "cj", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "ell")
    return found.withColumn("ell", F.when(C("b") == 0, 0.0).otherwise(C("ell")))


@query("covariance_lags", f"""{CELLS}, {B.STARS}, m AS (SELECT max(ci) AS mi, max(cj) AS mj FROM model), s AS (SELECT id, greatest(0, least((CAST(round_even(y, 0) AS BIGINT) - 1) // 16, mi)) AS ci, greatest(0, least((CAST(round_even(x, 0) AS BIGINT) - 1) // 16, mj)) AS cj FROM stars, m),
  l AS (SELECT dy, dx FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx))
  SELECT id, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, round(a * {ACF} + b * exp(-(dy * dy + dx * dx) / (2 * ell * ell)), 6) AS cov FROM s JOIN model USING (ci, cj), l""")
def covariance_lags(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's table of covariances by lag, from the cell that it lies in or next to."""
    at = V.cell_of(B.stars(spark, sf).select("id", "y", "x"), cells(spark, sf), BOX)
    return V.covariance_table(at, 1, V.gaussian_acf(FWHM), ["id"]).withColumn("cov", F.round("cov", 6))


@query("covariance_step")
def covariance_step(spark: SparkSession, sf: str) -> DataFrame:
    """Sources after the step that knows the background's covariance, and what it adds to their variances."""
    image = B.pixels(spark, sf).select("y", "x", "v", (100.0 + (C("y") + C("x")) % 7).alias("iv"))
    sources = V.cell_of(B.stars(spark, sf).where("x BETWEEN 6 AND 58"), cells(spark, sf), BOX)
    return V.correlated_steps(sources.select("id", "y", "x", F.lit(5.0).alias("flux"), "a", "b", "ell"), image, FWHM, 4)


LIGHT = """near AS (SELECT id, py, px, sqrt(1.0 + (py + px) % 2) AS q, v - 50.0 - coalesce(model, 0) AS r, 4 * ln(2) / (pi() * 9.0) * exp(-4 * ln(2) * (dy * dy + dx * dx) / 9.0) AS g, 8 * ln(2) / 9.0 AS k, flux, dy, dx FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x WHERE abs(so.py - round_even(so.y, 0)) <= 5 AND abs(so.px - round_even(so.x, 0)) <= 5),
  d AS (SELECT id, py, px, r * q AS r, flux * g * k * dy * q AS dy, flux * g * k * dx * q AS dx, g * q AS df FROM near)"""


def left_over(spark: SparkSession, sf: str) -> DataFrame:
    return scene(spark, sf).select("y", "x", (C("v") - 50.0 - C("model")).alias("v"), (1.0 + (C("y") + C("x")) % 2).alias("w"))


@query("normal_blocks", f"WITH {SCENE}, {LIGHT} SELECT a.id AS i, b.id AS j, " + ", ".join(f"round(sum(a.{p} * b.{q}), 4) AS {p}_{q}" for p in N.PARTS for q in N.PARTS) + " FROM d a JOIN d b USING (py, px) WHERE a.id <= b.id GROUP BY a.id, b.id")
def normal_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Own and pair blocks of the normal equations of all sources."""
    blocks, _ = N.normal_equations(B.references(spark, sf), left_over(spark, sf), 3.0, 5)
    return blocks.select("i", "j", *[F.round(f"{p}_{q}", 4).alias(f"{p}_{q}") for p in N.PARTS for q in N.PARTS])


@query("normal_gradient", f"WITH {SCENE}, {LIGHT} SELECT id AS i, " + ", ".join(f"round(sum({p} * r), 4) AS g_{p}" for p in N.PARTS) + " FROM d GROUP BY id")
def normal_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """The gradient of all sources."""
    _, g = N.normal_equations(B.references(spark, sf), left_over(spark, sf), 3.0, 5)
    return g.select("i", *[F.round(f"g_{p}", 4).alias(f"g_{p}") for p in N.PARTS])
