"""Queries of the robust statistics over price cells and image boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import robust as R
from ..registry import query
from ..sources import bindings as B

C = F.col
CELL = f"WITH {B.CELLS}"
PX = f"WITH {B.PIXELS}"


def r6(**columns) -> list:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def clip_rounds(source: str, key: str, low: float, high: float, rounds: int = 10) -> str:
    """SQL of the clipping rounds: c0, c1, ... as ordinary tables."""
    out = f"c0 AS (SELECT {key}, v FROM {source})"
    for k in range(1, rounds + 1):
        out += f""", s{k} AS (SELECT {key}, median(v) AS m, stddev_pop(v) AS s FROM c{k - 1} GROUP BY {key}),
  c{k} AS (SELECT {key}, v FROM c{k - 1} JOIN s{k} USING ({key}) WHERE s = 0 OR (v >= m - {low} * s AND v <= m + {high} * s))"""
    return out


@query("sigma_clip_groups", f"{CELL}, {clip_rounds('cells', 'cell', 1.5, 1.5)} SELECT cell, count(*) AS n, round(median(v), 6) AS med, round(stddev_pop(v), 6) AS std FROM c10 GROUP BY cell")
def sigma_clip_groups(spark: SparkSession, sf: str) -> DataFrame:
    kept = R.clipped(B.cells(spark, sf), ["cell"], "v", low=1.5, high=1.5)
    return kept.groupBy("cell").agg(F.count("*").alias("n"), *r6(std=F.stddev_pop("v"))).join(R.medians(kept, ["cell"], "v"), "cell").select("cell", "n", *r6(med=C("m")), "std")


@query("sigma_clip_asymmetric", f"{CELL}, {clip_rounds('cells', 'cell', 1.2, 2.0)} SELECT cell, count(*) AS n, round(min(v), 6) AS lowest, round(max(v), 6) AS highest FROM c10 GROUP BY cell")
def sigma_clip_asymmetric(spark: SparkSession, sf: str) -> DataFrame:
    kept = R.clipped(B.cells(spark, sf), ["cell"], "v", low=1.2, high=2.0)
    return kept.groupBy("cell").agg(F.count("*").alias("n"), *r6(lowest=F.min("v"), highest=F.max("v")))


@query("location_estimates", f"""{CELL}, s AS (SELECT cell, count(*) AS n, avg(v) AS mean, median(v) AS med, stddev_pop(v) AS std FROM cells GROUP BY cell)
  SELECT cell, n, round(mean, 5) AS mean, round(med, 5) AS "median", round(CASE WHEN std <= 0 THEN mean WHEN abs(mean - med) / std > 0.3 THEN med ELSE 2.5 * med - 1.5 * mean END, 5) AS sextractor, round(3 * med - 2 * mean, 5) AS mmm FROM s""")
def location_estimates(spark: SparkSession, sf: str) -> DataFrame:
    s = R.locations(B.cells(spark, sf), ["cell"], "v")
    return s.select("cell", "n", *[F.round(c, 5).alias(c) for c in ("mean", "median", "sextractor", "mmm")])


@query("mad_groups", f"""{CELL}, m AS (SELECT cell, median(v) AS m FROM cells GROUP BY cell)
  SELECT cell, round(1.4826 * median(abs(v - m)), 6) AS mad FROM cells JOIN m USING (cell) GROUP BY cell""")
def mad_groups(spark: SparkSession, sf: str) -> DataFrame:
    return R.about_median(B.cells(spark, sf), ["cell"], "v").groupBy("cell").agg(F.round(1.4826 * F.first("s"), 6).alias("mad"))


@query("biweight_groups", f"""{CELL}, m AS (SELECT cell, median(v) AS m FROM cells GROUP BY cell), s AS (SELECT cell, any_value(m) AS m, median(abs(v - m)) AS s FROM cells JOIN m USING (cell) GROUP BY cell),
  u AS (SELECT cell, v - m AS d, m, (v - m) / (6 * s) AS u, (v - m) / (9 * s) AS w FROM cells JOIN s USING (cell))
  SELECT cell, round(any_value(m) + sum(d * pow(1 - u*u, 2)) FILTER (abs(u) < 1) / sum(pow(1 - u*u, 2)) FILTER (abs(u) < 1), 5) AS location,
   round(sqrt(count(*) * sum(d*d * pow(1 - w*w, 4)) FILTER (abs(w) < 1) / pow(sum((1 - w*w) * (1 - 5*w*w)) FILTER (abs(w) < 1), 2)), 5) AS scale FROM u GROUP BY cell""")
def biweight_groups(spark: SparkSession, sf: str) -> DataFrame:
    b = R.biweight(B.cells(spark, sf), ["cell"], "v")
    return b.select("cell", F.round("location", 5).alias("location"), F.round("scale", 5).alias("scale"))


@query("rms_about_location", f"""{CELL}, m AS (SELECT cell, 3 * median(v) - 2 * avg(v) AS m FROM cells GROUP BY cell)
  SELECT cell, round(sqrt(avg((v - m) * (v - m))), 5) AS std_rms, round(1.4826 * median(abs(v - m)), 5) AS mad_rms FROM cells JOIN m USING (cell) GROUP BY cell""")
def rms_about_location(spark: SparkSession, sf: str) -> DataFrame:
    """Deviations about a location estimate, not about the mean."""
    cells = B.cells(spark, sf)
    at = R.locations(cells, ["cell"], "v").select("cell", C("mmm").alias("m"))
    d = cells.join(at, "cell").withColumn("d", C("v") - C("m"))
    away = R.medians(d.select("cell", F.abs("d").alias("a")), ["cell"], "a")
    return d.groupBy("cell").agg(F.round(F.sqrt(F.avg(C("d") * C("d"))), 5).alias("std_rms")).join(away, "cell").select("cell", "std_rms", F.round(1.4826 * C("m"), 5).alias("mad_rms"))


@query("group_quantiles", f"{CELL} SELECT cell, count(*) AS n, round(quantile_cont(v, 0.9), 6) AS q FROM cells GROUP BY cell")
def group_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return R.quantiles(B.cells(spark, sf), ["cell"], "v", 0.9).select("cell", "n", F.round("q", 6).alias("q"))


M_ROUNDS = "".join(f""", c{k} AS (SELECT cell, CASE WHEN any_value(done) THEN any_value(sigma) ELSE sqrt(avg(least(v*v, 9*sigma*sigma)) / 0.5) END AS sigma,
  any_value(done) OR abs(sqrt(avg(least(v*v, 9*sigma*sigma)) / 0.5) - any_value(sigma)) < 1e-6 * any_value(sigma) AS done FROM r JOIN c{k - 1} USING (cell) GROUP BY cell)""" for k in range(1, 31))


@query("m_scale_groups", f"""{CELL}, m AS (SELECT cell, median(v) AS m FROM cells GROUP BY cell), r AS (SELECT cell, (v - m) / 1000 AS v FROM cells JOIN m USING (cell)),
  rm AS (SELECT cell, median(v) AS m FROM r GROUP BY cell), c0 AS (SELECT cell, greatest(1.4826 * median(abs(v - m)), pow(2, -52)) AS sigma, false AS done FROM r JOIN rm USING (cell) GROUP BY cell){M_ROUNDS}
  SELECT cell, round(sigma, 5) AS sigma FROM c30""")
def m_scale_groups(spark: SparkSession, sf: str) -> DataFrame:
    cells = B.cells(spark, sf)
    residuals = cells.join(R.medians(cells, ["cell"], "v"), "cell").select("cell", ((C("v") - C("m")) / 1000).alias("v"))
    return R.m_scale(residuals, ["cell"], "v").select("cell", F.round("sigma", 5).alias("sigma"))


@query("rowwise_mad", f"""{PX}, m AS (SELECT y, median(v) AS m FROM px GROUP BY y) SELECT y, round(1.4826 * median(abs(v - m)), 6) AS mad FROM px JOIN m USING (y) GROUP BY y""")
def rowwise_mad(spark: SparkSession, sf: str) -> DataFrame:
    """The deviation along one dimension of the image."""
    return R.about_median(B.pixels(spark, sf), ["y"], "v").groupBy("y").agg(F.round(1.4826 * F.first("s"), 6).alias("mad"))


@query("estimate_background", f"""{PX}, one AS (SELECT band AS k, v FROM px), {clip_rounds('one', 'k', 3.0, 3.0)},
  s AS (SELECT k, count(*) AS n, avg(v) AS mean, median(v) AS med, stddev_pop(v) AS std FROM c10 GROUP BY k),
  l AS (SELECT *, CASE WHEN std <= 0 THEN mean WHEN abs(mean - med) / std > 0.3 THEN med ELSE 2.5 * med - 1.5 * mean END AS loc FROM s)
  SELECT k AS band, any_value(n) AS n, round(any_value(loc), 6) AS bkg, round(sqrt(avg((v - loc) * (v - loc))), 6) AS rms FROM c10 JOIN l USING (k) GROUP BY k""")
def estimate_background(spark: SparkSession, sf: str) -> DataFrame:
    """One background level and deviation for each band's image."""
    kept = R.clipped(B.pixels(spark, sf).select("band", "v"), ["band"], "v")
    at = R.locations(kept, ["band"], "v").select("band", "n", C("sextractor").alias("loc"))
    d = kept.join(at, "band").groupBy("band").agg(F.first("n").alias("n"), F.first("loc").alias("loc"), F.sqrt(F.avg((C("v") - C("loc")) * (C("v") - C("loc")))).alias("rms"))
    return d.select("band", "n", F.round("loc", 6).alias("bkg"), F.round("rms", 6).alias("rms"))


MESH = f"""boxed AS (SELECT (y - 1) // 16 * 1000 + (x - 1) // 16 AS k, v FROM px), {clip_rounds('boxed', 'k', 3.0, 3.0)},
  bs AS (SELECT k, count(*) AS n, avg(v) AS mean, median(v) AS med, stddev_pop(v) AS std FROM c10 GROUP BY k),
  bl AS (SELECT *, CASE WHEN std <= 0 THEN mean WHEN abs(mean - med) / std > 0.3 THEN med ELSE 2.5 * med - 1.5 * mean END AS loc FROM bs),
  mesh AS (SELECT k // 1000 AS mi, k % 1000 AS mj, any_value(n) AS n, any_value(loc) AS bkg, sqrt(avg((v - loc) * (v - loc))) AS rms FROM c10 JOIN bl USING (k) GROUP BY k)"""


@query("mesh_background", f"{PX}, {MESH} SELECT mi, mj, n, round(bkg, 6) AS bkg, round(rms, 6) AS rms FROM mesh WHERE n >= 25.6")
def mesh_background(spark: SparkSession, sf: str) -> DataFrame:
    return R.mesh(B.pixels(spark, sf), (16, 16)).where(~F.isnan("bkg")).select("mi", "mj", "n", *r6(bkg=C("bkg"), rms=C("rms")))


HOLES = """hb AS (SELECT (y - 1) // 16 AS mi, (x - 1) // 16 AS mj, avg(v) AS v FROM px GROUP BY ALL), hm AS (SELECT mi, mj, CASE WHEN (mi * 5 + mj * 3) % 11 <> 0 THEN v END AS m FROM hb), hd AS (SELECT max(mi) AS hi, max(mj) AS hj FROM hm)"""


@query("mesh_fill", f"""{PX}, {HOLES}
  SELECT a.mi, a.mj, round(coalesce(max(a.m), avg(b.m)), 6) AS m FROM hm a, hd, (SELECT unnest([-1, 0, 1]) AS d), (SELECT unnest([-1, 0, 1]) AS e), hm b WHERE b.mi = greatest(0, least(hi, a.mi + d)) AND b.mj = greatest(0, least(hj, a.mj + e)) GROUP BY a.mi, a.mj""")
def mesh_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Box means with holes, none beside another, filled from the boxes around them."""
    box = [F.expr("(y - 1) div 16").alias("mi"), F.expr("(x - 1) div 16").alias("mj")]
    m = B.pixels(spark, sf).groupBy(*box).agg(F.avg("v").alias("v")).select("mi", "mj", F.when((C("mi") * 5 + C("mj") * 3) % 11 == 0, float("nan")).otherwise(C("v")).alias("m"))
    return R.fill_mesh(m, ("m",)).select("mi", "mj", *r6(m=C("m")))


@query("clip_range", f"""WITH few AS (SELECT l_partkey AS cell, l_extendedprice AS v FROM lineitem), {clip_rounds('few', 'cell', 1.5, 2.0)}
  SELECT cell, count(*) AS n, CASE WHEN count(*) >= 4 THEN round(median(v) - 1.5 * stddev_pop(v), 6) ELSE 'NaN'::DOUBLE END AS lo, CASE WHEN count(*) >= 4 THEN round(median(v) + 2.0 * stddev_pop(v), 6) ELSE 'NaN'::DOUBLE END AS hi FROM c10 GROUP BY cell""")
def clip_range(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of what clipping leaves, void for groups of too few survivors."""
    few = B.read(spark, sf, "lineitem").select(C("l_partkey").alias("cell"), C("l_extendedprice").alias("v"))
    return R.clip_range(few, ["cell"], "v", 1.5, 2.0).select("cell", "n", *r6(lo=C("lo"), hi=C("hi")))
