"""Queries of the nonlinear fits and the photometry loop; tests hold them against the rendered truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import epsf, fit
from ..operators.measure import render
from ..registry import query
from ..shared import shuffled
from ..sources import bindings as B
from . import joint_fit
from .measure_queries import scene
from .multipass import Options, multipass

C = F.col


@query("lm_fit_stars")
def lm_fit_stars(spark: SparkSession, sf: str) -> DataFrame:
    sources = B.references(spark, sf).select("id", "y", "x", "flux", F.lit(50.0).alias("bkg"))
    return fit.fit_stars(sources, scene(spark, sf).select("y", "x", "v"), "gaussian")


@query("irls_fit_stars")
def irls_fit_stars(spark: SparkSession, sf: str) -> DataFrame:
    """Fits that put little weight on pixels far off, such as a neighbour's."""
    sources = B.references(spark, sf).select("id", "y", "x", "flux", F.lit(50.0).alias("bkg"))
    return fit.fit_stars(sources, scene(spark, sf).select("y", "x", "v"), "moffat", robust=True)


@query("multipass_photometry")
def multipass_photometry(spark: SparkSession, sf: str) -> DataFrame:
    return multipass(scene(spark, sf).select("y", "x", "v")).catalog


@query("multipass_sequential")
def multipass_sequential(spark: SparkSession, sf: str) -> DataFrame:
    return multipass(scene(spark, sf).select("y", "x", "v"), Options(sequential=True)).catalog


@query("multipass_history")
def multipass_history(spark: SparkSession, sf: str) -> DataFrame:
    history = multipass(scene(spark, sf).select("y", "x", "v"), Options(max_passes=3)).history
    return spark.createDataFrame([tuple(h.values()) for h in history], "pass int, n_peaks long, n_new long, n_pruned long, n_catalog long")


def shifted_images(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Three images of the same sources: two bands, moved by fractions of a pixel, the second band half as bright."""
    refs = B.references(spark, sf)
    images = spark.createDataFrame([("i1", "a", 0.0, 0.0, 4.0), ("i2", "a", 0.3, -0.4, 4.0), ("i3", "b", -0.25, 0.5, 4.0)], "image string, band string, oy double, ox double, weight double")
    out = None
    for name, dy, dx, scale in (("i1", 0.0, 0.0, 1.0), ("i2", 0.3, -0.4, 1.0), ("i3", -0.25, 0.5, 0.5)):
        moved = refs.withColumns({"y": C("y") + dy, "x": C("x") + dx, "flux": C("flux") * scale})
        one = render(moved, 3.0, 8).select(F.lit(name).alias("image"), "y", "x", C("model").alias("v"))
        out = one if out is None else out.unionByName(one)
    return images, out


@query("joint_photometry")
def joint_photometry(spark: SparkSession, sf: str) -> DataFrame:
    images, pixels = shifted_images(spark, sf)
    found = joint_fit.fit_joint(B.references(spark, sf), images, pixels)
    return joint_fit.wide(found, ["a", "b"])


@query("epsf_build")
def epsf_build(spark: SparkSession, sf: str) -> DataFrame:
    """The tabulated profile of the field's stars, as ``gy, gx, value``."""
    stars = B.references(spark, sf).select("id", "y", "x", "flux", F.lit(50.0).alias("bkg"))
    grid, _ = epsf.build(stars, scene(spark, sf).select("y", "x", "v"))
    rows = [(i, j, float(grid[i, j])) for i in range(grid.shape[0]) for j in range(grid.shape[1])]
    return spark.createDataFrame(rows, "gy int, gx int, value double")


@query("background_covariance")
def background_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """For each cell the white and correlated parts of the background and the correlation length that fits best."""
    px = B.pixels(spark, sf)
    lags = [(dy, dx) for dy in range(4) for dx in range(4)]
    cell = px.select(F.expr("(y - 1) div 100").alias("cell"), "y", "x", "v")
    moved = cell.select("cell", "y", "x", C("v").alias("a"), F.inline(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in lags])))
    other = px.select(C("y").alias("qy"), C("x").alias("qx"), C("v").alias("b"))
    cov = moved.join(shuffled(other), (C("y") + C("dy") == C("qy")) & (C("x") + C("dx") == C("qx"))).groupBy("cell", "dy", "dx").agg(F.avg(C("a") * C("b")).alias("c"), F.count("*").alias("n"))
    length = F.explode(F.array(*[F.lit(v) for v in (0.5, 1.0, 2.0, 4.0)])).alias("ell")
    r2 = C("dy") * C("dy") + C("dx") * C("dx")
    terms = cov.select("*", length).select("cell", "ell", "c", "n", F.when(r2 == 0, 1.0).otherwise(0.0).alias("u"), F.exp(-r2 / (2 * C("ell") * C("ell"))).alias("w"))
    s = terms.groupBy("cell", "ell").agg(*[F.sum(C("n") * C(a) * C(b)).alias(k) for a, b, k in (("u", "u", "uu"), ("u", "w", "uw"), ("w", "w", "ww"), ("u", "c", "uc"), ("w", "c", "wc"), ("c", "c", "cc"))])
    a, b, res = scalar.nnls2(*[C(k) for k in ("uu", "uw", "ww", "uc", "wc", "cc")])
    best = s.select("cell", "ell", a.alias("a"), b.alias("b"), res.alias("res")).groupBy("cell").agg(F.min(F.struct("res", "ell", "a", "b")).alias("m"))
    return best.select("cell", C("m.a").alias("white"), C("m.b").alias("correlated"), C("m.ell").alias("ell"))
