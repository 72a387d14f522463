"""Moments with errors, shapes with errors, and weighted centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes as H
from ..operators import stencil as T
from ..registry import query
from ..sources import bindings as B
from .measure_queries import SCENE, SKY, scene
from .robust_queries import PX

C = F.col
WINDOW = 2.5
LIT = f"""{SCENE}, lit AS (SELECT y, x, v, CASE WHEN (y * 7 + x) % 29 = 0 THEN 0.0 ELSE 1.0 / (1.0 + (y + x) % 3) END AS iv FROM scene),
  near AS (SELECT id, dy, dx, v - 50.0 AS z, iv, iv * exp(-(dy * dy + dx * dx) / 12.5) AS u, iv * exp(-(dy * dy + dx * dx) / 6.25) AS t FROM so JOIN lit ON so.py = lit.y AND so.px = lit.x WHERE abs(so.py - round_even(so.y, 0)) <= 5 AND abs(so.px - round_even(so.x, 0)) <= 5 AND iv > 0)"""
PAIRS = [(p, q) for p, q in H.ORDERS + H.HIGHER]


def lit(spark: SparkSession, sf: str) -> DataFrame:
    iv = F.when((C("y") * 7 + C("x")) % 29 == 0, 0.0).otherwise(1.0 / (1.0 + (C("y") + C("x")) % 3))
    return scene(spark, sf).select("y", "x", "v", iv.alias("iv"))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return H.windowed_moments(B.references(spark, sf), lit(spark, sf), 5, SKY, WINDOW)


@query("moment_sums", f"WITH {LIT} SELECT id, " + ", ".join(f"round(sum(u * z * dy ** {p} * dx ** {q}), 4) AS m{p}{q}" for p, q in H.ORDERS) + ", " + ", ".join(f"round(sum(t * dy ** {p} * dx ** {q}), 5) AS w{p}{q}" for p, q in PAIRS) + ", round(sum(z), 4) AS aperture_sum, count(*) AS aperture_area, round(sqrt(sum(1 / iv)), 6) AS aperture_err FROM near GROUP BY id")
def moment_sums(spark: SparkSession, sf: str) -> DataFrame:
    """All 21 sums, and the aperture's three."""
    m = found(spark, sf)
    return m.select("id", *[F.round(f"m{p}{q}", 4).alias(f"m{p}{q}") for p, q in H.ORDERS], *[F.round(f"w{p}{q}", 5).alias(f"w{p}{q}") for p, q in PAIRS], F.round("aperture_sum", 4).alias("aperture_sum"), "aperture_area", F.round("aperture_err", 6).alias("aperture_err"))


# The SQL sums the squares of each pixel's influence on a statistic, by differences, instead of propagating the moments' covariances.
STATISTICS = """ AS (SELECT {by}, m00, (yy - k * d) / q AS syy, (xx - k * d) / q AS sxx, xy / q AS sxy FROM (SELECT *, yy * xx - xy * xy AS d, 0.16 AS k, 1 - 0.16 * (yy + xx) + 0.16 * 0.16 * (yy * xx - xy * xy) AS q FROM (
  SELECT {by}, m00, m20 / m00 - pow(m10 / m00, 2) AS yy, m02 / m00 - pow(m01 / m00, 2) AS xx, m11 / m00 - m10 * m01 / (m00 * m00) AS xy FROM {src})))"""


@query("shape_errors", f"""WITH {LIT}, mm AS (SELECT id, sum(u * z) AS m00, sum(u * z * dy) AS m10, sum(u * z * dx) AS m01, sum(u * z * dy * dy) AS m20, sum(u * z * dx * dx) AS m02, sum(u * z * dx * dy) AS m11 FROM near GROUP BY id),
  bumped AS (SELECT id, dy, dx, iv, sign, m00 + e AS m00, m10 + e * dy AS m10, m01 + e * dx AS m01, m20 + e * dy * dy AS m20, m02 + e * dx * dx AS m02, m11 + e * dx * dy AS m11 FROM (SELECT mm.*, dy, dx, iv, sign, sign * 1e-3 * u AS e FROM mm JOIN near USING (id), (SELECT unnest([-1, 1]) AS sign))),
  shp {STATISTICS.format(by="id", src="mm")}, shb {STATISTICS.format(by="id, dy, dx, iv, sign", src="bumped")},
  slopes AS (SELECT id, dy, dx, any_value(iv) AS iv, sum(sign * (syy - sxx) / (syy + sxx)) / 2e-3 AS g1, sum(sign * 2 * sxy / (syy + sxx)) / 2e-3 AS g2, sum(sign / (syy + sxx)) / 2e-3 AS gc FROM shb GROUP BY id, dy, dx),
  errs AS (SELECT id, sqrt(sum(g1 * g1 / iv)) AS e1, sqrt(sum(g2 * g2 / iv)) AS e2, sqrt(sum(gc * gc / iv)) AS ec FROM slopes GROUP BY id)
  SELECT id, round((syy - sxx) / (syy + sxx), 5) AS ellipticity1, round(2 * sxy / (syy + sxx), 5) AS ellipticity2, round(1 / (syy + sxx), 5) AS compactness, round(e1, 5) AS ellipticity1_err, round(e2, 5) AS ellipticity2_err, round(ec, 5) AS compactness_err FROM shp JOIN errs USING (id) WHERE m00 > 1000 AND syy > 0.2 AND sxx > 0.2 AND syy * sxx > sxy * sxy""")
def shape_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Ellipticities and compactness without the window, with errors from all moments' covariances."""
    m = found(spark, sf)
    s = H.shape_errors(m, WINDOW).join(m.select("id", "m00"), "id").where("m00 > 1000 AND s_yy > 0.2 AND s_xx > 0.2 AND s_yy * s_xx > s_xy * s_xy")
    return s.select("id", *[F.round(c, 5).alias(c) for c in ("ellipticity1", "ellipticity2", "compactness", "ellipticity1_err", "ellipticity2_err", "compactness_err")])


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """The 3 x 3 neighbourhoods of all interior maxima, with weights."""
    nb = T.neighbourhood(B.pixels(spark, sf), 1, "v", "null", (), "z").where(T.above_neighbours("z", "v", False))
    iv = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: 64.0 + (C("y") + i + 2 * (C("x") + j)) % 5))
    return nb.select("y", "x", "z", iv.alias("iv"))


@query("centroid_com", f"""{PX}, pk AS (SELECT p.y, p.x FROM px p, (SELECT unnest([-1,0,1]) AS dy), (SELECT unnest([-1,0,1]) AS dx), px q, (SELECT max(y) AS ny, max(x) AS nx FROM px) WHERE (dy <> 0 OR dx <> 0) AND q.y = p.y + dy AND q.x = p.x + dx AND p.y > 1 AND p.x > 1 AND p.y < ny AND p.x < nx GROUP BY p.y, p.x HAVING bool_and(p.v > q.v)),
  s AS (SELECT p.y, p.x, q.y - p.y AS dy, q.x - p.x AS dx, q.v, 64.0 + (q.y + 2 * q.x) % 5 AS w FROM pk p JOIN px q ON q.y BETWEEN p.y-1 AND p.y+1 AND q.x BETWEEN p.x-1 AND p.x+1),
  c AS (SELECT y, x, sum(w * v) AS m, sum(w * v * dy) / sum(w * v) AS cy, sum(w * v * dx) / sum(w * v) AS cx FROM s GROUP BY y, x HAVING sum(w * v) > 5)
  SELECT y, x, round(y + any_value(cy), 6) AS com_y, round(x + any_value(cx), 6) AS com_x, round(sqrt(sum(w * (dy - cy) * (dy - cy))) / any_value(m), 6) AS com_y_err, round(sqrt(sum(w * (dx - cx) * (dx - cx))) / any_value(m), 6) AS com_x_err FROM s JOIN c USING (y, x) GROUP BY y, x""")
def centroid_com(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted centres of mass of the maxima, with errors."""
    p = patches(spark, sf)
    mass = F.aggregate(F.flatten(F.zip_with("z", "iv", lambda a, b: F.zip_with(a, b, lambda v, w: v * w))), F.lit(0.0), lambda t, v: t + v)
    c = H.weighted_centroids(p.where(mass > 5))
    return c.select("y", "x", *[F.round(f"fit_{n}", 6).alias(n) for n in ("com_y", "com_x", "com_y_err", "com_x_err")])


@query("centroid_choice")
def centroid_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The maxima's chosen positions, with the quadratic's errors."""
    c = H.weighted_centroids(patches(spark, sf))
    return c.select("y", "x", "source", *[F.round(n, 6).alias(n) for n in ("yc", "xc")], *[F.round(f"fit_{n}", 6).alias(n) for n in ("y_err", "x_err", "peak", "peak_err", "curvature", "curvature_err")])
