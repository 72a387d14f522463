"""Queries of rendering, apertures, growth curves, moments and diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measure as M
from ..operators import stencil as T
from ..registry import query
from ..shared import shuffled, spread
from ..sources import bindings as B
from .robust_queries import PX

C = F.col
FWHM, RADIUS = 3.0, 8
SKY = 50.0
PROFILE = "4 * ln(2) / (pi() * 9.0) * exp(-4 * ln(2) * (dy * dy + dx * dx) / 9.0)"
SCENE = f"""{B.REFERENCES}, off AS (SELECT i, j FROM (SELECT unnest(range(-8, 9)) AS i), (SELECT unnest(range(-8, 9)) AS j)),
  st AS (SELECT id, y, x, flux, CAST(round_even(y, 0) AS BIGINT) + i AS py, CAST(round_even(x, 0) AS BIGINT) + j AS px FROM refs, off),
  so AS (SELECT *, py - y AS dy, px - x AS dx FROM st), model AS (SELECT py AS y, px AS x, sum(flux * {PROFILE}) AS model FROM so GROUP BY py, px),
  grid AS (SELECT field * 128 + i AS y, j AS x FROM (SELECT DISTINCT field FROM refs), (SELECT unnest(range(1, 129)) AS i), (SELECT unnest(range(1, 129)) AS j)),
  scene AS (SELECT g.y, g.x, 50.0 + ((g.y * 37 + g.x * 91) % 101) / 101.0 - 0.5 + coalesce(model, 0.0) AS v, coalesce(model, 0.0) AS model FROM grid g LEFT JOIN model USING (y, x))"""


def scene(spark: SparkSession, sf: str) -> DataFrame:
    """``y, x, v, model``: the references' light on a level sky with small fixed noise, 128 x 128 for each field."""
    refs = B.references(spark, sf)
    grid = spread(refs.select("field").distinct()).select("field", F.explode(F.sequence(F.lit(1), F.lit(B.SIDE))).alias("i")).select((C("field") * B.SIDE + C("i")).alias("y"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(B.SIDE).cast("long"))).alias("x"))
    light = F.coalesce("model", F.lit(0.0))
    noise = ((C("y") * 37 + C("x") * 91) % 101) / F.lit(101.0) - 0.5
    return grid.join(shuffled(M.render(refs, FWHM, RADIUS)), ["y", "x"], "left").select("y", "x", (SKY + noise + light).alias("v"), light.alias("model"))


def r6(**columns) -> list:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


@query("render_scene", f"WITH {SCENE} SELECT y, x, round(v, 6) AS v FROM scene")
def render_scene(spark: SparkSession, sf: str) -> DataFrame:
    return scene(spark, sf).select("y", "x", F.round("v", 6).alias("v"))


@query("residual_cost", f"WITH {SCENE} SELECT (y - 1) // 128 AS field, count(*) AS n, round(sum(2.0 * (v - 50.0 - model) * (v - 50.0 - model)), 5) AS cost FROM scene GROUP BY 1")
def residual_cost(spark: SparkSession, sf: str) -> DataFrame:
    d = C("v") - SKY - C("model")
    return scene(spark, sf).groupBy(F.expr("(y - 1) div 128").alias("field")).agg(F.count("*").alias("n"), F.round(F.sum(2.0 * d * d), 5).alias("cost"))


def aperture_sql(weight: str) -> str:
    return f"WITH {SCENE}, a AS (SELECT id, v, {weight} AS w FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x) SELECT id, round(sum(w * (v - 50.0)), 5) AS flux, round(sum(w), 6) AS area FROM a GROUP BY id"


def aperture(spark: SparkSession, sf: str, method: str) -> DataFrame:
    c = M.curve_of_growth(B.references(spark, sf), scene(spark, sf).select("y", "x", "v"), [5.0], method, SKY)
    return c.select("id", F.round("flux", 5).alias("flux"), F.round("area", 6).alias("area"))


@query("aperture_center", aperture_sql("CASE WHEN dy * dy + dx * dx < 25 THEN 1.0::DOUBLE ELSE 0.0 END"))
def aperture_center(spark: SparkSession, sf: str) -> DataFrame:
    return aperture(spark, sf, "center")


@query("aperture_whole", aperture_sql("CASE WHEN greatest(pow(dy - 0.5, 2), pow(dy + 0.5, 2)) + greatest(pow(dx - 0.5, 2), pow(dx + 0.5, 2)) <= 25 THEN 1.0::DOUBLE ELSE 0.0 END"))
def aperture_whole(spark: SparkSession, sf: str) -> DataFrame:
    return aperture(spark, sf, "whole")


@query("aperture_subpixel", aperture_sql("list_sum(list_transform(range(0, 25), lambda k: CASE WHEN pow(dx + (k // 5 + 0.5) / 5 - 0.5, 2) + pow(dy + (k % 5 + 0.5) / 5 - 0.5, 2) < 25 THEN 1 ELSE 0 END)) / 25.0"))
def aperture_subpixel(spark: SparkSession, sf: str) -> DataFrame:
    return aperture(spark, sf, "subpixel")


@query("aperture_exact")
def aperture_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exact circle and pixel overlap; a test holds it against closed forms and fine sub-pixels."""
    return aperture(spark, sf, "exact")


RADII = [1.5, 2.5, 3.5, 4.5, 5.5, 6.5]
COG = f"""{SCENE}, rad AS (SELECT unnest([1.5, 2.5, 3.5, 4.5, 5.5, 6.5])::DOUBLE AS r), cog AS (SELECT id, r, sum(CASE WHEN dy*dy + dx*dx < r*r THEN v - 50.0 ELSE 0.0 END) AS flux, sum(CASE WHEN dy*dy + dx*dx < r*r THEN 1.0::DOUBLE ELSE 0.0 END) AS area
  FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x CROSS JOIN rad GROUP BY id, r)"""


def growth(spark: SparkSession, sf: str) -> DataFrame:
    return M.curve_of_growth(B.references(spark, sf), scene(spark, sf).select("y", "x", "v"), RADII, "center", SKY)


@query("curve_of_growth", f"WITH {COG} SELECT id, r, round(flux, 5) AS flux, area FROM cog")
def curve_of_growth(spark: SparkSession, sf: str) -> DataFrame:
    return growth(spark, sf).select("id", "r", F.round("flux", 5).alias("flux"), "area")


RISING = """st2 AS (SELECT *, CASE WHEN flux <= lag(flux) OVER w THEN 1 ELSE 0 END AS stop FROM cog WINDOW w AS (PARTITION BY id ORDER BY r)),
  ri AS (SELECT * FROM (SELECT id, r, flux, max(stop) OVER (PARTITION BY id ORDER BY r) AS s FROM st2) WHERE s = 0),
  sg AS (SELECT id, r, flux, lead(r) OVER w AS r1, lead(flux) OVER w AS f1 FROM ri WINDOW w AS (PARTITION BY id ORDER BY r))"""


@query("encircled_energy", f"WITH {COG}, {RISING} SELECT id, round(coalesce(max(CASE WHEN r <= 4.0 AND 4.0 < r1 THEN flux + (4.0 - r) / (r1 - r) * (f1 - flux) END), 'nan'::DOUBLE), 5) AS energy FROM sg GROUP BY id")
def encircled_energy(spark: SparkSession, sf: str) -> DataFrame:
    return M.lookup(growth(spark, sf), "r", "flux", 4.0).select("id", F.round("value", 5).alias("energy"))


@query("radius_at_energy", f"WITH {COG}, {RISING} SELECT id, round(coalesce(max(CASE WHEN flux <= 500.0 AND 500.0 < f1 THEN r + (500.0 - flux) / (f1 - flux) * (r1 - r) END), 'nan'::DOUBLE), 5) AS radius FROM sg GROUP BY id")
def radius_at_energy(spark: SparkSession, sf: str) -> DataFrame:
    return M.lookup(growth(spark, sf), "flux", "r", 500.0).select("id", F.round("value", 5).alias("radius"))


@query("normalize_cog", f"WITH {COG} SELECT id, r, round(flux / max(flux) OVER (PARTITION BY id), 6) AS by_max, round(flux / last_value(flux) OVER (PARTITION BY id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS by_last FROM cog")
def normalize_cog(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return growth(spark, sf).select("id", "r", *r6(by_max=C("flux") / F.max("flux").over(w), by_last=C("flux") / F.last("flux").over(w)))


MOMENTS = f"""{SCENE}, mm AS (SELECT id, sum(v - 50.0) AS m00, sum((v - 50.0) * dy) AS m10, sum((v - 50.0) * dx) AS m01, sum((v - 50.0) * dy * dy) AS m20, sum((v - 50.0) * dx * dx) AS m02, sum((v - 50.0) * dx * dy) AS m11, count(*) AS area
  FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x WHERE abs(so.py - round_even(so.y, 0)) <= 4 AND abs(so.px - round_even(so.x, 0)) <= 4 GROUP BY id)"""


def source_moments(spark: SparkSession, sf: str) -> DataFrame:
    return M.moments(B.references(spark, sf), scene(spark, sf).select("y", "x", "v"), 4, SKY)


@query("second_moments", f"WITH {MOMENTS} SELECT id, area, round(m00, 4) AS m00, round(m10, 4) AS m10, round(m01, 4) AS m01, round(m20, 4) AS m20, round(m02, 4) AS m02, round(m11, 4) AS m11 FROM mm")
def second_moments(spark: SparkSession, sf: str) -> DataFrame:
    return source_moments(spark, sf).select("id", C("aperture_area").alias("area"), *[F.round(c, 4).alias(c) for c in ("m00", "m10", "m01", "m20", "m02", "m11")])


@query("star_shapes", f"""WITH {MOMENTS}, sh AS (SELECT id, m00, greatest(m20/m00 - pow(m10/m00, 2), 0.0) AS yy, greatest(m02/m00 - pow(m01/m00, 2), 0.0) AS xx, m11/m00 - m10*m01/(m00*m00) AS xy FROM mm)
  SELECT id, round(2.3548200450309493 * sqrt(yy), 5) AS y_fwhm, round(2.3548200450309493 * sqrt(xx), 5) AS x_fwhm, round((yy - xx) / (yy + xx), 5) AS ellipticity1, round(2 * xy / (yy + xx), 5) AS ellipticity2, round(1 / (yy + xx), 5) AS compactness FROM sh WHERE m00 > 0""")
def star_shapes(spark: SparkSession, sf: str) -> DataFrame:
    s = M.shapes(source_moments(spark, sf)).where("m00 > 0")
    return s.select("id", *[F.round(c, 5).alias(c) for c in ("y_fwhm", "x_fwhm", "ellipticity1", "ellipticity2", "compactness")])


@query("centroid_quadratic", f"""{PX}, pk AS (SELECT p.y, p.x FROM px p, (SELECT unnest([-1,0,1]) AS dy), (SELECT unnest([-1,0,1]) AS dx), px q, (SELECT max(y) AS ny, max(x) AS nx FROM px) WHERE (dy <> 0 OR dx <> 0) AND q.y = p.y + dy AND q.x = p.x + dx AND p.y > 1 AND p.x > 1 AND p.y < ny AND p.x < nx GROUP BY p.y, p.x HAVING bool_and(p.v > q.v)),
  s AS (SELECT p.y, p.x, sum(q.v) AS s, sum(q.v*(q.x-p.x)) AS sx, sum(q.v*(q.y-p.y)) AS sy, sum(q.v*pow(q.x-p.x,2)) AS sxx, sum(q.v*pow(q.y-p.y,2)) AS syy, sum(q.v*(q.x-p.x)*(q.y-p.y)) AS sxy FROM pk p JOIN px q ON q.y BETWEEN p.y-1 AND p.y+1 AND q.x BETWEEN p.x-1 AND p.x+1 GROUP BY p.y, p.x),
  k AS (SELECT y, x, sx/6 AS b, sy/6 AS c, sxy/4 AS e, 2*(sxx/2 - s/3) AS d2, 2*(syy/2 - s/3) AS f2 FROM s)
  SELECT y, x, round(y + (b*e - c*d2) / (d2*f2 - e*e), 5) AS yc, round(x + (c*e - b*f2) / (d2*f2 - e*e), 5) AS xc FROM k WHERE abs(d2*f2 - e*e) > 0.001""")
def centroid_quadratic(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-pixel positions of all interior maxima whose quadratic is well curved."""
    px = B.pixels(spark, sf)
    nb = T.neighbourhood(px, 1, "v", "null", (), "nb").where(T.above_neighbours("nb", "v", False))
    c = M.quadratic_centroid("nb", C("y"), C("x"))
    v = lambda dy, dx: C("nb")[dy + 1][dx + 1]
    cells = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    s = sum((v(*k) for k in cells[1:]), v(*cells[0]))
    d2 = 2 * (sum((v(i, j) for i, j in cells[1:] if j), v(*cells[0])) / 2 - s / 3)
    f2 = 2 * (sum((v(i, j) for i, j in cells[1:] if i), v(*cells[0])) / 2 - s / 3)
    e = (v(-1, -1) + v(1, 1) - v(-1, 1) - v(1, -1)) / 4
    return nb.where(F.abs(d2 * f2 - e * e) > 0.001).select("y", "x", F.round(c["yc"], 5).alias("yc"), F.round(c["xc"], 5).alias("xc"))


@query("sharpness", f"""WITH {SCENE}, a AS (SELECT id, flux, so.py = round_even(so.y, 0) AND so.px = round_even(so.x, 0) AS mid, v FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x WHERE abs(so.py - round_even(so.y, 0)) <= 2 AND abs(so.px - round_even(so.x, 0)) <= 2)
  SELECT id, round((sum(v) FILTER (mid) - avg(v) FILTER (NOT mid)) / (any_value(flux) * 4 * ln(2) / (pi() * 9.0)), 6) AS sharp FROM a GROUP BY id HAVING count(*) FILTER (mid) = 1""")
def sharpness(spark: SparkSession, sf: str) -> DataFrame:
    """Central pixel less the mean of its window, over the peak of the fitted profile."""
    met = M.on_image(B.references(spark, sf), scene(spark, sf).select("y", "x", "v"), 2).withColumn("mid", (C("py") == C("ay")) & (C("px") == C("ax")))
    height = F.first("flux") * (4 * math.log(2) / (math.pi * 9))
    s = met.groupBy("id").agg(F.sum(F.when(C("mid"), C("v"))).alias("c"), ((F.sum(F.when(C("mid"), C("v"))) - F.avg(F.when(~C("mid"), C("v")))) / height).alias("s"))
    return s.where("c IS NOT NULL").select("id", F.round("s", 6).alias("sharp"))


@query("star_diagnostics", f"""WITH {SCENE}, a AS (SELECT id, flux, v - 50.0 - model AS r, {PROFILE} AS phi, v - 50.0 - model + flux * {PROFILE} AS clean, v - 50.0 AS dirty FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x WHERE abs(so.py - round_even(so.y, 0)) <= 3 AND abs(so.px - round_even(so.x, 0)) <= 3)
  SELECT id, round(sum(abs(r)) / any_value(flux), 7) AS qfit, round(sum(4.0 * r * r) / (count(*) - 3), 6) AS chisq, round(2.5 * log10(sum(4.0 * phi * dirty) / sum(4.0 * phi * clean)), 6) AS crowding, round(sqrt(2 / pi()) * (count(*) * 0.5) / any_value(flux), 7) AS qfit_expected FROM a GROUP BY id HAVING count(*) > 3""")
def star_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of each source's model: residuals, chi-square, crowding, and what noise alone would give."""
    met = M.on_image(B.references(spark, sf), scene(spark, sf), 3)
    phi, r = M.gaussian(C("dy"), C("dx"), FWHM), C("v") - SKY - C("model")
    a = met.select("id", "flux", r.alias("r"), phi.alias("phi"), (C("v") - SKY).alias("dirty")).withColumn("clean", C("r") + C("flux") * C("phi"))
    w = 4.0
    return a.groupBy("id").agg(
        F.count("*").alias("n"), F.round(F.sum(F.abs("r")) / F.first("flux"), 7).alias("qfit"), F.round(F.sum(w * C("r") * C("r")) / F.when(F.count("*") > 3, F.count("*") - 3), 6).alias("chisq"),
        F.round(2.5 * F.log10(F.sum(w * C("phi") * C("dirty")) / F.sum(w * C("phi") * C("clean"))), 6).alias("crowding"), F.round(math.sqrt(2 / math.pi) * (F.count("*") * 0.5) / F.first("flux"), 7).alias("qfit_expected"),
    ).where("n > 3").drop("n")


@query("effective_area", f"WITH {SCENE} SELECT id, round(pow(sum({PROFILE}), 2) / sum(pow({PROFILE}, 2)), 6) AS area FROM so GROUP BY id")
def effective_area(spark: SparkSession, sf: str) -> DataFrame:
    p = M.gaussian(C("dy"), C("dx"), FWHM)
    return M.stamps(B.references(spark, sf), RADIUS).groupBy("id").agg(F.round(F.sum(p) * F.sum(p) / F.sum(p * p), 6).alias("area"))


@query("stamp_geometry_counts", f"WITH {SCENE} SELECT id, count(*) AS usable FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x WHERE (scene.y * 3 + scene.x) % 17 <> 0 GROUP BY id HAVING count(*) >= 100")
def stamp_geometry_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Usable pixels of each source's stamp; sources with too few are left out."""
    good = scene(spark, sf).where((C("y") * 3 + C("x")) % 17 != 0)
    return M.on_image(B.references(spark, sf), good, RADIUS).groupBy("id").agg(F.count("*").alias("usable")).where("usable >= 100")


@query("psf_profiles", f"""WITH {B.STARS}, o AS (SELECT id, y - round_even(y, 0) AS dy, x - round_even(x, 0) AS dx, CAST(id % 180 AS DOUBLE) AS t FROM stars), e AS (SELECT *, dx * cos(radians(t)) + dy * sin(radians(t)) AS u, dy * cos(radians(t)) - dx * sin(radians(t)) AS w FROM o)
  SELECT id, round({PROFILE}, 8) AS gaussian, round(4 * ln(2) / (pi() * 2.0 * 4.0) * exp(-4 * ln(2) * (u*u / 16.0 + w*w / 4.0)), 8) AS elliptical, round(1.5 / (pi() * (2.25 / (pow(2, 0.4) - 1))) * pow(1 + (dy*dy + dx*dx) / (2.25 / (pow(2, 0.4) - 1)), -2.5), 8) AS moffat FROM e""")
def psf_profiles(spark: SparkSession, sf: str) -> DataFrame:
    dy, dx = C("y") - F.rint("y"), C("x") - F.rint("x")
    p = {"gaussian": M.gaussian(dy, dx, 3.0), "elliptical": M.elliptical_gaussian(dy, dx, 2.0, 4.0, (C("id") % 180).cast("double")), "moffat": M.moffat(dy, dx, 3.0, 2.5)}
    return B.stars(spark, sf).select("id", *[F.round(c, 8).alias(k) for k, c in p.items()])


@query("psf_gradient_gaussian", f"""WITH {B.STARS}, o AS (SELECT id, flux, y - round_even(y, 0) + 0.5 AS dy, x - round_even(x, 0) - 0.5 AS dx FROM stars), g AS (SELECT *, {PROFILE} AS g FROM o)
  SELECT id, round(flux * g * 8 * ln(2) * dy / 9, 5) AS d_y, round(flux * g * 8 * ln(2) * dx / 9, 5) AS d_x, round(flux * g * (8 * ln(2) * (dy*dy + dx*dx) / 27 - 2.0 / 3), 5) AS d_fwhm, round(g, 7) AS d_flux FROM g""")
def psf_gradient_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    g = M.gaussian_gradient(C("y") - F.rint("y") + 0.5, C("x") - F.rint("x") - 0.5, 3.0, C("flux"))
    return B.stars(spark, sf).select("id", *[F.round(c, 7 if k == "d_flux" else 5).alias(k) for k, c in g.items()])


@query("bilinear_grid_corners", f"""WITH {B.STARS}, g AS (SELECT id, least(2, greatest(0, CAST(floor((y - field * 128 - 1) / 40) AS BIGINT))) AS i, least(2, greatest(0, CAST(floor((x - 1) / 40) AS BIGINT))) AS j, y - field * 128 AS y, x FROM stars),
  t AS (SELECT id, i, j, least(1.0, greatest(0.0, (y - 1 - i * 40) / 40)) AS t, least(1.0, greatest(0.0, (x - 1 - j * 40) / 40)) AS u FROM g)
  SELECT id, i, j, round((1-t)*(1-u), 6) AS w00, round((1-t)*u, 6) AS w01, round(t*(1-u), 6) AS w10, round(t*u, 6) AS w11 FROM t""")
def bilinear_grid_corners(spark: SparkSession, sf: str) -> DataFrame:
    """Node cell and blending weights of each position on a 4 x 4 grid of profiles, clamped at the edges."""
    clamp = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    y = C("y") - C("field") * B.SIDE
    cell = lambda c: clamp(F.floor((c - 1) / 40).cast("long"), 0, 2).cast("long")
    g = B.stars(spark, sf).select("id", cell(y).alias("i"), cell(C("x")).alias("j"), y.alias("y"), "x")
    t, u = clamp((C("y") - 1 - C("i") * 40) / 40, 0.0, 1.0), clamp((C("x") - 1 - C("j") * 40) / 40, 0.0, 1.0)
    return g.select("id", "i", "j", *r6(w00=(1 - t) * (1 - u), w01=(1 - t) * u, w10=t * (1 - u), w11=t * u))


IV = "CASE WHEN (scene.y * 3 + scene.x) % 17 = 0 THEN 0.0 ELSE 1.0 / (1 + scene.x % 3) END"


@query("curve_of_growth_error", f"""WITH {SCENE}, rad AS (SELECT unnest([1.5, 2.5, 3.5, 4.5, 5.5, 6.5])::DOUBLE AS r), p AS (SELECT id, dy*dy + dx*dx AS d2, v, {IV} AS iv FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x)
  SELECT id, r, round(coalesce(sum(v - 50.0) FILTER (d2 < r*r), 0.0), 5) AS flux, round(sqrt(coalesce(sum(1 / iv) FILTER (d2 < r*r AND iv > 0), 0.0)), 6) AS err FROM p CROSS JOIN rad GROUP BY id, r""")
def curve_of_growth_error(spark: SparkSession, sf: str) -> DataFrame:
    """Light within radii and its error, some pixels of unknown variance."""
    iv = F.when((C("y") * 3 + C("x")) % 17 == 0, 0.0).otherwise(1.0 / (1 + C("x") % 3))
    image = scene(spark, sf).select("y", "x", "v").withColumn("iv", iv)
    c = M.curve_of_growth(B.references(spark, sf), image, RADII, "center", SKY, "iv")
    return c.select("id", "r", F.round("flux", 5).alias("flux"), F.round("err", 6).alias("err"))


@query("psf_elliptical_moffat", f"""WITH {B.STARS}, o AS (SELECT id, y - round_even(y, 0) AS dy, x - round_even(x, 0) AS dx, CAST(id % 180 AS DOUBLE) AS t FROM stars), e AS (SELECT *, dx * cos(radians(t)) + dy * sin(radians(t)) AS u, dy * cos(radians(t)) - dx * sin(radians(t)) AS w FROM o)
  SELECT id, round(1.5 * 4 * (pow(2, 0.4) - 1) / (pi() * 8.0) * pow(1 + 4 * (pow(2, 0.4) - 1) * (u*u / 16.0 + w*w / 4.0), -2.5), 8) AS value FROM e""")
def psf_elliptical_moffat(spark: SparkSession, sf: str) -> DataFrame:
    dy, dx = C("y") - F.rint("y"), C("x") - F.rint("x")
    return B.stars(spark, sf).select("id", F.round(M.elliptical_moffat(dy, dx, 2.0, 4.0, (C("id") % 180).cast("double"), 2.5), 8).alias("value"))


EE = "ee AS (SELECT s_suppkey % 7 AS k, CAST(s_suppkey // 7 + 1 AS DOUBLE) / 4 AS r FROM supplier)"


@query("encircled_models", f"""WITH {EE}, m AS (SELECT k, r, 1 - exp(-4 * ln(2) * r*r / 9.0) AS gaussian, 1 - pow(1 + r*r * 4 * (pow(2, 0.4) - 1) / 9.0, -1.5) AS moffat FROM ee),
  d AS (SELECT *, coalesce(lag(moffat) OVER w, 0.0) AS before, coalesce(lag(r) OVER w, 0.0) AS inner_r FROM m WINDOW w AS (PARTITION BY k ORDER BY r))
  SELECT k, r, round(gaussian, 9) AS gaussian, round(moffat, 9) AS moffat, round(moffat - before, 9) AS ring, round((moffat - before) / (pi() * (r*r - inner_r*inner_r)), 9) AS brightness FROM d""")
def encircled_models(spark: SparkSession, sf: str) -> DataFrame:
    """Encircled light of two profiles at rising radii, and the second's brightness in rings."""
    r = B.read(spark, sf, "supplier").select((C("s_suppkey") % 7).alias("k"), ((F.expr("s_suppkey div 7") + 1).cast("double") / 4).alias("r"))
    m = r.select("k", "r", M.encircled_gaussian(C("r"), 3.0).alias("gaussian"), M.encircled_moffat(C("r"), 3.0, 2.5).alias("moffat"))
    return M.ring_light(m, ["k"], "moffat").select("k", "r", *[F.round(c, 9).alias(c) for c in ("gaussian", "moffat", "ring", "brightness")])


@query("brightest_pixel", f"""WITH {B.PIXELS} SELECT band, y, x, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY v DESC, y, x) AS k FROM px) WHERE k = 1""")
def brightest_pixel(spark: SparkSession, sf: str) -> DataFrame:
    return M.brightest(B.pixels(spark, sf), ["band"]).select("band", "y", "x", F.round("v", 6).alias("v"))
