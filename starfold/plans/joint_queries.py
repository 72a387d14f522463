"""Queries over many images and catalogs: bands, coadds, tiles, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joint as J
from ..operators import spatial as P
from ..operators import stencil as T
from ..operators import robust as R
from ..registry import query
from ..shared import materialize, shuffled
from ..sources import bindings as B
from .image_queries import AROUND
from .measure_queries import FWHM, RADIUS, SCENE, scene
from .robust_queries import PX

C = F.col
STAR = f"WITH {B.STARS}"
STACK = f"""{PX}, stack AS (SELECT band, dense_rank() OVER (PARTITION BY band ORDER BY y) AS y, x, v FROM px)"""


def r6(**columns) -> list:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def stack(spark: SparkSession, sf: str) -> DataFrame:
    """Ten images, one for each band; a band's rows are numbered anew."""
    vectors = B.read(spark, sf, "embeddings").select("vec_id", C("label").cast("long").alias("band"))
    rows = vectors.withColumn("row", F.row_number().over(Window.partitionBy("band").orderBy("vec_id")).cast("long"))
    return B.pixels(spark, sf).drop("band").join(rows.select((C("vec_id") + 1).alias("y"), "band", "row"), "y").select("band", C("row").alias("y"), "x", "v")


@query("stouffer_significance", f"""{PX}, s AS (SELECT x, band, sum(v) / (0.125 * sqrt(count(*))) AS nu FROM px GROUP BY x, band) SELECT x, count(*) AS bands, round(sum(nu) / sqrt(count(*)), 6) AS significance FROM s GROUP BY x""")
def stouffer_significance(spark: SparkSession, sf: str) -> DataFrame:
    s = B.pixels(spark, sf).groupBy("x", "band").agg((F.sum("v") / (0.125 * F.sqrt(F.count("*")))).alias("nu"))
    return s.groupBy("x").agg(F.count("*").alias("bands"), F.round(F.sum("nu") / F.sqrt(F.count("*")), 6).alias("significance"))


@query("joint_band_fold", f"""{STACK}, g AS (SELECT x, band, sum(v * (1 + y % 3)) AS n, sum((1 + y % 3) * (1 + y % 3)) - CASE WHEN band = 7 THEN 1e9 ELSE 0 END AS d, sum((1 + y % 3) * (1 + y % 3)) / 64.0 AS v, 1.0 + band / 10.0 AS w FROM stack GROUP BY x, band)
  SELECT x, round(sum(w * n / sqrt(v)) FILTER (d > 0) / sqrt(sum(w * w) FILTER (d > 0)), 5) AS nu, count(*) FILTER (d > 0) AS bands FROM g GROUP BY x""")
def joint_band_fold(spark: SparkSession, sf: str) -> DataFrame:
    g = 1 + C("y") % 3
    sums = stack(spark, sf).groupBy("x", "band").agg(F.sum(C("v") * g).alias("n"), F.sum(g * g).cast("double").alias("d"), (F.sum(g * g) / 64.0).alias("v"))
    sums = sums.withColumns({"d": C("d") - F.when(C("band") == 7, 1e9).otherwise(0.0), "w": 1.0 + C("band") / 10.0})
    return J.fold_bands(sums, ["x"]).select("x", F.round("nu", 5).alias("nu"), "bands")


@query("coadd_shift_only", f"""{STACK}, p AS (SELECT band, v, 1.0 + band AS w, y + (band % 3) * 0.25 AS oy, x + (band % 4) * 0.25 AS ox FROM stack),
  d AS (SELECT band, v, w, CAST(floor(oy) AS BIGINT) + i AS y, CAST(floor(ox) AS BIGINT) + j AS x, (CASE WHEN i = 1 THEN oy - floor(oy) ELSE 1 - (oy - floor(oy)) END) * (CASE WHEN j = 1 THEN ox - floor(ox) ELSE 1 - (ox - floor(ox)) END) AS a
    FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
  SELECT y, x, round(sum(a*w*v) / sum(a*w), 6) AS value, round(sqrt(sum(a*a*w)) / sum(a*w), 6) AS rms, round(sum(a*w), 6) AS weight, count(DISTINCT band) AS nimg FROM d WHERE a > 0 GROUP BY y, x""")
def coadd_shift_only(spark: SparkSession, sf: str) -> DataFrame:
    p = stack(spark, sf).select(C("band").alias("image"), "v", (1.0 + C("band")).alias("w"), (C("y") + (C("band") % 3) * 0.25).alias("oy"), (C("x") + (C("band") % 4) * 0.25).alias("ox"))
    return J.drizzle(p, []).select("y", "x", *r6(value=C("value"), rms=C("rms"), weight=C("weight")), "nimg")


@query("coadd_clip", f"""{STACK}, m AS (SELECT y, x, median(v) AS m, count(*) AS n FROM stack GROUP BY y, x)
  SELECT y, x, count(*) AS nimg, round(avg(v), 6) AS value FROM stack JOIN m USING (y, x) WHERE NOT (abs(v - m) * sqrt(64.0) > 1.5 AND n >= 5) GROUP BY y, x""")
def coadd_clip(spark: SparkSession, sf: str) -> DataFrame:
    kept = J.clip_stack(stack(spark, sf).withColumn("w", F.lit(64.0)), ["y", "x"], 1.5)
    return kept.groupBy("y", "x").agg(F.count("*").alias("nimg"), F.round(F.avg("v"), 6).alias("value"))


@query("tile_halo_counts", f"""{PX}, m AS (SELECT (max(y) - 1) // 32 AS hy, (max(x) - 1) // 32 AS hx FROM px), t AS (SELECT ty, tx FROM m, (SELECT unnest(range(0, 200)) AS ty), (SELECT unnest(range(0, 4)) AS tx) WHERE ty <= hy AND tx <= hx)
  SELECT ty, tx, count(*) AS padded, count(*) FILTER ((y - 1) // 32 = ty AND (x - 1) // 32 = tx) AS owned, round(sum(v), 5) AS light FROM t JOIN px ON y BETWEEN ty * 32 + 1 - 4 AND ty * 32 + 32 + 4 AND x BETWEEN tx * 32 + 1 - 4 AND tx * 32 + 32 + 4 GROUP BY ty, tx""")
def tile_halo_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = J.tiles_of(B.pixels(spark, sf), 32, 4)
    return t.groupBy("ty", "tx").agg(F.count("*").alias("padded"), F.count_if("owned").alias("owned"), F.round(F.sum("v"), 5).alias("light"))


@query("cutout_tiles", f"""{STACK}, b AS (SELECT band, min(y) + band * 7 AS y0, max(y) + band * 7 AS y1, min(x) AS x0, max(x) AS x1 FROM stack GROUP BY band), t AS (SELECT ty * 24 + 1 AS a, ty * 24 + 24 AS z, ty FROM (SELECT unnest(range(0, 300)) AS ty))
  SELECT band, ty, greatest(y0, a) AS lo, least(y1, z) AS hi FROM b JOIN t ON y0 <= z AND a <= y1""")
def cutout_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Image footprints cut by the tiles they meet."""
    b = stack(spark, sf).groupBy("band").agg(F.min("y").alias("y0"), F.max("y").alias("y1")).select("band", (C("y0") + C("band") * 7).alias("y0"), (C("y1") + C("band") * 7).alias("y1"))
    ty = F.explode(F.sequence(F.expr("(y0 - 1) div 24"), F.expr("(y1 - 1) div 24"))).alias("ty")
    return b.select("*", ty).select("band", "ty", F.greatest("y0", C("ty") * 24 + 1).alias("lo"), F.least("y1", C("ty") * 24 + 24).alias("hi"))


@query("blend_gate", f"WITH {SCENE}, {B.STARS} SELECT s.id, s.flux * 0.11 > 1.5 * greatest(model, 0) AS keep FROM stars s JOIN scene ON scene.y = CAST(round_even(s.y, 0) AS BIGINT) AND scene.x = CAST(round_even(s.x, 0) AS BIGINT)")
def blend_gate(spark: SparkSession, sf: str) -> DataFrame:
    """New peaks that rise well above what the model already has at their pixel."""
    new = B.stars(spark, sf).select("id", "flux", F.rint("y").cast("long").alias("y"), F.rint("x").cast("long").alias("x"))
    return new.join(shuffled(scene(spark, sf).select("y", "x", "model")), ["y", "x"]).select("id", (C("flux") * 0.11 > 1.5 * F.greatest(C("model"), F.lit(0.0))).alias("keep"))


@query("model_radii", STAR + " SELECT id, CAST(coalesce((SELECT min(r) FROM (SELECT unnest(range(1, 9)) AS r) WHERE flux * exp(-r * r / 4.0) <= 1.0), 8) AS BIGINT) AS radius FROM stars")
def model_radii(spark: SparkSession, sf: str) -> DataFrame:
    import math

    profile = [math.exp(-r * r / 4.0) for r in range(1, 9)]
    return B.stars(spark, sf).select("id", J.model_radius(C("flux"), 2.0, 0.5, profile).cast("long").alias("radius"))


@query("flux_laws", STAR + """, u AS (SELECT id, (id * 7919 % 1000) / 1000.0 AS u FROM stars) SELECT id, round(100 + u * 900, 4) AS uniform, round(exp(ln(100) + u * ln(10)), 4) AS loguniform, round(pow(pow(100, -1.0) + u * (pow(1000, -1.0) - pow(100, -1.0)), -1.0), 4) AS powerlaw FROM u""")
def flux_laws(spark: SparkSession, sf: str) -> DataFrame:
    u = (C("id") * 7919 % 1000) / 1000.0
    return B.stars(spark, sf).select("id", *[F.round(J.flux_law(u, k, 100.0, 1000.0), 4).alias(k) for k in ("uniform", "loguniform", "powerlaw")])


@query("poly_map", STAR + " SELECT id, round(1.5 + 0.9 * x + 0.01 * x * x + y * (0.2 + 0.003 * x) + y * y * 0.0005, 5) AS row FROM (SELECT id, x / 64 AS x, (y - field * 128) / 64 AS y FROM stars)")
def poly_map(spark: SparkSession, sf: str) -> DataFrame:
    row = J.poly_map([[1.5, 0.9, 0.01], [0.2, 0.003], [0.0005]], (C("y") - C("field") * B.SIDE) / 64, C("x") / 64)
    return B.stars(spark, sf).select("id", F.round(row, 5).alias("row"))


@query("pick_psf_stars", STAR + """, q AS (SELECT quantile_cont(flux, 0.4) AS q FROM stars), b AS (SELECT id, flux, x - floor(x) AS c FROM stars, q WHERE flux >= q), l AS (SELECT min(flux) AS lo, max(flux) AS hi FROM b),
  g AS (SELECT id, flux, c, least(CAST(floor((flux - lo) / ((hi - lo) / 4)) AS BIGINT), 3) AS bin FROM b, l), s AS (SELECT bin, median(c) AS m, stddev_pop(c) AS s, count(*) AS n FROM g GROUP BY bin)
  SELECT id, round(flux, 4) AS flux FROM g JOIN s USING (bin) WHERE n >= 4 AND abs(c - m) <= 1.0 * s""")
def pick_psf_stars(spark: SparkSession, sf: str) -> DataFrame:
    stars = B.stars(spark, sf).select("id", "flux", (C("x") - F.floor("x").cast("double")).alias("c"))
    return J.pick_stars(stars, 0.4, 4, "c", 1.0).select("id", F.round("flux", 4).alias("flux"))


@query("star_outliers", STAR + ", w AS (SELECT id FROM stars WHERE x > 120 ORDER BY x DESC, id LIMIT (SELECT CAST(ceil(0.02 * count(*)) AS BIGINT) FROM stars)) SELECT id FROM stars WHERE id NOT IN (SELECT id FROM w)")
def star_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Removal of the worst scores, limited to a share of all."""
    return J.worst_first(B.stars(spark, sf), "x", 0.02, 120.0).select("id")


@query("catalog_concat", STAR + f""", {B.REFERENCES} SELECT id, round(flux, 4) AS flux_a, 'nan'::DOUBLE AS flux_b FROM stars UNION ALL SELECT id, 'nan'::DOUBLE AS flux_a, round(flux, 4) AS flux_b FROM refs""")
def catalog_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogs of different bands under one schema."""
    a = B.stars(spark, sf).select("id", F.round("flux", 4).alias("flux_a"))
    b = B.references(spark, sf).select("id", F.round("flux", 4).alias("flux_b"))
    return J.missing_columns(a, b)


@query("bands_first_seen", f"""{PX} SELECT band, min(y) AS first FROM px GROUP BY band""")
def bands_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return J.first_seen(B.pixels(spark, sf), "band", "y")


@query("top_coupled_neighbours", STAR + """, p AS (SELECT a.id AS i, b.id AS j, exp(-((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) / 4) * b.flux AS c FROM stars a JOIN stars b ON a.id <> b.id AND a.y BETWEEN b.y - 4 AND b.y + 4 AND (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) <= 16)
  SELECT i, j, k AS place FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS k FROM p) WHERE k <= 3""")
def top_coupled_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    s = B.stars(spark, sf)
    near = P.cross_pairs(s, s, 4.0).where("a_id <> b_id").join(shuffled(s.select(C("id").alias("b_id"), "flux")), "b_id")
    pairs = near.select(C("a_id").alias("i"), C("b_id").alias("j"), (F.exp(-C("d2") / 4) * C("flux")).alias("coupling"))
    return J.top_coupled(pairs, 3).select("i", "j", C("place").cast("long").alias("place"))


@query("covariance_valid", f"""WITH {SCENE}, b AS (SELECT y, x, model < 2.0 * 0.5 AS ok FROM scene) SELECT a.y, a.x, bool_and(q.ok) AS valid FROM b a, {AROUND}, b q WHERE q.y = a.y + dy AND q.x = a.x + dx GROUP BY a.y, a.x""")
def covariance_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels where neither they nor a neighbour hold model light above the noise."""
    lit = scene(spark, sf).select("y", "x", F.when(C("model") < 2.0 * 0.5, 0.0).otherwise(1.0).alias("lit"))
    nb = T.neighbourhood(lit, 1, "lit", "null", (), "nb")
    return nb.select("y", "x", (F.array_max(F.flatten("nb")) == 0).alias("valid"))


@query("uniform_delta", f"""{PX}, p AS (SELECT y, x, v, v / 3 AS d, (y * 31 + x) % 5 = 0 AS jump FROM px), g AS (SELECT median(v) AS sky FROM px)
  SELECT y, x, round(CASE WHEN jump AND NOT abs(d) <= 1.0 * sqrt(0.0004 + 0.04 * greatest(v - sky, 0) * greatest(v - sky, 0)) THEN 0.0 ELSE d END, 6) AS delta FROM p, g""")
def uniform_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections of jump pixels, set to zero where they exceed what noise and a share of the signal allow."""
    p = B.pixels(spark, sf)
    sky = R.overall(p, "v")
    signal, d = F.greatest(C("v") - sky, F.lit(0.0)), C("v") / 3
    jump = (C("y") * 31 + C("x")) % 5 == 0
    return p.select("y", "x", F.round(F.when(jump & ~(F.abs(d) <= F.sqrt(0.0004 + 0.04 * signal * signal)), 0.0).otherwise(d), 6).alias("delta"))


@query("epsf_project_combine", f"""WITH {SCENE}, p AS (SELECT CAST(round(dy * 2, 0) AS BIGINT) AS gy, CAST(round(dx * 2, 0) AS BIGINT) AS gx, (v - 50.0) / flux AS s FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x WHERE abs(so.py - round_even(so.y, 0)) <= 3 AND abs(so.px - round_even(so.x, 0)) <= 3),
  m AS (SELECT gy, gx, median(s) AS m FROM p GROUP BY gy, gx), d AS (SELECT gy, gx, median(abs(s - m)) AS d FROM p JOIN m USING (gy, gx) GROUP BY gy, gx)
  SELECT gy, gx, count(*) AS n, round(median(s), 6) AS value FROM p JOIN m USING (gy, gx) JOIN d USING (gy, gx) WHERE abs(s - m) <= 3 * 1.4826 * d + 1e-12 GROUP BY gy, gx HAVING count(*) >= 4""")
def epsf_project_combine(spark: SparkSession, sf: str) -> DataFrame:
    """Star pixels on a grid of half pixels around each star, combined by a clipped median."""
    from ..operators import measure as M

    met = M.on_image(B.references(spark, sf), scene(spark, sf).select("y", "x", "v"), 3)
    p = met.select(F.round(C("dy") * 2).cast("long").alias("gy"), F.round(C("dx") * 2).cast("long").alias("gx"), ((C("v") - 50.0) / C("flux")).alias("s_"))
    near = R.about_median(p, ["gy", "gx"], "s_").where(F.abs(C("s_") - C("m")) <= 3 * 1.4826 * C("s") + 1e-12)
    kept = materialize(near.select("gy", "gx", "s_"), "profile")  # a cell holds a value of every star
    counts = kept.groupBy("gy", "gx").agg(F.count("*").alias("n")).where("n >= 4")
    return R.medians(kept, ["gy", "gx"], "s_", "value").join(counts, ["gy", "gx"]).select("gy", "gx", "n", F.round("value", 6).alias("value"))


@query("psf_autocorrelation", f"""WITH g AS (SELECT dy, dx, exp(-4 * ln(2) * (dy*dy + dx*dx) / 9.0) * 4 * ln(2) / (pi() * 9.0) AS p FROM (SELECT unnest(range(-8, 9)) AS dy), (SELECT unnest(range(-8, 9)) AS dx)), l AS (SELECT ly, lx FROM (SELECT unnest(range(0, 4)) AS ly), (SELECT unnest(range(0, 4)) AS lx))
  SELECT ly, lx, round(sum(a.p * b.p), 8) AS acf FROM l, g a, g b WHERE b.dy = a.dy + ly AND b.dx = a.dx + lx GROUP BY ly, lx""")
def psf_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import measure as M

    side = 2 * RADIUS + 1
    grid = spark.range(side * side).select((F.expr(f"id div {side}") - RADIUS).alias("y"), (C("id") % side - RADIUS).alias("x")).withColumn("v", M.gaussian(C("y"), C("x"), FWHM))
    acf = T.lag_products(grid, [(a, b) for a in range(4) for b in range(4)])
    return acf.select(C("dy").cast("long").alias("ly"), C("dx").cast("long").alias("lx"), F.round(C("cov") * C("n"), 8).alias("acf"))
