"""Queries of the stencils over the embedding image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import robust as R
from ..operators.background import background2d
from ..operators import stencil as T
from ..registry import query
from ..sources import bindings as B
from .robust_queries import MESH, PX

C = F.col
DIM = "dim AS (SELECT max(y) AS ny, max(x) AS nx FROM px)"
GAUSS = """g AS (SELECT dy, dx, exp(-(dy*dy + dx*dx) / 2.0) AS e FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)), k AS (SELECT dy, dx, e / (SELECT sum(e) FROM g) AS k FROM g)"""


def clamped(kernel: str, columns: str = "k") -> str:
    """The image's pixels with each tap of a kernel table and the pixel there, edges repeated."""
    return f"""(SELECT p.y, p.x, {columns}, greatest(1, least(ny, p.y + dy)) AS ty, greatest(1, least(nx, p.x + dx)) AS tx FROM px p CROSS JOIN dim CROSS JOIN {kernel}) p
  JOIN px q ON q.y = ty AND q.x = tx"""




def size_of(pixels: DataFrame) -> tuple[int, int]:
    r = pixels.agg(F.max("y"), F.max("x")).first()
    return r[0], r[1]


@query("correlate_replicate", f"{PX}, {DIM}, {GAUSS} SELECT p.y, p.x, round(sum(k * q.v), 6) AS c FROM {clamped('k')} GROUP BY p.y, p.x")
def correlate_replicate(spark: SparkSession, sf: str) -> DataFrame:
    return T.correlate(B.pixels(spark, sf), T.gaussian_kernel(5, 1.0)).select("y", "x", F.round("c", 6).alias("c"))


@query("correlate_zero", f"{PX}, {GAUSS} SELECT p.y, p.x, round(sum(k * q.v), 6) AS c FROM px p CROSS JOIN k JOIN px q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.y, p.x")
def correlate_zero(spark: SparkSession, sf: str) -> DataFrame:
    return T.correlate(B.pixels(spark, sf), T.gaussian_kernel(5, 1.0), border="zero").select("y", "x", F.round("c", 6).alias("c"))


@query("correlate_separable", f"{PX}, {DIM}, {GAUSS} SELECT p.y, p.x, round(sum(k * q.v), 6) AS c FROM {clamped('k')} GROUP BY p.y, p.x")
def correlate_separable(spark: SparkSession, sf: str) -> DataFrame:
    column, row = T.factored(T.gaussian_kernel(5, 1.0))
    return T.correlate_separable(B.pixels(spark, sf), column, row).select("y", "x", F.round("c", 6).alias("c"))


ZERO_SUM = "d AS (SELECT sum(k*k) - sum(k)*sum(k)/25 AS d, avg(k) AS m FROM k), f AS (SELECT dy, dx, (k - m) / d AS k, sqrt(d) AS norm FROM k, d)"


@query("matched_filter_uniform", f"{PX}, {DIM}, {GAUSS}, {ZERO_SUM} SELECT p.y, p.x, round(sum(k * q.v) * any_value(norm), 6) AS significance FROM {clamped('f', 'k, norm')} GROUP BY p.y, p.x")
def matched_filter_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return T.matched_filter(B.pixels(spark, sf), T.gaussian_kernel(5, 1.0)).select("y", "x", F.round("significance", 6).alias("significance"))


@query("matched_filter_weighted", f"""{PX}, {DIM}, {GAUSS}, {ZERO_SUM}, s AS (SELECT p.y, p.x, sum(k * q.v * ((q.y + q.x) % 4)) AS n, sum(k * k * ((q.y + q.x) % 4)) AS den FROM {clamped('f', 'k, norm')} GROUP BY p.y, p.x)
  SELECT y, x, round(CASE WHEN den > 0 THEN n / sqrt(den) ELSE 0.0 END, 6) AS significance FROM s""")
def matched_filter_weighted(spark: SparkSession, sf: str) -> DataFrame:
    weighted = B.pixels(spark, sf).withColumn("iv", ((C("y") + C("x")) % 4).cast("double"))
    return T.matched_filter(weighted, T.gaussian_kernel(5, 1.0), "iv").select("y", "x", F.round("significance", 6).alias("significance"))


AROUND = "(SELECT unnest([-1,0,1]) AS dy), (SELECT unnest([-1,0,1]) AS dx)"


@query("local_maxima_interior", f"{PX}, {DIM} SELECT p.y, p.x, round(any_value(p.v), 6) AS v FROM px p, dim, {AROUND}, px q WHERE (dy <> 0 OR dx <> 0) AND q.y = p.y + dy AND q.x = p.x + dx AND p.y > 1 AND p.x > 1 AND p.y < ny AND p.x < nx GROUP BY p.y, p.x HAVING bool_and(p.v > q.v)")
def local_maxima_interior(spark: SparkSession, sf: str) -> DataFrame:
    return T.local_maxima(B.pixels(spark, sf)).select("y", "x", F.round("v", 6).alias("v"))


@query("local_maxima_edges", f"{PX} SELECT p.y, p.x, round(any_value(p.v), 6) AS v FROM px p, {AROUND}, px q WHERE (dy <> 0 OR dx <> 0) AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.y, p.x HAVING bool_and(p.v > q.v)")
def local_maxima_edges(spark: SparkSession, sf: str) -> DataFrame:
    return T.local_maxima(B.pixels(spark, sf), edges=True).select("y", "x", F.round("v", 6).alias("v"))


@query("find_peaks_parabola", f"""{PX}, {DIM}, n AS (SELECT y, x, v, lag(v) OVER r AS w, lead(v) OVER r AS e, lag(v) OVER c AS s, lead(v) OVER c AS t FROM px WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)),
  m AS (SELECT p.y, p.x FROM px p, {AROUND}, px q WHERE (dy <> 0 OR dx <> 0) AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.y, p.x HAVING bool_and(p.v > q.v))
  SELECT y, x, round(y + greatest(-0.5, least(0.5, (t - s) / (2 * (2*v - t - s)))), 6) AS py, round(x + greatest(-0.5, least(0.5, (e - w) / (2 * (2*v - e - w)))), 6) AS px, round(v, 6) AS peak
  FROM n JOIN m USING (y, x), dim WHERE v >= 0.2 AND y > 2 AND y <= ny - 2 AND x > 2 AND x <= nx - 2""")
def find_peaks_parabola(spark: SparkSession, sf: str) -> DataFrame:
    px = B.pixels(spark, sf)
    found = T.refined_peaks(px, 0.2, 2, *size_of(px))
    return found.select("y", "x", *[F.round(c, 6).alias(c) for c in ("py", "px", "peak")])


@query("mesh_median_filter", f"""{PX}, {MESH}, md AS (SELECT max(mi) AS hi, max(mj) AS hj FROM mesh)
  SELECT a.mi, a.mj, round(median(b.bkg), 6) AS m FROM mesh a CROSS JOIN md CROSS JOIN {AROUND.replace(', (', ' CROSS JOIN (')} JOIN mesh b ON b.mi = greatest(0, least(hi, a.mi + dy)) AND b.mj = greatest(0, least(hj, a.mj + dx)) GROUP BY a.mi, a.mj""")
def mesh_median_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filtered_mesh(spark, sf).select("mi", "mj", F.round("m", 6).alias("m"))


def filtered_mesh(spark: SparkSession, sf: str) -> DataFrame:
    m = R.mesh(B.pixels(spark, sf), (16, 16)).select((C("mi") + 1).alias("y"), (C("mj") + 1).alias("x"), C("bkg").alias("v"))
    return T.median_filter(m, 1).select((C("y") - 1).alias("mi"), (C("x") - 1).alias("mj"), "m")


ZOOM = """mdim AS (SELECT max(mi) + 1 AS hi, max(mj) + 1 AS hj FROM fm), pos0 AS (SELECT y, x, v, greatest(1.0, least(CAST(hi AS DOUBLE), (y - 0.5) * hi / (hi * 16) + 0.5)) AS cy, greatest(1.0, least(CAST(hj AS DOUBLE), (x - 0.5) * hj / (hj * 16) + 0.5)) AS cx, hi, hj FROM px, mdim),
  fr AS (SELECT *, CAST(floor(cy) AS BIGINT) AS i0, CAST(floor(cx) AS BIGINT) AS j0, cy - floor(cy) AS t, cx - floor(cx) AS u FROM pos0),
  taps AS (SELECT a, b FROM (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b)),
  z AS (SELECT f.y, f.x, any_value(f.v) AS v, sum(m.m * CASE a WHEN 0 THEN (-t+2*t*t-t*t*t)/2 WHEN 1 THEN (2-5*t*t+3*t*t*t)/2 WHEN 2 THEN (t+4*t*t-3*t*t*t)/2 ELSE (-t*t+t*t*t)/2 END
   * CASE b WHEN 0 THEN (-u+2*u*u-u*u*u)/2 WHEN 1 THEN (2-5*u*u+3*u*u*u)/2 WHEN 2 THEN (u+4*u*u-3*u*u*u)/2 ELSE (-u*u+u*u*u)/2 END) AS z
   FROM fr f CROSS JOIN taps JOIN fm m ON m.mi = greatest(1, least(hi, i0 + a - 1)) - 1 AND m.mj = greatest(1, least(hj, j0 + b - 1)) - 1 GROUP BY f.y, f.x)"""


@query("mesh_zoom", f"{PX}, fm AS (SELECT (y - 1) // 16 AS mi, (x - 1) // 16 AS mj, avg(v) AS m FROM px GROUP BY ALL), {ZOOM} SELECT y, x, round(z, 6) AS z FROM z")
def mesh_zoom(spark: SparkSession, sf: str) -> DataFrame:
    px = B.pixels(spark, sf)
    m = px.groupBy(F.expr("(y - 1) div 16").alias("mi"), F.expr("(x - 1) div 16").alias("mj")).agg(F.avg("v").alias("m"))
    rows, cols = (v + 1 for v in m.agg(F.max("mi"), F.max("mj")).first())
    return T.zoom(m, px, "m", rows, cols, rows * 16, cols * 16, "z").select("y", "x", F.round("z", 6).alias("z"))


@query("background2d_residual", f"""{PX}, {MESH}, md AS (SELECT max(mi) AS hi, max(mj) AS hj FROM mesh),
  fm AS (SELECT a.mi, a.mj, median(b.bkg) AS m FROM mesh a CROSS JOIN md CROSS JOIN {AROUND.replace(', (', ' CROSS JOIN (')} JOIN mesh b ON b.mi = greatest(0, least(hi, a.mi + dy)) AND b.mj = greatest(0, least(hj, a.mj + dx)) GROUP BY a.mi, a.mj), {ZOOM}
  SELECT y, x, round(z, 5) AS background, round(v - z, 5) AS residual FROM z""")
def background2d_residual(spark: SparkSession, sf: str) -> DataFrame:
    """The whole background: boxes, median filter, interpolation to pixels, difference."""
    px, m = B.pixels(spark, sf), filtered_mesh(spark, sf)
    rows, cols = (v + 1 for v in m.agg(F.max("mi"), F.max("mj")).first())
    z = T.zoom(m, px, "m", rows, cols, rows * 16, cols * 16, "z")
    return z.select("y", "x", F.round("z", 5).alias("background"), F.round(C("v") - C("z"), 5).alias("residual"))


@query("background_autocov_lags", f"""{PX}, l AS (SELECT dy, dx FROM (SELECT unnest(range(0, 3)) AS dy), (SELECT unnest(range(0, 3)) AS dx))
  SELECT dy, dx, count(*) AS n, round(avg(p.v * q.v), 8) AS cov FROM px p, l, px q WHERE q.y = p.y + dy AND q.x = p.x + dx GROUP BY dy, dx""")
def background_autocov_lags(spark: SparkSession, sf: str) -> DataFrame:
    found = T.lag_products(B.pixels(spark, sf), [(dy, dx) for dy in range(3) for dx in range(3)])
    return found.select(C("dy").cast("long").alias("dy"), C("dx").cast("long").alias("dx"), "n", F.round("cov", 8).alias("cov"))


@query("bad_pixel_mask", f"""{PX}, p AS (SELECT y, x, v, CASE WHEN (y * 7 + x) % 97 = 0 THEN 0.0 WHEN (y * 13 + x * 5) % 89 = 0 THEN 3.0 ELSE 0.02 + abs(v) / 10 END AS err FROM px),
  u AS (SELECT *, err > 0 AS usable FROM p), g AS (SELECT median(v) AS sky, median(err) AS sig FROM u WHERE usable),
  c AS (SELECT u.*, usable AND v < sky - 10 * greatest(sig, err) AS cold FROM u, g),
  n AS (SELECT c.y, c.x, count(*) AS n, median(q.err) AS m FROM c, {AROUND}, u q WHERE (dy <> 0 OR dx <> 0) AND q.y = c.y + dy AND q.x = c.x + dx AND q.usable GROUP BY c.y, c.x)
  SELECT c.y, c.x, CASE WHEN NOT usable THEN 'err' WHEN cold THEN 'cold' WHEN n.n >= 3 AND err > 10 * m THEN 'hot' ELSE 'good' END AS kind FROM c LEFT JOIN n USING (y, x)""")
def bad_pixel_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with a void error, far below the sky, or with an error far above the median of their neighbours'."""
    y, x = C("y"), C("x")
    err = F.when((y * 7 + x) % 97 == 0, 0.0).when((y * 13 + x * 5) % 89 == 0, 3.0).otherwise(0.02 + F.abs("v") / 10)
    p = B.pixels(spark, sf).withColumn("err", err).withColumn("good_err", F.when(C("err") > 0, C("err")))
    level = {"sky": R.overall(p.where("err > 0"), "v"), "sig": R.overall(p.where("err > 0"), "err")}
    around = T.neighbourhood(p, 1, "good_err", "null", (), "nb")
    flat = F.flatten("nb")
    others = F.array_sort(F.filter(F.concat(F.slice(flat, 1, 4), F.slice(flat, 6, 4)), lambda e: e.isNotNull()))
    n = F.size("o")
    med = (F.get("o", F.floor((n - 1) / 2).cast("int")) + F.get("o", F.floor(n / 2).cast("int"))) / 2
    cold = C("v") < level["sky"] - 10 * F.greatest(F.lit(level["sig"]), C("err"))
    hot = (n >= 3) & (C("err") > 10 * med)
    kind = F.when(C("err") <= 0, "err").when(cold, "cold").when(F.coalesce(hot, F.lit(False)), "hot").otherwise("good")
    return around.withColumn("o", others).select("y", "x", kind.alias("kind"))


@query("bicubic_interpolate", f"""{PX}, {DIM}, s AS (SELECT y, x, y + 0.3 AS fy, x + 0.6 AS fx FROM px, dim WHERE y > 1 AND x > 1 AND y < ny - 1 AND x < nx - 1),
  taps AS (SELECT a, b FROM (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b))
  SELECT s.y, s.x, round(sum(q.v * [(-0.3+2*0.09-0.027)/2, (2-5*0.09+3*0.027)/2, (0.3+4*0.09-3*0.027)/2, (-0.09+0.027)/2][a + 1] * [(-0.6+2*0.36-0.216)/2, (2-5*0.36+3*0.216)/2, (0.6+4*0.36-3*0.216)/2, (-0.36+0.216)/2][b + 1]), 6) AS value
  FROM s CROSS JOIN taps JOIN px q ON q.y = s.y + a - 1 AND q.x = s.x + b - 1 GROUP BY s.y, s.x""")
def bicubic_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    """The image at 0.3 and 0.6 pixels past each interior pixel."""
    from ..functions.scalar import catmull_rom_weights

    px = B.pixels(spark, sf)
    ny, nx = size_of(px)
    wy, wx = catmull_rom_weights(F.lit(0.3)), catmull_rom_weights(F.lit(0.6))
    total = F.lit(0.0)
    for a in range(4):
        for b in range(4):
            total = total + wy[a] * wx[b] * T.tap("nb", 2, a - 1, b - 1)
    inside = (C("y") > 1) & (C("x") > 1) & (C("y") < ny - 1) & (C("x") < nx - 1)
    return T.neighbourhood(px, 2, "v", "null", (), "nb").where(inside).select("y", "x", F.round(total, 6).alias("value"))


MASKED = """, allpx AS (SELECT y, x, v, band, ((y - 1) // 16 * 3 + (x - 1) // 16 * 2) % 7 = 5 AND (y + x) % 20 <> 0 OR (y * x) % 13 = 0 AS masked, y + 2 * x > 200 AND y < 100 AS outside FROM rawpx), px AS (SELECT * FROM allpx WHERE NOT masked AND NOT outside)"""


@query("background2d_masked", f"""{PX.replace("px AS", "rawpx AS", 1)}{MASKED}, {MESH.replace("mesh AS (SELECT", "kept AS (SELECT")}, md AS (SELECT (max(y) - 1) // 16 AS hi, (max(x) - 1) // 16 AS hj FROM allpx), ij AS (SELECT i AS mi, j AS mj FROM md, (SELECT unnest(range(0, (SELECT hi + 1 FROM md))) AS i), (SELECT unnest(range(0, (SELECT hj + 1 FROM md))) AS j)),
  holed AS (SELECT mi, mj, CASE WHEN n >= 25.6 THEN bkg END AS bkg FROM ij LEFT JOIN kept USING (mi, mj)),
  mesh AS (SELECT a.mi, a.mj, coalesce(max(a.bkg), avg(b.bkg)) AS bkg FROM holed a CROSS JOIN md CROSS JOIN {AROUND.replace(', (', ' CROSS JOIN (')} JOIN holed b ON b.mi = greatest(0, least(hi, a.mi + dy)) AND b.mj = greatest(0, least(hj, a.mj + dx)) GROUP BY a.mi, a.mj),
  fm AS (SELECT a.mi, a.mj, median(b.bkg) AS m FROM mesh a CROSS JOIN md CROSS JOIN {AROUND.replace(', (', ' CROSS JOIN (')} JOIN mesh b ON b.mi = greatest(0, least(hi, a.mi + dy)) AND b.mj = greatest(0, least(hj, a.mj + dx)) GROUP BY a.mi, a.mj), {ZOOM.replace("FROM px, mdim", "FROM allpx, mdim")}
  SELECT y, x, round(CASE WHEN outside THEN -1.0 ELSE z END, 5) AS background FROM z JOIN allpx USING (y, x)""")
def background2d_masked(spark: SparkSession, sf: str) -> DataFrame:
    """The background of an image with masked pixels, void boxes none beside another, and a corner outside its coverage."""
    box = F.expr("(y - 1) div 16 * 3 + (x - 1) div 16 * 2") % 7 == 5
    p = B.pixels(spark, sf).withColumns({"masked": (box & ((C("y") + C("x")) % 20 != 0)) | ((C("y") * C("x")) % 13 == 0), "outside": (C("y") + 2 * C("x") > 200) & (C("y") < 100)})
    return background2d(p, 16, fill_value=-1.0).select("y", "x", F.round("background", 5).alias("background"))
