"""Sources against many images, first guesses, selections, sizes and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scene as Z
from ..operators.coadd import poly_with_slopes, step
from ..registry import query
from ..sources import bindings as B
from .coadd_queries import EXPOSURES, exposures
from .measure_queries import SCENE, scene
from .robust_queries import PX

C = F.col
STAR = f"WITH {B.STARS}"
IMAGES = """nr AS (SELECT CAST((max(vec_id) // 12) + 1 AS BIGINT) AS ny FROM embeddings), ims AS (SELECT i AS image, ny, 64 AS nx, (i % 4) * 0.25 - 3.0 AS ay, 0.25 AS by_, (i % 3) * 0.25 + 1.0 AS ax, 0.4 AS bx, 1 + i / 16 AS fs, 1.0 + i % 2 AS bw FROM nr, (SELECT unnest(range(0, 12)) AS i) WHERE i <> 5),
  se AS (SELECT id, flux, image, fs, bw, ay + by_ * y AS iy, ax + bx * x AS ix FROM stars, ims WHERE ay + by_ * y BETWEEN 0.5 AND ny + 0.5 AND ax + bx * x BETWEEN 0.5 AND nx + 0.5)"""


def seen(spark: SparkSession, sf: str) -> DataFrame:
    """Stars in eleven of twelve images; one is excluded by name."""
    ny = B.read(spark, sf, "embeddings").agg(F.expr("max(vec_id) div 12 + 1")).first()[0]
    rows = [(i, ny, 64, (i % 4) * 0.25 - 3.0, 0.25, (i % 3) * 0.25 + 1.0, 0.4, 1 + i / 16, 1.0 + i % 2) for i in range(12)]
    images = spark.createDataFrame(rows, "image long, ny long, nx long, ay double, by double, ax double, bx double, flux_scale double, band_weight double")
    return Z.seen_in(B.stars(spark, sf).select("id", "y", "x", "flux"), images, exclude=spark.createDataFrame([(5,)], "image long"))


@query("images_of_sources", f"{STAR}, {IMAGES} SELECT id, image, round(iy, 6) AS iy, round(ix, 6) AS ix FROM se")
def images_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    return seen(spark, sf).select("id", "image", F.round("iy", 6).alias("iy"), F.round("ix", 6).alias("ix"))


@query("blend_terms", f"""{EXPOSURES}, {B.STARS}, {IMAGES} SELECT id, round(sum(bw * sqrt(weight) * fs * flux * 4 * ln(2) / (pi() * 9.0) * exp(-4 * ln(2) * (pow(e.y - iy, 2) + pow(e.x - ix, 2)) / 9.0)), 4) AS light, round(sum(bw * sqrt(weight) * greatest(model, 0)), 4) AS model, count(*) AS images
  FROM se JOIN e ON e.image = se.image AND e.y = CAST(round_even(iy, 0) AS BIGINT) AND e.x = CAST(round_even(ix, 0) AS BIGINT) GROUP BY id""")
def blend_terms(spark: SparkSession, sf: str) -> DataFrame:
    """New light against the catalog's at the pixels of sources, over all images that see them."""
    t = Z.blend_terms(seen(spark, sf), exposures(spark, sf).withColumn("iv", C("weight")), 3.0)
    return t.select("id", F.round("light", 4).alias("light"), F.round("model", 4).alias("model"), "images")


@query("star_first_guess", f"""WITH {SCENE}, s AS (SELECT id, v, abs(so.py - round_even(so.y, 0)) = 4 OR abs(so.px - round_even(so.x, 0)) = 4 AS edge FROM so JOIN scene ON so.py = scene.y AND so.px = scene.x WHERE abs(so.py - round_even(so.y, 0)) <= 4 AND abs(so.px - round_even(so.x, 0)) <= 4),
  b AS (SELECT id, coalesce(median(v) FILTER (edge), 0.0) AS bkg FROM s GROUP BY id), l AS (SELECT id, bkg, greatest(v - bkg, 0.0) AS l FROM s JOIN b USING (id)), c AS (SELECT id, list_sort(list(l))[greatest(1, CAST(ceil(0.98 * count(*)) AS BIGINT))] AS cap FROM l GROUP BY id)
  SELECT id, round(any_value(bkg), 5) AS bkg, round(sum(least(l, cap)), 4) AS flux FROM l JOIN c USING (id) GROUP BY id HAVING sum(least(l, cap)) > 1e-9""")
def star_first_guess(spark: SparkSession, sf: str) -> DataFrame:
    """Backgrounds from stamp edges and capped fluxes."""
    g = Z.first_guess(B.references(spark, sf), scene(spark, sf).select("y", "x", "v"), 4)
    return g.select("id", F.round("bkg", 5).alias("bkg"), F.round("flux", 4).alias("flux"))


@query("drift_removal", f"{STAR}, n AS (SELECT id, id % 5 <> 0 AS used, y + 0.3 + (id % 7) / 100 AS ny, x - 0.2 + (id % 11) / 100 AS nx, y, x FROM stars), m AS (SELECT median(ny - y) AS dy, median(nx - x) AS dx FROM n WHERE used) SELECT id, round(CASE WHEN used THEN ny - dy ELSE ny END, 6) AS y, round(CASE WHEN used THEN nx - dx ELSE nx END, 6) AS x FROM n, m")
def drift_removal(spark: SparkSession, sf: str) -> DataFrame:
    """Positions less the common shift of the stars in use."""
    s = B.stars(spark, sf).select("id", (C("id") % 5 != 0).alias("used"), C("y").alias("y_old"), C("x").alias("x_old"), (C("y") + 0.3 + (C("id") % 7) / 100).alias("y"), (C("x") - 0.2 + (C("id") % 11) / 100).alias("x"))
    return Z.without_drift(s).select("id", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"))


@query("refining_stars", f"{STAR} SELECT id % 3 AS band, id, round(flux, 6) AS snr FROM stars WHERE flux BETWEEN 905 AND 990 QUALIFY row_number() OVER (PARTITION BY id % 3 ORDER BY md5(CAST(id AS VARCHAR)), id) <= 100")
def refining_stars(spark: SparkSession, sf: str) -> DataFrame:
    """Up to a hundred stars of each band in a range of signal to noise."""
    s = B.stars(spark, sf).select((C("id") % 3).alias("band"), "id", C("flux").alias("snr"))
    return Z.refining_stars(s, 905.0, 990.0, 100).withColumn("snr", F.round("snr", 6))


@query("kernel_templates", f"{PX}, b AS (SELECT y, x, exp(v) AS p FROM px), s AS (SELECT y, sum(p) AS s FROM b GROUP BY y) SELECT y, x, round(p / s, 9) AS template FROM b JOIN s USING (y)")
def kernel_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Each row's profile found again from its kernel of zero sum and the kernel's norm."""
    px = B.pixels(spark, sf).select("y", "x", F.exp("v").alias("p"))
    unit = px.join(px.groupBy("y").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "y").select("y", "x", "n", (C("p") / C("s")).alias("p"))
    norm = unit.groupBy("y").agg(F.sum(F.pow(C("p") - 1 / C("n"), 2)).alias("d"))
    kernel = unit.join(norm, "y").select("y", "x", ((C("p") - 1 / C("n")) / C("d")).alias("k"), F.sqrt("d").alias("norm"))
    return Z.kernel_template(kernel, ["y"]).select("y", "x", F.round("template", 9).alias("template"))


@query("sizes_and_names", f"""{STAR} SELECT id, CAST(greatest(2, floor(0.72 * (1 + id % 9))) AS INTEGER) AS sharp, round((id - 0.5) / 3 + 0.5, 6) AS frame, CAST(ceil(2.5 * greatest(sqrt(pow(4 * cos(radians(id % 180)), 2) + pow(2 * sin(radians(id % 180)), 2)), sqrt(pow(4 * sin(radians(id % 180)), 2) + pow(2 * cos(radians(id % 180)), 2)))) AS INTEGER) AS half,
  lpad(CAST(id % 360 AS VARCHAR), 3, '0') || CASE WHEN id % 181 - 90 >= 0 THEN 'p' ELSE 'm' END || lpad(CAST(abs(id % 181 - 90) AS VARCHAR), 2, '0') || 'x' || lpad(CAST(50 + id % 13 - 6 AS VARCHAR), 2, '0') || 'y' || lpad(CAST(50 + id % 7 - 3 AS VARCHAR), 2, '0') AS name FROM stars""")
def sizes_and_names(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbourhoods, frame positions of nodes, boxes of elliptical profiles and names of sky cells."""
    k = C("id")
    half = Z.box_half_width(F.lit(2.0), F.lit(4.0), (k % 180).cast("double"))
    name = Z.cell_name((k % 360).cast("double"), (k % 181 - 90).cast("double"), k % 7 - 3, k % 13 - 6)
    return B.stars(spark, sf).select("id", Z.sharp_half_width((1 + k % 9).cast("double")).alias("sharp"), F.round(Z.node_to_frame(k, 3), 6).alias("frame"), half.alias("half"), name.alias("name"))


@query("poly_map_slopes", STAR + " SELECT id, round(1.5 + 0.9 * x + 0.01 * x * x + y * (0.2 + 0.003 * x) + y * y * 0.0005, 5) AS value, round(0.2 + 0.003 * x + 0.001 * y, 6) AS by_y, round(0.9 + 0.02 * x + 0.003 * y, 6) AS by_x FROM (SELECT id, x / 64 AS x, (y - field * 128) / 64 AS y FROM stars)")
def poly_map_slopes(spark: SparkSession, sf: str) -> DataFrame:
    """A map's value and its Jacobian."""
    s = B.stars(spark, sf).select("id", ((C("y") - C("field") * B.SIDE) / 64).alias("u"), (C("x") / 64).alias("v"), F.array(F.array(*map(F.lit, (1.5, 0.9, 0.01))), F.array(*map(F.lit, (0.2, 0.003))), F.array(F.lit(0.0005))).alias("k"))
    value, by_u, by_v = poly_with_slopes(C("k"), C("u"), C("v"), 2)
    return step(s, value=value, by_y=by_u, by_x=by_v).select("id", F.round("value", 5).alias("value"), F.round("by_y", 6).alias("by_y"), F.round("by_x", 6).alias("by_x"))
