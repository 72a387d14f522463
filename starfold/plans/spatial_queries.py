"""Queries of the range joins over the star and reference catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial as P
from ..registry import query
from ..shared import shuffled
from ..sources import bindings as B

C = F.col
BOTH = f"WITH RECURSIVE {B.STARS}, {B.REFERENCES}"
D2 = "((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))"


@query("pairs_within", f"{BOTH} SELECT a.id AS i, b.id AS j, round({D2}, 6) AS d2 FROM stars a JOIN stars b ON a.id < b.id AND a.y BETWEEN b.y - 3 AND b.y + 3 AND {D2} <= 9")
def pairs_within(spark: SparkSession, sf: str) -> DataFrame:
    return P.pairs_within(B.stars(spark, sf), 3.0).select("i", "j", F.round("d2", 6).alias("d2"))


@query("cross_pairs", f"{BOTH} SELECT a.id AS a_id, b.id AS b_id, round({D2}, 6) AS d2 FROM stars a JOIN refs b ON {D2} <= 25")
def cross_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.cross_pairs(B.stars(spark, sf), B.references(spark, sf), 5.0).select("a_id", "b_id", F.round("d2", 6).alias("d2"))


@query("nearest_within", f"""{BOTH}, p AS (SELECT b.id, a.id AS other, {D2} AS d2 FROM refs b JOIN stars a ON {D2} <= 6.25),
  m AS (SELECT id, other, d2, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k FROM p)
  SELECT refs.id, coalesce(m.other, 0) AS nearest, coalesce(round(m.d2, 6), -1.0) AS d2 FROM refs LEFT JOIN m ON refs.id = m.id AND m.k = 1""")
def nearest_within(spark: SparkSession, sf: str) -> DataFrame:
    return P.nearest_within(B.references(spark, sf), B.stars(spark, sf), 2.5).select("id", F.coalesce("nearest", F.lit(0).cast("long")).alias("nearest"), F.coalesce(F.round("d2", 6), F.lit(-1.0)).alias("d2"))


@query("dedup_against_catalogs", f"""{BOTH}, c AS (SELECT b.* FROM stars b WHERE NOT EXISTS (SELECT 1 FROM refs a WHERE {D2} <= 9)),
  k AS (SELECT b.* FROM c b WHERE NOT EXISTS (SELECT 1 FROM refs r, (SELECT 2.5 AS s) WHERE ((r.y + s - b.y) * (r.y + s - b.y) + (r.x - s - b.x) * (r.x - s - b.x)) <= 4))
  SELECT (SELECT count(*) FROM stars) AS peaks, (SELECT count(*) FROM stars) - (SELECT count(*) FROM c) AS in_catalog, (SELECT count(*) FROM c) - (SELECT count(*) FROM k) AS in_discards, (SELECT count(*) FROM k) AS kept""")
def dedup_against_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    """New peaks against the catalog, then against the discards, counted apart."""
    new, known = B.stars(spark, sf), B.references(spark, sf)
    discards = known.select("id", (C("y") + 2.5).alias("y"), (C("x") - 2.5).alias("x"))
    first = P.away_from(new, known, 3.0)
    second = P.away_from(first, discards, 2.0)
    each = new.agg(F.count("*").alias("peaks")).select("peaks", F.lit(1).alias("k"))
    for df, name in ((first, "a"), (second, "kept")):
        each = each.join(df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1)), "k")
    return each.select("peaks", (C("peaks") - C("a")).alias("in_catalog"), (C("a") - C("kept")).alias("in_discards"), "kept")


@query("overlap_pairs_capped", f"""{BOTH}, r AS (SELECT id, round_even(y, 0) AS y, round_even(x, 0) AS x FROM stars),
  p AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS k FROM r a JOIN r b ON a.id <> b.id AND abs(a.y - b.y) <= 6 AND abs(a.x - b.x) <= 6)
  SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM p WHERE k <= 8""")
def overlap_pairs_capped(spark: SparkSession, sf: str) -> DataFrame:
    return P.overlap_pairs(B.stars(spark, sf), 3, 8)


GREEDY = """o AS (SELECT id, y, x, row_number() OVER (ORDER BY flux DESC, id) AS k FROM {src}),
  near AS (SELECT a.k AS better, b.k AS worse FROM o a JOIN o b ON a.k < b.k AND a.y BETWEEN b.y - {r} AND b.y + {r} AND ((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) {op} {r}*{r}),
  g AS (SELECT 1 AS k, map_from_entries([(CAST(1 AS BIGINT), true)]) AS state
    UNION ALL SELECT g.k + 1, map_concat(state, map_from_entries([(CAST(g.k + 1 AS BIGINT), NOT coalesce((SELECT bool_or(state[better]) FROM near WHERE worse = g.k + 1), false))])) FROM g WHERE g.k < (SELECT count(*) FROM o))"""


@query("greedy_suppress", f"""{BOTH}, {GREEDY.format(src="refs", r="12.0", op="<=")}, f AS (SELECT state FROM g ORDER BY k DESC LIMIT 1)
  SELECT id FROM o, f WHERE state[k]""")
def greedy_suppress(spark: SparkSession, sf: str) -> DataFrame:
    points = B.references(spark, sf).withColumn("rank", C("flux"))
    return P.greedy_suppress(points, 12.0).select("id")


@query("prune_mask", f"""{BOTH}, bright AS (SELECT * FROM refs WHERE flux / 400 >= 3), {GREEDY.format(src="bright", r="9.0", op="<=")}, f AS (SELECT state FROM g ORDER BY k DESC LIMIT 1)
  SELECT refs.id, coalesce(flux / 400 >= 3 AND EXISTS (SELECT 1 FROM o, f WHERE o.id = refs.id AND state[k]), false) AS keep FROM refs""")
def prune_mask(spark: SparkSession, sf: str) -> DataFrame:
    """A cut on signal to noise, then removal of the weaker of close pairs."""
    all_ = B.references(spark, sf)
    kept = P.greedy_suppress(all_.where(C("flux") / 400 >= 3).withColumn("rank", C("flux")), 9.0)
    return all_.select("id").join(kept.select("id", F.lit(True).alias("k")), "id", "left").select("id", F.coalesce("k", F.lit(False)).alias("keep"))


@query("wing_gate", f"""{BOTH}, n AS (SELECT id, y, x, flux / 10 AS nu FROM refs)
  SELECT b.id, b.nu > 2.0 * coalesce((SELECT max(a.nu * exp(-(pow(round_even(b.y - a.y, 0), 2) + pow(round_even(b.x - a.x, 0), 2)) / 100)) FROM n a WHERE (a.nu > b.nu OR (a.nu = b.nu AND a.id < b.id))
   AND abs(round_even(b.y - a.y, 0)) <= 20 AND abs(round_even(b.x - a.x, 0)) <= 20 AND pow(round_even(b.y - a.y, 0), 2) + pow(round_even(b.x - a.x, 0), 2) > 9), 0.0) AS keep FROM n b""")
def wing_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks above twice what the wings of every brighter peak predict, with a Gaussian template."""
    n = B.references(spark, sf).select("id", "y", "x", (C("flux") / 10).alias("nu"))
    pairs = P.cross_pairs(n, n, 30.0).select("a_id", "b_id").where("a_id <> b_id")
    a, b = (n.select(*[C(c).alias(f"{s}_{c}") for c in ("id", "y", "x", "nu")]) for s in ("a", "b"))
    dy, dx = F.rint(C("b_y") - C("a_y")), F.rint(C("b_x") - C("a_x"))
    brighter = (C("a_nu") > C("b_nu")) | ((C("a_nu") == C("b_nu")) & (C("a_id") < C("b_id")))
    wings = pairs.join(shuffled(a), "a_id").join(shuffled(b), "b_id").where(brighter & (F.abs(dy) <= 20) & (F.abs(dx) <= 20) & (dy * dy + dx * dx > 9))
    pred = wings.groupBy("b_id").agg(F.max(C("a_nu") * F.exp(-(dy * dy + dx * dx) / 100)).alias("pred"))
    return n.join(shuffled(pred), C("id") == C("b_id"), "left").select("id", (C("nu") > 2.0 * F.coalesce("pred", F.lit(0.0))).alias("keep"))


@query("region_contains", f"""{BOTH}, g AS (SELECT * FROM (VALUES (1, 350.0, 10.0, -30.0, 20.0), (2, 10.0, 170.0, -60.0, 0.0), (3, 170.0, 350.0, 0.0, 60.0)) AS t(region, ra0, ra1, dec0, dec1)),
  s AS (SELECT id, (x - 1) / 128 * 360 AS ra, (y - field * 128 - 1) / 128 * 180 - 90 AS dec FROM stars)
  SELECT id, CAST(region AS BIGINT) AS region FROM s JOIN g ON dec >= dec0 AND dec < dec1 AND CASE WHEN ra0 <= ra1 THEN ra >= ra0 AND ra < ra1 ELSE ra >= ra0 OR ra < ra1 END""")
def region_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Sky positions in regions whose right ascension may wrap."""
    regions = spark.createDataFrame([(1, 350.0, 10.0, -30.0, 20.0), (2, 10.0, 170.0, -60.0, 0.0), (3, 170.0, 350.0, 0.0, 60.0)], "region long, ra0 double, ra1 double, dec0 double, dec1 double")
    s = B.stars(spark, sf).select("id", ((C("x") - 1) / 128 * 360).alias("ra"), ((C("y") - C("field") * 128 - 1) / 128 * 180 - 90).alias("dec"))
    around = F.when(C("ra0") <= C("ra1"), (C("ra") >= C("ra0")) & (C("ra") < C("ra1"))).otherwise((C("ra") >= C("ra0")) | (C("ra") < C("ra1")))
    return s.join(F.broadcast(regions), (C("dec") >= C("dec0")) & (C("dec") < C("dec1")) & around).select("id", "region")


@query("merge_tiles_dedup", f"""{BOTH}, t AS (SELECT id, y, x, CAST(floor((y - 0.5) / 32) AS BIGINT) AS tile, least(y - 0.5 - floor((y - 0.5) / 32) * 32, floor((y - 0.5) / 32) * 32 + 32.5 - y + 0.0) AS depth FROM stars),
  l AS (SELECT b.id FROM t a JOIN t b ON a.tile <> b.tile AND {D2} < 1.44 AND (a.depth > b.depth OR (a.depth = b.depth AND a.id < b.id)))
  SELECT id, tile, round(depth, 6) AS depth FROM t WHERE id NOT IN (SELECT id FROM l)""")
def merge_tiles_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogs of neighbouring tiles joined: of cross-tile pairs closer than 1.2 pixels the deeper source stays."""
    tile = F.floor((C("y") - 0.5) / 32)
    t = B.stars(spark, sf).select("id", "y", "x", tile.cast("long").alias("tile"), F.least(C("y") - 0.5 - tile * 32, tile * 32 + 32.5 - C("y")).alias("depth"))
    near = P.pairs_within(t, 1.2).where(C("d2") < 1.44)
    side = lambda s: t.select(C("id").alias(s), C("tile").alias(f"t{s}"), C("depth").alias(f"d{s}"))
    cross = near.join(shuffled(side("i")), "i").join(shuffled(side("j")), "j").where("ti <> tj")
    lost = cross.select(F.when(C("di") >= C("dj"), C("j")).otherwise(C("i")).alias("id")).distinct()
    return t.join(shuffled(lost), "id", "left_anti").select("id", "tile", F.round("depth", 6).alias("depth"))
