"""Maps, partitions and header cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maps as L
from ..registry import query
from ..sources import bindings as B
from ..sources import plan_folder as P

C = F.col


@query("fit_maps", """WITH k AS (SELECT n_nationkey AS image, n_nationkey + 0.5 AS a FROM nation), p AS (SELECT unnest(range(0, 6)) AS i, unnest(range(0, 6)) AS j), ij AS (SELECT x.i, y.j FROM p x, p y WHERE x.i + y.j <= 5)
  SELECT image, CAST(5 AS INTEGER) AS degree, i, j, round(CASE WHEN i = 0 AND j = 0 THEN 100 + a WHEN i = 1 AND j = 0 THEN 50 WHEN i = 0 AND j = 2 THEN a / 10 WHEN i = 3 AND j = 1 THEN 0.02 * a ELSE 0 END, 5) + 0.0 AS cy,
    round(CASE WHEN i = 0 AND j = 0 THEN 80 - a WHEN i = 0 AND j = 1 THEN 40 + a WHEN i = 1 AND j = 1 THEN 0.5 WHEN i = 0 AND j = 5 THEN 0.001 * a ELSE 0 END, 5) + 0.0 AS cx FROM k, ij""")
def fit_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of 25 images whose positions are exact polynomials, found again from lattices."""
    images = B.read(spark, sf, "nation").select(C("n_nationkey").cast("long").alias("image"), F.lit(11).alias("ny"), F.lit(11).alias("nx"))
    u, v, a = (C("y") - 6) / 5, (C("x") - 6) / 5, C("image") + 0.5
    at = L.lattice(images, 21, 0.0).select("image", "check", u.alias("u"), v.alias("v"))
    at = at.select("*", (100 + a + 50 * C("u") + a / 10 * C("v") * C("v") + 0.02 * a * C("u") * C("u") * C("u") * C("v")).alias("y"), (80 - a + (40 + a) * C("v") + 0.5 * C("u") * C("v") + 0.001 * a * F.pow("v", F.lit(5))).alias("x"))
    found = L.fit_maps(at)
    rows = found.select("image", "degree", F.posexplode(F.arrays_zip("my", "mx")).alias("i", "r")).select("image", "degree", "i", F.posexplode(F.arrays_zip("r.my", "r.mx")).alias("j", "c"))
    return rows.select("image", "degree", C("i").cast("long").alias("i"), C("j").cast("long").alias("j"), (F.round("c.my", 5) + 0.0).alias("cy"), (F.round("c.mx", 5) + 0.0).alias("cx"))


@query("tile_partition", """WITH f AS (SELECT label AS frame, count(*) * 40 + label * 17 AS ny, 900 + label * 211 AS nx FROM embeddings GROUP BY label), b AS (SELECT *, CAST(ceil(ny / 440) * ceil(nx / 440) AS BIGINT) AS most FROM f),
  n AS (SELECT *, unnest(range(1, most + 1)) AS n FROM b), s AS (SELECT *, unnest(range(1, most // n + 1)) AS m FROM n),
  p AS (SELECT *, list_transform(range(1, n + 1), lambda k: least(k * ny // n + 30, ny) - greatest((k - 1) * ny // n + 1 - 30, 1) + 1) AS h, list_transform(range(1, m + 1), lambda k: least(k * nx // m + 30, nx) - greatest((k - 1) * nx // m + 1 - 30, 1) + 1) AS w FROM s)
  SELECT CAST(frame AS BIGINT) AS frame, CAST(ny AS BIGINT) AS ny, CAST(nx AS BIGINT) AS nx, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m FROM p WHERE list_max(h) * list_max(w) <= 250000 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY n * m, list_sum(h) * list_sum(w), n, m) = 1""")
def tile_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Ten frames split into the fewest tiles of at most 500 x 500 padded pixels."""
    frames = B.read(spark, sf, "embeddings").groupBy(C("label").cast("long").alias("frame")).agg((F.count("*") * 40 + F.first("label") * 17).alias("ny"), (900 + F.first("label").cast("long") * 211).alias("nx"))
    return P.partition_frames(frames, 500, 30)
