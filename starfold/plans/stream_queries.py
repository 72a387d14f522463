"""Queries of the streaming windows, the readers and the tile plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import bindings as B
from ..sources import files
from ..streaming import windows as W

C = F.col


@query("stream_tumbling_hours", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_hours(spark: SparkSession, sf: str) -> DataFrame:
    return W.drain(W.tumbling(W.events(spark, sf), "1 hour"), "tumbling").withColumn("total", F.round("total", 4))


@query("stream_sliding_windows", """SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * CAST(k AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(max(value), 6) AS most
  FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1""")
def stream_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return W.drain(W.sliding(W.events(spark, sf), "1 hour", "30 minutes"), "sliding").withColumn("most", F.round("most", 6))


@query("session_windows", """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return W.sessions(B.read(spark, sf, "events"), "1 day")


#: A few rows of public encircled-energy tables (radii in pixels, the last table's in arcsec).
ENERGY = {
    "WFC": ["# hot stars", "", "-999.0 1 2 3 4 5 6 7 8 9 10 20 40", "F435W 0.330 0.663 0.792 0.839 0.863 0.877 0.887 0.895 0.902 0.907 0.941 0.979", "F606W 0.328 0.661 0.795 0.839 0.866 0.885 0.896 0.904 0.910 0.916 0.947 0.975"],
    "SBC": ["# radii in arcsec", "-999.0 0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8 0.9 1.0 2.0 3.0 4.0 5.0 5.5", "F125LP 0.489 0.624 0.696 0.755 0.804 0.844 0.873 0.894 0.909 0.922 0.972 0.991 1.000 1.007 1.010"],
}


def _energy_sql() -> str:
    parts = []
    for name, lines in ENERGY.items():
        scale, infinite, arcsec = files.INSTRUMENTS[name]
        rows = [x.split() for x in lines if x and x[0] != "#"]
        for f, *ee in rows[1:]:
            for r, e in zip(rows[0][1:], ee, strict=True):
                parts.append(f"('{name}', '{f}', {r}::DOUBLE {f'/ {scale}' if arcsec else ''}, {e}::DOUBLE, {infinite / scale}::DOUBLE)")
    return f"""WITH t AS (SELECT * FROM (VALUES {', '.join(parts)}) AS t(instrument, filter, r, ee, r_end)), k AS (SELECT * FROM t WHERE r <= r_end)
  SELECT instrument, filter, round(r, 6) AS r, ee FROM k UNION ALL SELECT instrument, filter, round(any_value(r_end), 6), 1.0 FROM k GROUP BY instrument, filter HAVING max(r) < any_value(r_end)"""


@query("reference_cog", _energy_sql())
def reference_cog(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, lines in ENERGY.items():
        table = files.parse_energy_table(spark.createDataFrame([(x,) for x in lines], "value string"))
        one = files.reference_curve(table, name).select(F.lit(name).alias("instrument"), "filter", F.round("r", 6).alias("r"), "ee")
        out = one if out is None else out.unionByName(one)
    return out


@query("tile_plan", """WITH i AS (SELECT 'band' || label AS image, count(*) AS ny, 64::BIGINT AS nx FROM embeddings GROUP BY label), t AS (SELECT image, ny, nx, ty, tx FROM i, (SELECT unnest(range(0, 1000)) AS ty), (SELECT unnest(range(0, 3)) AS tx) WHERE ty <= (ny - 1) // 24 AND tx <= (nx - 1) // 24),
  b AS (SELECT image, ty * 24 + 1 AS r0, least(ty * 24 + 24, ny) AS r1, tx * 24 + 1 AS c0, least(tx * 24 + 24, nx) AS c1, ny FROM t), p AS (SELECT *, greatest(1, r0 - 4) AS p0, least(r1 + 4, ny) AS p1 FROM b)
  SELECT image, r0, r1, c0, c1, p0, p1, sha256(concat_ws('|', image, r0, r1, c0, c1, p0, p1)) AS hash FROM p""")
def tile_plan(spark: SparkSession, sf: str) -> DataFrame:
    images = B.read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("ny")).select(F.concat(F.lit("band"), C("label").cast("string")).alias("image"), "ny", F.lit(64).cast("long").alias("nx"))
    return files.plan_tiles(images, 24, 4).select("image", "r0", "r1", "c0", "c1", "p0", "p1", "hash")
