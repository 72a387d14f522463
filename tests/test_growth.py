"""Steps whose tasks must not grow with the table or with a frame."""

import threading

import numpy as np
from pyspark.sql import functions as F

from starfold.operators import coadd as K
from starfold.operators import robust as R
from starfold.sources import plan_folder


def test_a_long_frame_is_split_without_lists_of_all_parts(spark):
    ny, nx, cap, overlap = 20_000_000, 1500, 500, 30
    late = threading.Timer(150, spark.sparkContext.cancelAllJobs)
    late.start()
    got = plan_folder.partition_frames(spark.createDataFrame([(ny, nx)], "ny long, nx long"), cap, overlap).first()
    late.cancel()

    def lengths(size, parts):
        k = np.arange(1, parts + 1)
        return np.minimum(size, k * size // parts + overlap) - np.maximum(1, (k - 1) * size // parts + 1 - overlap) + 1

    found = []
    for m in range(1, 40):
        wide = lengths(nx, m)
        n = ny // max(1, cap * cap // wide.max() - 2 * overlap)
        n = next(k for k in range(max(1, n - 3), n + 1000) if lengths(ny, k).max() * wide.max() <= cap * cap)
        found.append((n * m, lengths(ny, n).sum() * wide.sum(), n, m))
    assert (got["n"], got["m"]) == min(found)[2:]


def test_longest_and_total_parts_hold_for_every_split(spark):
    cases = [(s, q) for s in (1, 2, 7, 59, 64, 130, 131, 200) for q in (1, 90, 333)]
    for cap, overlap in ((61, 30), (40, 0), (30, 7), (20, 1)):
        got = plan_folder.partition_frames(spark.createDataFrame(cases, "ny long, nx long"), cap, overlap).collect()
        assert len(got) == len(cases)
        lengths = lambda n, parts: [min(n, k * n // parts + overlap) - max(1, (k - 1) * n // parts + 1 - overlap) + 1 for k in range(1, parts + 1)]  # noqa: B023, E731
        for r in got:
            side = lambda size: [(max(a), sum(a)) for a in (lengths(size, k) for k in range(1, min(size, 400) + 1))]
            h, w = side(r["ny"]), side(r["nx"])
            fits = [((i + 1) * (j + 1), a[1] * b[1], i + 1, j + 1) for i, a in enumerate(h) for j, b in enumerate(w) if a[0] * b[0] <= cap * cap]
            assert (r["n"], r["m"]) == min(fits)[2:], (r, cap, overlap)


def test_rounds_of_the_scale_read_rows_made_once(spark, monkeypatch):
    plans, keep = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name="table": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    cells = spark.range(3000).select((F.col("id") % 7).alias("cell"), F.sin("id").alias("v"))
    centred = cells.join(R.medians(cells, ["cell"], "v"), "cell").select("cell", (F.col("v") - F.col("m")).alias("v"))
    assert R.m_scale(centred, ["cell"], "v").count() == 7
    rounds = [p for name, p in plans if name == "m-scale"][1:]
    assert rounds and not any("percentile" in p or "Range" in p for p in rounds)


def test_drops_of_one_image_are_several_tasks(spark):
    pixels = spark.range(64 * 64).coalesce(1).select(F.expr("id div 100000").alias("image"), (F.expr("id div 64") + 1).alias("y"), (F.col("id") % 64 + 1).alias("x"), F.lit(1.0).alias("w"))
    images = spark.createDataFrame([(0, 0, 1.0, [[0.0, 100.0], [0.0]], [[0.0, 0.0], [100.0]], 0.0, 0.0, 100.0)], "image long, band long, flux_scale double, my array<array<double>>, mx array<array<double>>, r0 double, c0 double, extent double")
    drops = K.placed_nodes(pixels, images).withColumn("p", F.spark_partition_id())
    area, tasks = drops.agg(F.sum("a"), F.count_distinct("p")).first()
    assert abs(area - 64 * 64) < 1e-6 and tasks > 1
