"""Operators against brute force and closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import measure as M
from starfold.operators import robust as R
from starfold.operators import spatial as P
from starfold.operators import stencil as T
from starfold.plans import scalar_queries


def test_quantiles_of_large_groups_are_exact(spark):
    r = random.Random(2)
    rows = [(k, v) for k in range(3) for v in [float(r.choice([1, 2, 3])) if k == 2 else r.gauss(0, 10) for _ in range(400 + k)]]
    df = spark.createDataFrame(rows + [(0, float("nan")), (1, None)], "k int, v double")
    for q in (0.0, 0.5, 0.93, 1.0):
        got = {r["k"]: r["q"] for r in R.quantiles(df, ["k"], "v", q, limit=50, bins=8).collect()}
        for k in range(3):
            assert got[k] == pytest.approx(np.quantile([v for a, v in rows if a == k], q), abs=1e-12)


def test_clipping_bounds_match_numpy(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(0, 1, 500), [40, -35, 28, 15]])
    df = spark.createDataFrame([(1, float(x)) for x in v] + [(2, 5.0), (2, 5.0)], "k int, v double")
    kept = R.clipped(df, ["k"], "v").groupBy("k").count().collect()
    assert {x["k"]: x["count"] for x in kept} == {1: len(R.clip_array(v)), 2: 2}


def points(spark, n=150, seed=4):
    r = random.Random(seed)
    rows = [(i, r.uniform(0, 40), r.uniform(0, 40), r.choice([1.0, 2.0, 3.0])) for i in range(n)]
    rows += [(n, 5.0, 5.0, 1.0), (n + 1, 5.0, 5.0, 1.0), (n + 2, 10.0, 10.0, 1.0), (n + 3, 10.0, 13.0, 1.0), (n + 4, float("nan"), 1.0, 9.0), (n + 5, float("inf"), 1.0, 9.0)]
    return rows, spark.createDataFrame(rows, "id int, y double, x double, rank double")


def test_pairs_match_brute_force(spark):
    rows, df = points(spark)
    got = {(r["i"], r["j"]) for r in P.pairs_within(df, 3.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 9.0}
    assert got == want


@pytest.mark.parametrize("strict", [False, True])
def test_greedy_suppression_equals_the_sequential_visit(spark, strict):
    rows, df = points(spark)
    kept = []
    for a in sorted(rows, key=lambda r: (-r[3], r[0])):
        d = [(a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 for b in kept]
        if not any(x < 9.0 or (x == 9.0 and not strict) for x in d):
            kept.append(a)
    assert {r["id"] for r in P.greedy_suppress(df, 3.0, strict).collect()} == {a[0] for a in kept}


def test_exact_overlap(spark):
    rows = [(dy, dx, r) for dy in np.linspace(-3, 3, 13) for dx in np.linspace(-3, 3, 13) for r in (0.3, 1.7, 2.5)]
    df = spark.createDataFrame([tuple(map(float, x)) for x in rows], "dy double, dx double, r double")
    got = df.withColumn("w", M.exact_overlap(F.col("dy"), F.col("dx"), F.col("r"))).collect()
    fine = (np.arange(400) + 0.5) / 400 - 0.5
    for row in got[::7]:
        inside = (row["dy"] + fine[:, None]) ** 2 + (row["dx"] + fine[None, :]) ** 2 < row["r"] ** 2
        assert row["w"] == pytest.approx(inside.mean(), abs=2e-3)
    offsets = [(float(y), float(x)) for y in range(-6, 7) for x in range(-6, 7)]
    total = spark.createDataFrame(offsets, "dy double, dx double").select(F.sum(M.exact_overlap(F.col("dy") - 0.3, F.col("dx") + 0.2, F.lit(4.2)))).first()[0]
    assert total == pytest.approx(math.pi * 4.2**2, rel=1e-9)


def test_median_filter_repeats_edges(spark):
    v = np.arange(12.0).reshape(3, 4) ** 2 % 17
    df = spark.createDataFrame([(i + 1, j + 1, float(v[i, j])) for i in range(3) for j in range(4)], "y int, x int, v double")
    got = {(r["y"], r["x"]): r["m"] for r in T.median_filter(df, 1).collect()}
    wide = np.pad(v, 1, mode="edge")
    for i in range(3):
        for j in range(4):
            assert got[i + 1, j + 1] == np.median(wide[i : i + 3, j : j + 3])


def test_plateaus_are_no_maxima(spark):
    df = spark.createDataFrame([(y, x, 1.0) for y in range(1, 5) for x in range(1, 5)], "y int, x int, v double")
    assert T.local_maxima(df, edges=True).count() == 0


def test_rank_one_kernels_factor():
    k = T.gaussian_kernel(5, 1.2)
    column, row = T.factored(k)
    np.testing.assert_allclose(np.outer(column, row), k, atol=1e-12)
    assert T.factored(k + np.eye(5)) is None


def test_quadratic_centroid_of_a_symmetric_peak(spark):
    nb = [[0.1, 0.3, 0.1], [0.3, 1.0, 0.3], [0.1, 0.3, 0.1]]
    df = spark.createDataFrame([(nb,)], "nb array<array<double>>")
    c = M.quadratic_centroid("nb", F.lit(2.0), F.lit(2.0))
    r = df.select(*[v.alias(k) for k, v in c.items()]).first()
    assert (r["yc"], r["xc"], r["com_y"], r["com_x"]) == pytest.approx((2, 2, 2, 2))


def test_growth_curve_area_is_geometric(spark):
    image = spark.createDataFrame([(y, x, 2.0) for y in range(1, 21) for x in range(1, 21)], "y long, x long, v double")
    source = spark.createDataFrame([(1, 10.0, 10.0, 1.0)], "id int, y double, x double, flux double")
    r = M.curve_of_growth(source, image, [2.0, 4.0], "exact").orderBy("r").collect()
    assert [x["area"] for x in r] == pytest.approx([math.pi * 4, math.pi * 16], rel=1e-9)
    assert [x["flux"] for x in r] == pytest.approx([2 * math.pi * 4, 2 * math.pi * 16], rel=1e-9)
    with pytest.raises(ValueError):
        M.curve_of_growth(source, image, [2.0, 2.0])


def test_unknown_flags_are_refused():
    with pytest.raises(ValueError):
        scalar_queries.flag_mask(["NO_SUCH_FLAG"])
