"""Robust statistics of groups whatever their size, and filled meshes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import joint, robust


@pytest.fixture(scope="module")
def cells(spark):
    r = np.random.default_rng(1)
    rows = [(int(k % 7 if k % 3 else 0), float(v)) for k, v in enumerate(np.concatenate([r.normal(size=2000), 8 * r.normal(size=200)]))]
    return spark.createDataFrame([*rows, (9, 1.0), (9, float("nan")), (9, None), (8, 2.0), (8, 2.0)], "cell long, v double"), rows


@pytest.mark.parametrize("whole", [1_000_000, 50])
def test_clipping_is_the_same_for_groups_of_any_size(spark, monkeypatch, cells, whole):
    df, rows = cells
    monkeypatch.setattr(robust, "WHOLE", whole)
    got = {r["cell"]: (r["lo"], r["hi"]) for r in robust.clip_bounds(df, ["cell"], "v", 2.0, 2.5).collect()}
    kept = {r["cell"]: r["n"] for r in robust.clipped(df, ["cell"], "v", low=2.0, high=2.5).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    for k in range(7):
        a = robust.clip_array(np.array([v for c, v in rows if c == k]), 2.0, 2.5)
        assert kept[k] == len(a) and got[k][0] <= a[0] and got[k][1] >= a[-1]
    assert kept[8] == 2 and kept[9] == 1


@pytest.mark.parametrize("whole", [1_000_000, 50])
def test_medians_and_scales(spark, monkeypatch, cells, whole):
    df, rows = cells
    monkeypatch.setattr(robust, "WHOLE", whole)
    got = {r["cell"]: r for r in robust.about_median(df, ["cell"], "v").groupBy("cell").agg(F.first("m").alias("m"), F.first("s").alias("s")).collect()}
    for k in range(7):
        a = np.array([v for c, v in rows if c == k])
        assert got[k]["m"] == pytest.approx(np.median(a)) and got[k]["s"] == pytest.approx(np.median(abs(a - np.median(a))))
    assert robust.overall(df, "v", 0.3) == pytest.approx(np.quantile([v for _, v in rows] + [1.0, 2.0, 2.0], 0.3))


def test_one_group_of_millions(spark):
    df = spark.range(3_000_000).select(F.lit(0).alias("g"), ((F.col("id") * 7919) % 3_000_017).cast("double").alias("v"))
    assert robust.medians(df, ["g"], "v").first()["m"] == df.agg(F.percentile("v", F.lit(0.5))).first()[0]


def test_filled_meshes_match_the_plain_loop(spark):
    r = np.random.default_rng(5)
    for share in (0.1, 0.6, 0.95):
        grid = r.normal(size=(9, 13))
        grid[r.uniform(size=grid.shape) < share] = np.nan
        want, changed = grid.copy(), True
        while changed:
            changed = False
            for i in range(9):
                for j in range(13):
                    near = [want[min(max(i + a, 0), 8), min(max(j + b, 0), 12)] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
                    near = [v for v in near if not np.isnan(v)]
                    if np.isnan(want[i, j]) and near:
                        want[i, j], changed = sum(near) / len(near), True
        rows = [(int(i), int(j), float(grid[i, j])) for i, j in np.ndindex(*grid.shape) if not (np.isnan(grid[i, j]) and (i + j) % 2)]  # some boxes are absent
        got = {(x["mi"], x["mj"]): x["bkg"] for x in robust.fill_mesh(spark.createDataFrame(rows, "mi long, mj long, bkg double"), ("bkg",)).collect()}
        assert all(v == pytest.approx(want[k]) for k, v in got.items()) and len(got) >= len(rows)
    assert (robust.filled(np.full((2, 3), np.nan)) == 0).all()


def test_worst_first_keeps_to_its_share(spark):
    for scores in ([float(k) for k in range(20)], [5.0] * 10 + [9.0] * 10, [0.0] * 20):
        df = spark.createDataFrame(list(enumerate(scores)), "id long, score double")
        for share in (0.0, 0.1, 0.35, 1.0):
            worst = sorted((k for k, v in enumerate(scores) if v > 4), key=lambda k: (-scores[k], k))[: int(np.ceil(share * 20))]
            assert {r["id"] for r in joint.worst_first(df, "score", share, 4.0).collect()} == set(range(20)) - set(worst)


def test_quantiles_of_large_groups_for_any_values(spark):
    values = [
        [2.0 ** (-k / 2) for k in range(2001)],  # powers
        [s * 2.0**k for k in range(-300, 300, 7) for s in (-1, 1)] + [0.0, -0.0, 5e-324],  # signs
        [1.0] * 300 + [1.0 + 2**-52] * 300 + [-7.0],  # ties
        [-1.7e308, 1.7e308, 1e308, -1e308, 0.5, 0.25, 3.0],  # huge
    ]
    df = spark.createDataFrame([(k, float(v)) for k, vs in enumerate(values) for v in vs], "k int, v double").coalesce(2)
    for q in (0.1, 0.5):
        whole, narrowed = ({r["k"]: r["q"] for r in robust.quantiles(df, ["k"], "v", q, limit=limit, bins=64).collect()} for limit in (10**6, 3))
        assert whole == narrowed


def test_backgrounds_without_a_box_are_refused_and_coverage_gets_its_value(spark):
    from starfold.operators.background import background2d

    px = spark.createDataFrame([(y, x, 7.0 if y > 8 else float("nan"), x > 30) for y in range(1, 33) for x in range(1, 33)], "y long, x long, v double, outside boolean")
    got = background2d(px, 8, fill_value=-3.0).toPandas()
    assert len(got) == 32 * 32 and np.allclose(got.loc[got["x"] <= 30, "background"], 7.0) and (got.loc[got["x"] > 30, ["background", "rms"]] == -3.0).all().all()
    with pytest.raises(ValueError, match="excluded"):
        background2d(px.withColumn("masked", F.lit(True)), 8)
