"""Stencils on images of several tiles against numpy, and the limits of keys and folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold import shared
from starfold.functions import scalar
from starfold.operators import stencil
from starfold.sources import bindings


def table(spark, image, **more):
    y, x = np.indices(image.shape)
    columns = {"y": y.ravel() + 1, "x": x.ravel() + 1, "v": image.ravel(), **{k: v.ravel() for k, v in more.items()}}
    return spark.createDataFrame([tuple(c[k].item() for c in columns.values()) for k in range(image.size)], ", ".join(f"{n} {'double' if n not in 'yx' else 'long'}" for n in columns))


def array(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", column).collect():
        assert np.isnan(out[r["y"] - 1, r["x"] - 1])
        out[r["y"] - 1, r["x"] - 1] = r[column]
    return out


def plain(image, kernel, border):
    h = kernel.shape[0] // 2
    p = np.pad(image, h, mode="edge" if border == "replicate" else "constant")
    return sum(kernel[i, j] * p[i : i + image.shape[0], j : j + image.shape[1]] for i in range(2 * h + 1) for j in range(2 * h + 1))


@pytest.mark.parametrize("shape", [(150, 70), (64, 65), (3, 130)])
@pytest.mark.parametrize("border", ["replicate", "zero"])
def test_correlation_crosses_tiles(spark, shape, border):
    r = np.random.default_rng(1)
    image, kernel = r.normal(size=shape), r.normal(size=(5, 5))
    got = array(stencil.correlate(table(spark, image), kernel, border=border), "c", shape)
    np.testing.assert_allclose(got, plain(image, kernel, border), atol=1e-9)


def test_other_stencils_cross_tiles(spark):
    r = np.random.default_rng(2)
    image, weight = r.normal(size=(140, 70)), r.uniform(size=(140, 70))
    weight[r.uniform(size=weight.shape) < 0.1] = 0
    df = table(spark, image, w=weight)
    u, w = r.normal(size=5), r.normal(size=3)
    np.testing.assert_allclose(array(stencil.correlate_separable(df, u, w), "c", image.shape), plain(image, np.outer(u, np.pad(w, 1)), "replicate"), atol=1e-9)
    k, _ = stencil.zero_sum(stencil.gaussian_kernel(5, 1.2))
    found = stencil.matched_filter(df, stencil.gaussian_kernel(5, 1.2), "w")
    np.testing.assert_allclose(array(found, "smoothed", image.shape), plain(np.where(weight > 0, weight * image, 0), k, "replicate"), atol=1e-9)
    np.testing.assert_allclose(array(found, "den", image.shape), plain(weight, k * k, "replicate"), atol=1e-9)
    p = np.pad(image, 1, constant_values=np.inf)
    peaks = np.all([image > p[i : i + 140, j : j + 70] for i in range(3) for j in range(3) if (i, j) != (1, 1)], axis=0)
    got = {(x["y"], x["x"]) for x in stencil.local_maxima(df).collect()}
    assert got == {(int(y) + 1, int(x) + 1) for y, x in zip(*np.nonzero(peaks), strict=True)}


def test_no_window_holds_a_whole_line(spark):
    plan = stencil.correlate(table(spark, np.zeros((3, 3))), np.ones((3, 3)))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_ty" in line and "_tx" in line for line in windows)
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_keys_do_not_overflow(spark):
    keys = [1, 800_000, 2**40, 2**62]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", bindings.hashed(F.col("k"), 15485863, 32452843, 30011).alias("x")).collect()
    for r in rows:
        assert r["x"] == 1 + ((r["k"] ** 2 * 15485863 + r["k"] * 32452843) % 30011) / 30011 * 128


def test_two_variable_least_squares_against_a_grid(spark):
    r = np.random.default_rng(3)
    cases = []
    for _ in range(60):
        a, y = r.normal(size=(6, 2)), r.normal(size=6)
        if len(cases) % 5 == 0:
            a[:, 1] = a[:, 0] * r.uniform(0.5, 2)  # collinear
        if len(cases) % 7 == 0:
            a[:, 0] = 0
        cases.append((a, y))
    sums = [tuple(map(float, (a[:, 0] @ a[:, 0], a[:, 0] @ a[:, 1], a[:, 1] @ a[:, 1], a[:, 0] @ y, a[:, 1] @ y, y @ y))) for a, y in cases]
    df = spark.createDataFrame([(k, *s) for k, s in enumerate(sums)], "k long, uu double, uv double, vv double, uy double, vy double, yy double")
    u, v, res = scalar.nnls2(*[F.col(c) for c in ("uu", "uv", "vv", "uy", "vy", "yy")])
    for row in df.select("k", u.alias("u"), v.alias("v"), res.alias("res")).collect():
        a, y = cases[row["k"]]
        assert row["u"] >= 0 and row["v"] >= 0
        assert row["res"] == pytest.approx(((y - a @ [row["u"], row["v"]]) ** 2).sum(), abs=1e-8)
        tried = [((y - a @ np.array([p, q])) ** 2).sum() for p in np.linspace(0, 3, 61) for q in np.linspace(0, 3, 61)]
        assert row["res"] <= min(tried) + 1e-9


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, other: other)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
