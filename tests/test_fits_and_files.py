"""Fits and loops against the truth they were rendered from; readers and streams against small files."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starfold.operators import fit, joint
from starfold.plans import multipass as MP
from starfold.sources import files
from starfold.streaming import exposures


def field(spark, stars, ny=96, nx=96, noise=0.5, seed=1, sky=20.0):
    r = np.random.default_rng(seed)
    y, x = np.indices((ny, nx)) + 1.0
    v = sky + r.normal(0, noise, (ny, nx))
    for sy, sx, flux in stars:
        v += flux * MP.profile(y - sy, x - sx, 3.0)
    return spark.createDataFrame(pd.DataFrame({"y": y.ravel().astype(int), "x": x.ravel().astype(int), "v": v.ravel()}))


def scattered(n, seed=2, apart=7.0):
    r, out = np.random.default_rng(seed), []
    while len(out) < n:
        y, x = r.uniform(8, 88, 2)
        if all(math.hypot(y - a, x - b) > apart for a, b, _ in out):
            out.append((float(y), float(x), float(r.uniform(300, 3000))))
    return out


@pytest.mark.parametrize("model", sorted(fit.MODELS))
def test_noiseless_fits_return_the_truth(model):
    y, x = (a.ravel() + 1.0 for a in np.indices((21, 21)))
    f, names = fit.MODELS[model]
    truth = {"y": 11.3, "x": 10.6, "fwhm": 3.4, "y_fwhm": 3.0, "x_fwhm": 4.2, "theta": 25.0, "flux": 500.0, "bkg": 7.0}
    start = {"y": 11.0, "x": 11.0, "fwhm": 3.0, "y_fwhm": 3.2, "x_fwhm": 3.9, "theta": 15.0, "flux": 420.0, "bkg": 6.0}
    p = np.array([truth[n] for n in names])
    got = fit.least_squares(lambda q: f(q, y, x), f(p, y, x), np.array([start[n] for n in names]))
    np.testing.assert_allclose(got.p, p, rtol=1e-3, atol=1e-3)


def test_reweighting_ignores_outliers():
    y, x = (a.ravel() + 1.0 for a in np.indices((15, 15)))
    p = np.array([8.2, 7.9, 3.0, 800.0, 5.0])
    v = fit.gaussian(p, y, x) + np.random.default_rng(1).normal(0, 0.3, y.size)
    v[::23] += 60
    plain = fit.least_squares(lambda q: fit.gaussian(q, y, x), v, p * 1.02)
    robust = fit.least_squares(lambda q: fit.gaussian(q, y, x), v, p * 1.02, robust=True)
    assert abs(robust.p[3] - 800) < 15 < abs(plain.p[3] - 800)


def test_special_functions():
    t = np.linspace(-5, 5, 41)
    np.testing.assert_allclose(fit.erf(t), [math.erf(a) for a in t], atol=1e-12)
    np.testing.assert_allclose(fit.bessel_j1(np.array([0.0, 1.0, 3.8317059702075125, 10.0])), [0.0, 0.4400505857449335, 0.0, 0.04347274616886144], atol=1e-12)


def test_degenerate_normal_matrix_gives_nan_covariance():
    r = fit.least_squares(lambda p: np.full(5, p[0] + p[1] * 0), np.ones(5), np.array([0.5, 1.0]))
    assert np.isnan(r.cov).all()


@pytest.mark.parametrize("sequential", [False, True])
def test_photometry_loop_recovers_sources(spark, sequential):
    stars = scattered(18)
    out = MP.multipass(field(spark, stars), MP.Options(sequential=sequential, max_passes=2))
    found = out.catalog.toPandas()
    d = np.hypot(np.array([s[0] for s in stars])[:, None] - found["y"].to_numpy(), np.array([s[1] for s in stars])[:, None] - found["x"].to_numpy())
    assert (d.min(1) < 0.2).all() and len(found) <= len(stars) + 1
    flux = found["flux"].to_numpy()[d.argmin(1)]
    np.testing.assert_allclose(flux, [s[2] for s in stars], rtol=0.05)
    assert out.residual.agg(F.stddev_pop("v")).first()[0] < 0.8
    assert out.history[0]["n_new"] >= 15


def test_blank_image_has_no_sources(spark):
    out = MP.multipass(field(spark, [], 40, 40), MP.Options(max_passes=2, detect_sigma=7.0))
    assert out.catalog.count() == 0 and len(out.history) == 1


def test_energy_tables(spark, tmp_path):
    path = tmp_path / "table.txt"
    path.write_text("#a comment\n\n-999.0\t1\t2 120\nF1 0.5 0.8 1.2\nF2 0.4 0.7 1.1\n")
    curve = files.reference_curve(files.read_energy_table(spark, str(path)), "WFC")
    got = sorted((r["filter"], round(r["r"], 6), r["ee"]) for r in curve.collect())
    assert got == [("F1", 1.0, 0.5), ("F1", 2.0, 0.8), ("F1", 110.0, 1.0), ("F2", 1.0, 0.4), ("F2", 2.0, 0.7), ("F2", 110.0, 1.0)]
    with pytest.raises(ValueError):
        files.reference_curve(curve, "NONE")


def test_npy_images(spark, tmp_path):
    a = np.arange(1200.0).reshape(40, 30)
    np.save(tmp_path / "a.npy", a)
    got = files.read_npy(spark, str(tmp_path / "*.npy"), rows=7)
    assert got.count() == 1200
    assert all(r["v"] == a[r["y"] - 1, r["x"] - 1] for r in got.limit(1200).collect())


def test_plan_and_absent_results(spark):
    images = spark.createDataFrame([("a", 50, 30), ("b", 10, 10)], "image string, ny long, nx long")
    plan = files.plan_tiles(images, 20, 3)
    assert plan.count() == 3 * 2 + 1 and plan.select("hash").distinct().count() == 7
    assert files.absent(plan, plan.where("image = 'a'")).select("image").collect()[0]["image"] == "b"


def test_exposure_stream_writes_each_batch_once(spark, tmp_path):
    pixels = field(spark, [(30.0, 40.0, 900.0)], 60, 60).withColumn("exposure", F.lit("e1")).select("exposure", F.col("y").cast("long"), F.col("x").cast("long"), "v")
    pixels.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        exposures.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    peaks = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("significance")).collect()
    assert (peaks[0]["y"], peaks[0]["x"], peaks[0]["exposure"]) == (30, 40, "e1") and len({(p["y"], p["x"]) for p in peaks}) == len(peaks)


def test_missing_columns_become_nan(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "id int, a double"), spark.createDataFrame([(2, 3.0)], "id int, b double")
    rows = {r["id"]: r for r in joint.missing_columns(a, b).collect()}
    assert math.isnan(rows[1]["b"]) and math.isnan(rows[2]["a"])


def test_tabulated_profile_matches_the_stars(spark):
    from starfold.operators import epsf

    stars = scattered(14, seed=5, apart=14.0)
    image = field(spark, stars, noise=0.1)
    given = spark.createDataFrame([(k, y + 0.1, x - 0.1, f * 0.95, 20.0) for k, (y, x, f) in enumerate(stars)], "id long, y double, x double, flux double, bkg double")
    grid, placed = epsf.build(given, image, half=5, rounds=4)
    n = grid.shape[0]
    at = (np.arange(n) - n // 2) / 2
    want = MP.profile(at[:, None], at[None, :], 3.0)
    assert abs(grid - want).max() < 0.1 * want.max()
    for r in placed.collect():
        assert math.hypot(r["y"] - stars[r["id"]][0], r["x"] - stars[r["id"]][1]) < 0.15


def test_grid_tools():
    from starfold.operators import epsf

    y, x = np.indices((15, 15)) - 7.0
    g = np.exp(-((y - 0.3) ** 2 + (x + 0.2) ** 2) / 8)
    holed = g.copy()
    holed[5, 6] = holed[9, 9] = np.nan
    assert abs(epsf.filled(holed) - g).max() < 0.05
    quartic = 1 + y + x * y + y**2 * x**2 / 50
    np.testing.assert_allclose(epsf.smoothed(quartic)[3:-3, 3:-3], quartic[3:-3, 3:-3], atol=1e-9)
    c = epsf.centred(g)
    assert abs((c * y).sum() / c.sum()) < 0.7 * abs((g * y).sum() / g.sum())  # the centre is that of the core, so a move falls short
    np.testing.assert_allclose(epsf.bicubic(g, np.array([3.0, 4.0]), np.array([5.0, 6.0])), [g[3, 5], g[4, 6]])
    assert epsf.exponential_disk_kernel(1.0).sum() == pytest.approx(1) and epsf.pixel_response(4).sum() == pytest.approx(1)


def test_joint_fit_shares_positions(spark):
    from starfold.operators.measure import render
    from starfold.plans import joint_fit

    stars = scattered(10, seed=8)
    src = spark.createDataFrame([(k, y, x, f) for k, (y, x, f) in enumerate(stars)], "id long, y double, x double, flux double")
    images = spark.createDataFrame([("p", "a", 0.0, 0.0, 1.0), ("q", "b", 0.4, -0.3, 1.0)], "image string, band string, oy double, ox double, weight double")
    one = lambda n, dy, dx, s: render(src.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx, "flux": F.col("flux") * s}), 3.0, 8).select(F.lit(n).alias("image"), "y", "x", F.col("model").alias("v"))
    pixels = one("p", 0.0, 0.0, 1.0).unionByName(one("q", 0.4, -0.3, 0.3))
    start = src.withColumns({"y": F.col("y") + 0.2, "x": F.col("x") - 0.2, "flux": F.col("flux") * 0.8})
    found = joint_fit.fit_joint(start, images, pixels)
    rows = {r["id"]: r for r in joint_fit.wide(found, ["a", "b"]).collect()}
    for k, (y, x, f) in enumerate(stars):
        r = rows[k]
        assert (r["y"], r["x"], r["flux_a"], r["flux_b"]) == pytest.approx((y, x, f, 0.3 * f), rel=1e-2, abs=0.05)
    assert joint_fit.significance(found).count() == len(stars)
    with pytest.raises(ValueError):
        joint_fit.wide(found, ["a", "A"])
