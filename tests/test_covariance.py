"""The background's covariance: sums against brute force, the fit on drawn fields, errors against a Monte Carlo."""

import math

import numpy as np
from pyspark.sql import functions as F

from starfold.operators import covariance as V
from starfold.operators.sparse_fit import gaussian_profile


def as_pixels(spark, r, valid=None, iv=400.0):
    rows = [(y + 1, x + 1, float(r[y, x]), iv, bool(valid is None or valid[y, x])) for y in range(r.shape[0]) for x in range(r.shape[1])]
    return spark.createDataFrame(rows, "y long, x long, r double, iv double, valid boolean")


def test_lag_sums_of_cells_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    r, valid = rng.normal(size=(150, 21)), rng.random((150, 21)) > 0.2
    r[3, 4] = np.nan
    got = {(x["ci"], x["cj"], x["dy"], x["dx"]): x for x in V.lag_sums(as_pixels(spark, r, valid), 8, 3).collect()}
    good = valid & np.isfinite(r)
    for ci in (0, 15, 18):
        for cj in (0, 2):
            for dy, dx in V.fitted_lags(3):
                pairs = [(r[y, x], r[y + dy, x + dx]) for y in range(ci * 8, min(ci * 8 + 8, 150)) for x in range(cj * 8, min(cj * 8 + 8, 21)) if good[y, x] and 0 <= y + dy < 150 and 0 <= x + dx < 21 and good[y + dy, x + dx]]
                row = got[(ci, cj, dy, dx)]
                want = [sum(a * b for a, b in pairs), sum(a for a, _ in pairs), sum(b for _, b in pairs), len(pairs)]
                np.testing.assert_allclose([row[c] for c in ("s", "a1", "a2", "np")], want, atol=1e-9)
    assert sum(x["nv"] for k, x in got.items() if k[2:] == (0, 0)) == good.sum()


def field(rng, n, b, ell):
    """A stationary field with covariance b exp(-d^2 / 2 ell^2): white noise smoothed by a Gaussian of ell / sqrt 2."""
    s = ell / math.sqrt(2)
    d = np.arange(-4 * int(ell + 1), 4 * int(ell + 1) + 1)
    k = np.exp(-(d**2) / (2 * s * s))
    k /= math.sqrt((k**2).sum())
    a = rng.normal(size=(n + len(d) - 1, n + len(d) - 1))
    a = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, a)
    return math.sqrt(b) * np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, a)


def test_the_fit_recovers_smooth_structure_and_the_step_its_errors(spark):
    rng = np.random.default_rng(7)
    b, ell, noise, fwhm, flux = 0.04, 6.0, 0.05, 3.0, 40.0
    fits = V.cell_covariances(as_pixels(spark, field(rng, 128, b, ell) + rng.normal(0, noise, (128, 128)), iv=1 / noise**2), 32, 6, V.gaussian_acf(fwhm), half_width=130.0, lengths=[3.0, 6.0, 12.0]).toPandas()
    total = (fits["a"] + fits["b"]).median()
    assert 0.5 * b < total < 1.6 * b and (fits["ell"] >= 3.0).all() and len(fits) == 16
    # sources on drawn backgrounds: the step's scatter against the variance that it reports
    profile = gaussian_profile(fwhm)
    sources, pixels = [], []
    for k in range(400):
        image = field(rng, 11, b, ell) + rng.normal(0, noise, (11, 11))
        for y in range(11):
            for x in range(11):
                pixels.append((y + 1 + 20 * k, x + 1, float(image[y, x]), 1 / noise**2))
        sources.append((k, 6.0 + 20 * k, 6.0, flux, 0.0, b, ell))
    got = V.correlated_steps(spark.createDataFrame(sources, "id long, y double, x double, flux double, a double, b double, ell double"), spark.createDataFrame(pixels, "y long, x long, v double, iv double"), fwhm, 5).toPandas()
    dy, dx = (a.ravel().astype(float) for a in np.mgrid[-5:6, -5:6])
    g, gy, gx = profile(dy, dx)
    plain = np.linalg.inv(np.stack([flux * gy, flux * gx, g]) @ np.stack([flux * gy, flux * gx, g]).T) * noise**2
    for name, value, k in (("flux_var", got["flux"] - flux, 2), ("x_var", got["x"] - 6.0, 1)):
        ratio = value.std() / math.sqrt(plain[k, k] + got[name].iloc[0])
        assert 0.9 < ratio < 1.1, (name, ratio)
        assert value.std() > 1.1 * math.sqrt(plain[k, k])  # without the step the errors are too small


def test_sources_beyond_the_mesh_take_its_edge_and_bad_systems_stay(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, 0.0, 1.0), (1, 0, 2.0, 0.0, 1.0)], "ci long, cj long, a double, b double, ell double")
    at = V.cell_of(spark.createDataFrame([(1, -5.0, 3.0), (2, 99.0, 99.0), (3, 9.0, 1.0)], "id long, y double, x double"), cells, 8)
    assert {r["id"]: r["a"] for r in at.collect()} == {1: 1.0, 2: 2.0, 3: 2.0}
    image = spark.createDataFrame([(y, x, 1.0, 1.0) for y in range(1, 8) for x in range(1, 8)], "y long, x long, v double, iv double")
    bad = spark.createDataFrame([(1, 4.0, 4.0, 0.0, 0.0, 0.0, 1.0), (2, 4.0, 4.0, 5.0, -9.0, 0.0, 1.0)], "id long, y double, x double, flux double, a double, b double, ell double")
    got = V.correlated_steps(bad, image, 3.0, 3).select("y", "x", F.col("flux_var").alias("v")).collect()
    assert all((r["y"], r["x"], r["v"]) == (4.0, 4.0, 0.0) for r in got)
