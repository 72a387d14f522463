"""The loop's tiles: fits in turn against least squares with differences, peaks against the filter and maxima of whole images."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starfold.operators import fit
from starfold.operators import stencil as T
from starfold.plans import multipass as MP

from .test_fits_and_files import field, scattered

O = MP.Options(sequential=True)  # noqa: E741


def in_turn(y, x, flux, pixels):
    """Each source by ``least_squares`` with differences, over all pixels of the tile."""
    py, px, rest = (pixels[c].to_numpy(float).copy() for c in ("py", "px", "v"))
    light = lambda y, x, flux, at=slice(None): flux * MP.profile(py[at] - y, px[at] - x, O.fwhm)
    for k in range(len(y)):
        rest -= light(y[k], x[k], flux[k])
    err = np.full(len(y), math.nan)
    for k in np.argsort(-flux, kind="stable"):
        near = (abs(py - y[k]) <= 4.5) & (abs(px - x[k]) <= 4.5)
        if near.sum() < 8:
            continue
        own = rest[near] + light(y[k], x[k], flux[k], near)
        model = lambda p: fit.gaussian(np.array([p[0], p[1], O.fwhm, p[2], p[3]]), py[near], px[near])  # noqa: B023, E731
        r = fit.least_squares(model, own, np.array([y[k], x[k], flux[k], 0.0]), np.full(len(own), 1 / O.error**2), rounds=8)
        if not np.isfinite(r.p).all() or math.hypot(r.p[0] - y[k], r.p[1] - x[k]) > 1.0:
            continue
        rest += light(y[k], x[k], flux[k]) - light(r.p[0], r.p[1], r.p[2])
        y[k], x[k], flux[k], err[k] = r.p[0], r.p[1], r.p[2], math.sqrt(max(r.cov[2, 2], 0))
    return y, x, flux, err


@pytest.mark.parametrize("share", [1.0, 0.9, 0.05])
def test_fits_in_turn_equal_fits_by_differences(monkeypatch, share):
    r = np.random.default_rng(4)
    py, px = (a.ravel() for a in np.meshgrid(np.arange(100, 168), np.arange(1, 69), indexing="ij"))
    n = 30
    y, x, flux = r.uniform(97, 171, n), r.uniform(-2, 71, n), r.uniform(300, 9000, n)  # some beyond the tile
    v = sum(f * MP.profile(py - a, px - b, 3.0) for a, b, f in zip(y, x, flux)) + r.normal(0, 0.5, len(py))
    pixels = pd.DataFrame({"py": py, "px": px, "v": v})[r.random(len(py)) < share]
    start = lambda: (y + 0.2, x - 0.2, flux * 1.05)
    want = in_turn(*start(), pixels)
    monkeypatch.setattr(fit, "least_squares", None)
    got = MP.fit_in_turn(*start(), pixels, O)
    assert (np.isnan(got[3]) == np.isnan(want[3])).all() and (~np.isnan(got[3])).any()
    for a, b in zip(got, want):
        np.testing.assert_allclose(a, b, rtol=1e-5, atol=1e-5)


def test_fits_in_turn_do_not_depend_on_the_row(far=460_800):
    """Differences whose step grows with the row lost their slopes far from the first row."""
    r = np.random.default_rng(5)
    py, px = (a.ravel() for a in np.meshgrid(np.arange(1, 69), np.arange(1, 69), indexing="ij"))
    y, x, flux = r.uniform(1, 69, 20), r.uniform(1, 69, 20), r.uniform(300, 9000, 20)
    v = sum(f * MP.profile(py - a, px - b, 3.0) for a, b, f in zip(y, x, flux)) + r.normal(0, 0.5, len(py))
    here = MP.fit_in_turn(y + 0.2, x - 0.2, flux * 1.05, pd.DataFrame({"py": py, "px": px, "v": v}), O)
    there = MP.fit_in_turn(y + 0.2 + far, x - 0.2, flux * 1.05, pd.DataFrame({"py": py + far, "px": px, "v": v}), O)
    for a, b in zip(here, (there[0] - far, *there[1:])):
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-6)


def test_no_pixels_leave_sources_as_they_are():
    got = MP.fit_in_turn(np.array([3.0]), np.array([4.0]), np.array([5.0]), pd.DataFrame({"py": [], "px": [], "v": []}), O)
    assert (got[0][0], got[1][0], got[2][0]) == (3, 4, 5) and np.isnan(got[3][0])


@pytest.mark.parametrize("known", [None, 5])
def test_peaks_by_tiles_are_those_of_the_whole_image(spark, known):
    stars = scattered(18)
    image = field(spark, stars, 131, 96).withColumn("v", F.col("v") - 20.0)
    image = image.withColumn("v", F.when((F.col("y") == 31) & (F.col("x") == 40), math.nan).otherwise(F.col("v")))
    catalog = known and spark.createDataFrame([(k, *s) for k, s in enumerate(stars[:known])], "id long, y double, x double, flux double")
    kernel = MP.profile(*np.indices((7, 7)) - 3.0, O.fwhm)
    found = T.matched_filter(MP.subtract(image, catalog, O) if known else image, kernel).withColumn("significance", F.col("significance") / O.error)
    want = {(r["y"], r["x"]): r["significance"] for r in T.local_maxima(found, "significance").where(f"significance >= {O.detect_sigma}").collect()}
    got = {(r["y"], r["x"]): r["rank"] for r in MP.detect(image, O, catalog).collect()}
    assert got == pytest.approx(want) and len(got) >= len(stars) - 1 - (known or 0)


def test_absent_and_null_pixels_are_passed_over(spark):
    image = field(spark, [(20.0, 30.0, 900.0)], 60, 60).withColumn("v", F.col("v") - 20.0)
    gone = (F.col("y") == 22) & (F.col("x") == 32)
    for odd in (image.where(~gone), image.withColumn("v", F.when(~gone, F.col("v")))):
        best = MP.detect(odd, O).orderBy(F.desc("rank")).first()
        assert (best["y"], best["x"]) == (20, 30)


def test_matrix_that_cannot_be_inverted_has_no_variance(monkeypatch):
    """Elimination may find a matrix singular that has a Cholesky factor (seen at 360 x sf0.1)."""
    def singular(a):
        raise np.linalg.LinAlgError("Singular matrix")

    monkeypatch.setattr(np.linalg, "inv", singular)
    at = np.arange(1.0, 10.0)
    p, variance = MP.fit_alone(900 * MP.profile((at - 5.2)[:, None], (at - 4.9)[None, :], 3.0), np.ones((9, 9), bool), at, at, np.array([5.0, 5.0, 800.0, 0.0]), MP.K / 9, 4.0)
    assert p[:3] == pytest.approx([5.2, 4.9, 900], rel=1e-4) and math.isnan(variance)
