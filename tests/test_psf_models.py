"""Profiles against differences and closed forms, blends at and past the nodes, fits with fixed parameters and weights."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import fit
from starfold.operators import psf_models as P
from starfold.plans import psf_queries as Q

Y, X = (a.ravel().astype(float) for a in np.mgrid[3:16, 4:17])


def differences(f, p):
    return fit.jacobian(lambda q: f(q, Y, X), np.array(p, float))


@pytest.mark.parametrize(
    "model, p",
    [
        (Q.table(3.0), (9.13, 10.31, 500.0, 7.0)),
        (P.Tabulated(np.random.default_rng(1).random((9, 13)), (2, 3), (3.3, 7.1), 0.5), (9.13, 10.31, 5.0, 1.0)),
        (Q.gridded(), (49.13, 10.31, 300.0, 2.0)),
        (Q.gridded(), (-12.13, 130.31, 300.0, 2.0)),
        (P.PixelGaussian(), (9.2, 10.4, 2.2, 3.1, 33.0, 400.0, 3.0)),
    ],
)
def test_slopes_match_differences(model, p):
    y, x = (Y - 9.37 + p[0], X - 10.21 + p[1])
    want = fit.jacobian(lambda q: model(q, y, x), np.array(p, float))
    got = model.slopes(np.array(p, float), y, x)
    assert got.shape == want.shape
    smooth = np.abs(want - got).max(axis=1) < 1e-5 * max(1, np.abs(want).max())
    assert smooth.mean() > 0.97  # a difference across the table's edge is none of a slope
    assert np.abs(want - got)[smooth].max() < 1e-5 * np.abs(want).max()


def test_table_is_exact_at_its_cells_and_filled_outside():
    t = P.Tabulated(np.arange(30.0).reshape(5, 6), 1, fill=-9.0)
    i, j = np.mgrid[0:5, 0:6].astype(float)
    assert np.array_equal(t.sample(i - 2, j - 2.5)[0], t.grid)
    value, by_y, by_x = t.sample(np.array([-2.1, 2.1, 0.0]), np.array([0.0, 0.0, 2.6]))
    assert (value == -9).all() and not by_y.any() and not by_x.any()
    inner = t.sample(np.array([0.25]), np.array([-0.75]))  # cubic convolution keeps planes
    assert np.allclose([a[0] for a in inner], [6 * 2.25 + 1.75, 6.0, 1.0])
    assert math.isclose(P.Tabulated(np.ones((4, 4)), 2, normalize=True).grid.sum(), 4.0)
    assert P.Tabulated(np.ones((9, 21)), (2, 2)).half_box() == 5


@pytest.mark.parametrize("make", [
    lambda: P.Tabulated(np.ones((3, 5))),
    lambda: P.Tabulated(np.full((4, 4), np.nan)),
    lambda: P.Tabulated(np.zeros((4, 4)), normalize=True),
    lambda: P.Tabulated(np.ones((4, 4)), 0),
    lambda: P.Tabulated(np.ones((4, 4)), (2, 1.5)),
    lambda: P.Tabulated(np.ones((4, 4)), 1, (1.0, np.inf)),
    lambda: P.Gridded([], [], []),
    lambda: P.Gridded([Q.table(3.0)] * 2, [0.0, 0.0], [0.0, 0.0]),
    lambda: P.Gridded([Q.table(3.0)] * 2, [0.0, 0.0], [0.0, 5.0]),
    lambda: P.Gridded([Q.table(3.0)] * 3, [0.0, 0.0, 5.0], [0.0, 5.0, 0.0]),
])
def test_bad_tables_are_errors(make):
    with pytest.raises(ValueError):
        make()


def test_blend_at_nodes_between_and_beyond():
    g = Q.gridded()
    at = lambda y, x: g.parts((y, x), Y - 9 + y, X - 10 + x)[0]
    alone = lambda k: g.tables[k].sample(Y - 9, X - 10)[0]
    assert np.allclose(at(41.0, 81.0), alone(6))
    assert np.allclose(at(21.0, 1.0), (alone(0) + alone(4)) / 2)
    assert np.allclose(at(-500.0, 9000.0), alone(3))
    assert sum(w for _, w, _, _ in g.blend(33.0, 77.0)) == pytest.approx(1)
    one = P.Gridded([Q.table(3.0)], [5.0], [5.0])
    assert np.allclose(one.parts((50.0, 60.0), Y - 9 + 50, X - 10 + 60)[0], Q.table(3.0).sample(Y - 9, X - 10)[0])


@pytest.mark.parametrize("model", [Q.table(3.0), Q.gridded()])
def test_columns_match_numpy(spark, model):
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, (rng.uniform(-30, 160), rng.uniform(-30, 160), rng.uniform(-6, 6), rng.uniform(-6, 6)))) for k in range(300)]
    rows += [(300, 41.0, 81.0, 5.0, -5.0), (301, 1.0, 121.0, 0.0, 0.0)]
    got = {r["k"]: r for r in P.with_light(spark.createDataFrame(rows, "k int, y double, x double, dy double, dx double"), model).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"k", "y", "x", "dy", "dx", "light", "light_y", "light_x"}
    for k, y, x, dy, dx in rows:
        p = np.array([y, x, 1.0, 0.0])
        want = [model(p, np.array([y + dy]), np.array([x + dx]))[0], *model.slopes(p, np.array([y + dy]), np.array([x + dx]))[0, :2]]
        if abs(abs(dy) - 5) > 1e-9 and abs(abs(dx) - 5) > 1e-9 and k != 301 and k != 300:
            assert np.allclose([got[k][c] for c in ("light", "light_y", "light_x")], want, atol=1e-12), (k, want)


def test_pixel_gaussian_by_fine_cells():
    p = np.array([9.0, 10.0, 1.7, 2.6, 0.0, 1.0, 0.0])
    fine = (np.arange(40) + 0.5) / 40 - 0.5
    for y, x in ((9.0, 10.0), (10.0, 12.0)):
        yy, xx = np.meshgrid(y + fine, x + fine, indexing="ij")
        cells = fit.elliptical(p, yy, xx).mean()
        assert abs(P.PixelGaussian()(p, np.array([y]), np.array([x]))[0] - cells) < 2e-5
    at = P.PixelGaussian()(np.array([0.0, 0.0, 2.0, 3.0, 40.0, 1.0, 0.0]), *[a.ravel().astype(float) for a in np.mgrid[-15:16, -15:16]])
    assert abs(at.sum() - 1) < 2e-3


def image_of(model, truth, rng, noise=0.5):
    rows = {}
    for p in truth.values():
        y, x = (a.ravel() for a in np.mgrid[round(p[0]) - 8 : round(p[0]) + 9, round(p[1]) - 8 : round(p[1]) + 9])
        for a, b, v in zip(y.tolist(), x.tolist(), model(np.array(p), y.astype(float), x.astype(float)), strict=True):
            rows[a, b] = float(v + rng.normal() * noise)
    return [(a, b, v) for (a, b), v in rows.items()]


@pytest.mark.parametrize("model", [Q.table(3.0), Q.gridded()])
def test_fit_of_tables_finds_the_truth(spark, model):
    truth = {k: (20.3 + 30 * k, 15.7 + 25 * k, 4000.0 + 500 * k, 30.0) for k in range(4)}
    image = spark.createDataFrame(image_of(model, truth, np.random.default_rng(3)), "y long, x long, v double")
    start = spark.createDataFrame([(k, p[0] + 0.4, p[1] - 0.3, p[2] * 0.8, 28.0) for k, p in truth.items()], "id int, y double, x double, flux double, bkg double")
    for r in fit.fit_stars(start, image, model, radius=4, weight=4.0).collect():
        p = truth[r["id"]]
        for name, want in zip(("y", "x", "flux", "bkg"), p, strict=True):
            assert abs(r[name] - want) < 5 * r[f"{name}_err"] and r[f"{name}_err"] > 0
        assert r["converged"] and 0.5 < r["chisq"] < 1.6


def test_fixed_parameters_and_weights(spark):
    truth = {0: (20.3, 15.7, 3.0, 4000.0, 30.0), 1: (60.1, 40.2, 3.0, 900.0, 30.0)}
    pixels = image_of(fit.gaussian, truth, np.random.default_rng(7))
    spoiled = [(y, x, 9e4, 0.0) if (y + x) % 7 == 0 else (y, x, v, 4.0) for y, x, v in pixels]
    image = spark.createDataFrame([*spoiled, (20, 15, math.nan, 4.0)], "y long, x long, v double, iv double")
    start = spark.createDataFrame([(k, p[0], p[1], 1.0, 0.0) for k, p in truth.items()] + [(2, 500.0, 500.0, 1.0, 0.0), (None, 20.0, 15.0, 1.0, 0.0)], "id int, y double, x double, flux double, bkg double")
    got = {r["id"]: r for r in fit.fit_stars(start, image, "gaussian", weight="iv", fixed={"y": None, "x": None, "fwhm": 3.0}).collect()}
    assert set(got) == {0, 1}  # a source without pixels, or without an id, has no row
    for k, p in truth.items():
        assert (got[k]["y"], got[k]["x"], got[k]["fwhm"]) == p[:3] and got[k]["y_err"] == got[k]["fwhm_err"] == 0
        assert abs(got[k]["flux"] - p[3]) < 5 * got[k]["flux_err"] and abs(got[k]["bkg"] - 30) < 5 * got[k]["bkg_err"]
    for fixed in ({"beta": 2.0}, dict.fromkeys(("y", "x", "fwhm", "flux", "bkg"))):
        with pytest.raises(ValueError):
            fit.fit_stars(start, image, "gaussian", fixed=fixed)


def test_few_pixels_give_nulls_and_groups_span_batches(spark):
    pixels = spark.range(4000).select((F.col("id") % 5 + 1).alias("y"), F.expr("id div 5 + 1").alias("x"), F.lit(2.0).alias("v"))
    sources = spark.range(260).select("id", F.lit(3.0).alias("y"), (F.col("id") * 3 + 5.0).alias("x"), F.lit(1.0).alias("flux"), F.lit(0.0).alias("bkg"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = fit.fit_stars(sources, pixels, "gaussian", radius=2, fixed={"y": None, "x": None, "fwhm": None}).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got["id"]) == list(range(260)) and np.allclose(got["bkg"], 2) and np.allclose(got["flux"], 0, atol=1e-6)
    lone = fit.fit_stars(sources.where("id = 0"), pixels.where("y = 3 and x between 4 and 6"), "gaussian", radius=2).first()
    assert lone["flux"] is None and lone["flux_err"] is None and not lone["converged"]
