"""The profile builder: stars placed many at once against fits of one star, one reading of the image, and cells that no task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import epsf
from starfold.operators import robust as R
from starfold.operators.fit import least_squares

from .test_fits_and_files import field, scattered

IY, IX = (a.ravel() for a in np.meshgrid(np.arange(-5, 6), np.arange(-5, 6), indexing="ij"))


def profile():
    at = (np.arange(25) - 12) / 2
    return np.exp(-(at[:, None] ** 2 + at[None, :] ** 2) / 4) / (4 * np.pi)


def test_slopes_of_the_grid():
    y, x = np.random.default_rng(1).uniform(-1, 25, (2, 200))
    value, by_y, by_x = epsf.sloped(profile(), y, x)
    np.testing.assert_allclose(value, epsf.bicubic(profile(), y, x), atol=1e-15)
    inner = (y > 0.01) & (y < 23.99) & (x > 0.01) & (x < 23.99)
    h = 1e-6
    np.testing.assert_allclose(by_y[inner], ((epsf.bicubic(profile(), y + h, x) - epsf.bicubic(profile(), y - h, x)) / (2 * h))[inner], atol=1e-7)
    np.testing.assert_allclose(by_x[inner], ((epsf.bicubic(profile(), y, x + h) - epsf.bicubic(profile(), y, x - h)) / (2 * h))[inner], atol=1e-7)


def test_stars_placed_at_once_are_those_placed_alone():
    r, n, grid = np.random.default_rng(2), 40, profile()
    truth = np.stack([r.uniform(20, 21, n), r.uniform(30, 31, n), r.uniform(500, 5000, n), np.full(n, 50.0)], axis=1)
    f = lambda p, y, x: p[3] + p[2] * epsf.bicubic(grid, (y - p[0]) * 2 + 12, (x - p[1]) * 2 + 12)
    start = truth + r.normal(0, 1, (n, 4)) * [0.2, 0.2, 50, 1]
    start[7] = [np.nan, 30, 900, 50]
    stars = []
    for k in range(n):
        kept = r.permutation(121)[: 3 if k == 5 else 121 - 2 * k]  # star 5 has fewer pixels than parameters
        y, x = np.rint(truth[k, 0]) + IY[kept], np.rint(truth[k, 1]) + IX[kept]
        stars.append((y, x, f(truth[k], y, x) + r.normal(0, 0.5, len(kept))))
    got = epsf.placed(grid, 2, start, epsf.Pixels(np.array([len(s[2]) for s in stars]), *(np.concatenate([s[c] for s in stars]) for c in range(3))))
    for k, (y, x, v) in enumerate(stars):
        if k == 7:
            assert np.isnan(got[k, 0]) and (got[k, 1:] == start[k, 1:]).all()
        elif k != 5:
            np.testing.assert_allclose(got[k], least_squares(lambda p: f(p, y, x), v, start[k], rounds=20).p, rtol=1e-6, atol=1e-6)  # noqa: B023
    y, x, v = stars[5]
    assert ((v - f(got[5], y, x)) ** 2).sum() <= ((v - f(start[5], y, x)) ** 2).sum()


@pytest.mark.parametrize("whole", [R.WHOLE, 5])
def test_image_is_read_once_and_large_cells_agree(spark, monkeypatch, whole):
    stars = scattered(14, seed=5, apart=14.0)
    image = field(spark, stars, noise=0.1).repartition(4).cache()
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        reads.add(1)
        return v

    given = spark.createDataFrame([(k, y + 0.1, x - 0.1, f * 0.95, 20.0) for k, (y, x, f) in enumerate(stars)], "id long, y double, x double, flux double, bkg double")
    want, _ = epsf.build(given, image, half=5)
    monkeypatch.setattr(R, "WHOLE", whole)
    grid, placed = epsf.build(given, image.withColumn("v", seen.asNondeterministic()("v")), half=5)  # so that a filter does not call it again
    assert reads.value == 96 * 96
    np.testing.assert_allclose(grid, want, atol=1e-9)
    assert placed.count() == len(stars)
