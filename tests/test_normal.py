"""The table of blocks and its conjugate gradients against a dense solve."""

import numpy as np

from starfold.operators import normal
from starfold.operators.sparse_fit import gaussian_profile


def test_steps_of_all_sources_equal_a_dense_solve(spark):
    rng = np.random.default_rng(3)
    n, side = 6, 18
    y, x, flux = rng.uniform(3, side - 3, n), rng.uniform(3, side - 3, n), rng.uniform(50, 400, n)
    v, w = rng.normal(size=(side, side)), rng.uniform(0.5, 2.0, (side, side))
    w[5, 5] = 0.0
    sources = spark.createDataFrame([(k, float(y[k]), float(x[k]), float(flux[k])) for k in range(n)], "id long, y double, x double, flux double")
    pixels = spark.createDataFrame([(a + 1, b + 1, float(v[a, b]), float(w[a, b])) for a in range(side) for b in range(side)], "y long, x long, v double, w double")
    py, px = (a.ravel() + 1.0 for a in np.mgrid[:side, :side])
    dense = np.zeros((side * side, n, 3))
    for k in range(n):
        g, gy, gx = gaussian_profile(3.0)(py - y[k], px - x[k])
        inside = (abs(py - np.rint(y[k])) <= 6) & (abs(px - np.rint(x[k])) <= 6)
        dense[:, k] = np.stack([flux[k] * gy, flux[k] * gx, g], axis=1) * (inside * np.sqrt(w.ravel()))[:, None]
    a = dense.reshape(-1, 3 * n)
    want = np.linalg.solve(a.T @ a, a.T @ (v * np.sqrt(w)).ravel()).reshape(n, 3)
    blocks, gradient = normal.normal_equations(sources, pixels, 3.0, 6)
    h = (a.T @ a).reshape(n, 3, n, 3)
    for r in blocks.collect():
        assert np.allclose([r[f"{p}_{q}"] for p in normal.PARTS for q in normal.PARTS], h[r["i"], :, r["j"], :].ravel(), rtol=1e-7, atol=1e-9)
    got = normal.solve(blocks, gradient, tol=1e-5).toPandas().sort_values("i")
    assert np.allclose(got[["s_dy", "s_dx", "s_df"]].to_numpy(), want, rtol=1e-2, atol=1e-3)
