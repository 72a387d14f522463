"""The matrix-free fit against dense algebra, and its errors against the full inverse."""

import numpy as np
import pytest

from starfold.operators import sparse_fit as S


def scene(n, side, noise=0.5, seed=0):
    rng = np.random.default_rng(seed)
    y, x, f = rng.uniform(1, side, n), rng.uniform(1, side, n), rng.uniform(200, 2000, n)
    py, px = (a.ravel().astype(float) for a in np.mgrid[1 : side + 1, 1 : side + 1])
    empty = S.Grid(py, px, np.zeros(len(py)), 1.0, 8)
    at = (py.astype(int) - empty.origin[0]) * empty.shape[1] + px.astype(int) - empty.origin[1]
    return y, x, f, py, px, S.Jacobian(empty, S.gaussian_profile(3.0), y, x, f).model[at] + rng.normal(0, noise, len(py))


@pytest.fixture(scope="module")
def crowded():
    y, x, f, py, px, v = scene(40, 60)
    return y, x, f, S.Jacobian(S.Grid(py, px, v, 1.0, 8), S.gaussian_profile(3.0), y + 0.1, x - 0.1, f * 0.9)


def test_steps_equal_the_dense_solution(crowded):
    *_, j = crowded
    dense, b = np.stack([j.times(e) for e in np.eye(120)], 1), j.residual()
    assert np.allclose(dense.T @ b, j.back(b))
    for damp in (0.0, 0.03):
        want = np.linalg.lstsq(np.vstack([dense, damp * np.eye(120)]), np.r_[b, np.zeros(120)], rcond=None)[0]
        assert np.allclose(S.lsqr(j.times, j.back, b, 120, damp, 1e-12), want, rtol=1e-6, atol=1e-6)
    assert not S.lsqr(j.times, j.back, 0 * b, 120).any()


def test_pair_blocks_are_those_of_the_normal_equations(crowded):
    *_, j = crowded
    dense = np.stack([j.times(e) for e in np.eye(120)], 1)
    normal = dense.T @ dense
    i, k, cross = j.pairs()
    assert all(np.allclose(normal[3 * a : 3 * a + 3, 3 * b : 3 * b + 3], m) for a, b, m in zip(i, k, cross))
    met = {(a, b) for a, b in zip(i.tolist(), k.tolist())}
    assert all((a, b) in met for a in range(40) for b in range(a + 1, 40) if abs(normal[3 * a : 3 * a + 3, 3 * b : 3 * b + 3]).max() > 1e-14)


def test_errors_over_eight_neighbours_are_near_the_full_inverse():
    y, x, f, py, px, v = scene(150, 90, seed=3)
    j = S.Jacobian(S.Grid(py, px, v, 1.0, 8), S.gaussian_profile(3.0), y, x, f)
    dense = np.stack([j.times(e) for e in np.eye(450)], 1)
    full = np.sqrt(np.diag(np.linalg.inv(dense.T @ dense)).reshape(150, 3) / j.scale**2)
    near = np.sqrt(np.einsum("nkk->nk", j.covariances()))
    ratio = near / full
    assert (abs(ratio - 1) < 0.01).mean() > 0.99 and ratio.max() < 1 + 1e-9
    alone = np.sqrt(np.einsum("nkk->nk", j.covariances(0)))
    assert (alone <= near + 1e-12).all() and np.median(alone / full) < 0.99


def test_fit_recovers_the_scene_and_leaves_unseen_sources_undetermined():
    y, x, f, py, px, v = scene(60, 80, seed=5)
    keep = py > 20
    grid = S.Grid(py[keep], px[keep], v[keep], 1.0, 8)
    got = S.fit_all(grid, S.gaussian_profile(3.0), np.append(y + 0.1, -60.0), np.append(x - 0.1, 5.0), np.append(f * 0.9, 100.0))
    seen = y > 26
    pull = (got[2][:-1] - f)[seen] / (got[3][:-1][seen] * 0.5)
    assert 0.7 < pull.std() < 1.3 and np.median(abs(got[0][:-1] - y)[seen]) < 0.02
    assert np.isnan(got[3][-1])


def test_errors_of_quadratic_peaks_follow_the_noise():
    from starfold.operators.shapes import quadratic_peaks

    rng = np.random.default_rng(2)
    dy, dx = (a.ravel().astype(float) for a in np.mgrid[-1:2, -1:2])
    truth = 10 + 0.4 * dy - 0.3 * dx - 1.2 * dy**2 - 0.9 * dx**2 + 0.2 * dy * dx
    w = rng.uniform(200, 900, 9)
    many = quadratic_peaks(truth + rng.normal(size=(20_000, 9)) / np.sqrt(w), np.tile(w, (20_000, 1)))
    one = {k: v[0] for k, v in quadratic_peaks(truth[None], w[None]).items()}
    want = np.linalg.solve([[2.4, -0.2], [-0.2, 1.8]], [0.4, -0.3])
    assert np.allclose([one["y"], one["x"]], want)
    for n in ("y", "x", "peak", "curvature", "com_y", "com_x"):
        assert 0.96 < many[n].std() / one[f"{n}_err"] < 1.04
    few = quadratic_peaks(truth[None], np.where(np.arange(9) < 5, w, 0.0)[None])
    assert np.isnan(few["y"][0]) and np.isfinite(few["com_y"][0])
    assert np.isnan(quadratic_peaks(np.ones((1, 9)), np.ones((1, 9)))["y"][0])  # flat


def test_blocks_of_two_bands_equal_dense_normal_equations():
    from starfold.plans.joint_fit import linearised

    rng = np.random.default_rng(9)
    n, parts = 25, []
    y, x, flux = rng.uniform(5, 40, n), rng.uniform(5, 40, n), rng.uniform(200, 900, (n, 2))
    py, px = (a.ravel().astype(float) for a in np.mgrid[1:46, 1:46])
    for band, oy, ox in ((0, 0.0, 0.0), (1, 0.4, -0.3), (1, -0.7, 0.2)):
        parts.append((band, oy, ox, S.Grid(py, px, rng.normal(0, 5, len(py)), 2.0, 8)))
    h, b, cost = linearised(y, x, flux, parts, S.gaussian_profile(3.0))
    dense, slope = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    for band, oy, ox, grid in parts:
        j = S.Jacobian(grid, S.gaussian_profile(3.0), y + oy, x + ox, flux[:, band])
        a = np.zeros((grid.size, n, 4))
        for k in range(n):
            for c, spot in enumerate((0, 1, 2 + band)):
                e = np.zeros((n, 3))
                e[k, c] = j.scale[k, c]
                a[:, k, spot] = j.times(e.ravel())
        a = a.reshape(grid.size, -1)
        dense, slope = dense + a.T @ a, slope + a.T @ j.residual()
    assert np.allclose(b.ravel(), slope) and cost > 0
    p = rng.normal(size=(n, 4))
    assert np.allclose(h.times(p).ravel(), dense @ p.ravel())
    unit, scale = h.scaled()
    want = np.linalg.solve(dense, slope).reshape(n, 4)
    assert np.allclose(S.conjugate_gradients(unit, b / scale, 0.0, 1e-13) / scale, want, rtol=1e-6, atol=1e-8)
    full = np.sqrt(np.diag(np.linalg.inv(dense))).reshape(n, 4)
    near = np.sqrt(np.einsum("nkk->nk", S.marginal(unit))) / scale
    assert (abs(near / full - 1) < 0.01).mean() > 0.95
