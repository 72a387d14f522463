"""Least squares of many overlapping profiles in one tile, without forming a matrix of all parameters.

A source touches only its stamp. The Jacobian is kept as one block of derivatives for each source and applied by gathering and
scattering stamps; steps come from LSQR on its equilibrated columns. Errors invert the normal equations of a
source and its most coupled neighbours. Memory is sources times stamp pixels, so thousands of sources fit in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

# profile(dy, dx) -> its value and its derivatives by the source's y and x, for offsets of pixels from the source
Profile = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def gaussian_profile(fwhm: float) -> Profile:
    k = 4 * math.log(2) / (fwhm * fwhm)

    def at(dy: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = k / math.pi * np.exp(-k * (dy * dy + dx * dx))
        return g, 2 * k * dy * g, 2 * k * dx * g

    return at


class Grid:
    """A tile's pixels as an image with a border of ``radius`` pixels; ``root`` is the root of the weight, 0 where there is no pixel."""

    def __init__(self, py: np.ndarray, px: np.ndarray, v: np.ndarray, weight: np.ndarray | float, radius: int):
        self.radius = radius
        low, high = (int(py.min()), int(px.min())), (int(py.max()), int(px.max()))
        self.origin, self.shape = (low[0] - radius, low[1] - radius), (high[0] - low[0] + 1 + 2 * radius, high[1] - low[1] + 1 + 2 * radius)
        at = (py.astype(int) - self.origin[0]) * self.shape[1] + px.astype(int) - self.origin[1]
        self.v, self.root = np.zeros(self.shape[0] * self.shape[1]), np.zeros(self.shape[0] * self.shape[1])
        self.v[at], self.root[at] = v, np.sqrt(weight)
        self.size = len(self.v)


class Jacobian:
    """Model and derivatives of sources at ``y, x, flux``, in stamps around their nearest pixels."""

    def __init__(self, grid: Grid, profile: Profile, y: np.ndarray, x: np.ndarray, flux: np.ndarray):
        r = grid.radius
        side = np.arange(-r, r + 1)
        # a source beyond the tile keeps its profile, but its stamp is moved to the border
        iy = np.clip(np.rint(y).astype(int) - grid.origin[0], r, grid.shape[0] - 1 - r)
        ix = np.clip(np.rint(x).astype(int) - grid.origin[1], r, grid.shape[1] - 1 - r)
        rows, cols = iy[:, None] + side, ix[:, None] + side
        self.grid, self.corner = grid, np.stack([iy - r, ix - r], axis=1)
        self.index = (rows[:, :, None] * grid.shape[1] + cols[:, None, :]).reshape(len(y), -1)
        dy = (rows + grid.origin[0] - y[:, None])[:, :, None]
        dx = (cols + grid.origin[1] - x[:, None])[:, None, :]
        g, gy, gx = profile(dy, dx)
        g, gy, gx = (np.broadcast_to(a, (len(y), len(side), len(side))).reshape(len(y), -1) for a in (g, gy, gx))
        self.model = np.bincount(self.index.ravel(), (flux[:, None] * g).ravel(), grid.size)
        blocks = np.stack([flux[:, None] * gy, flux[:, None] * gx, g], axis=1) * grid.root[self.index][:, None, :]
        self.scale = np.sqrt((blocks * blocks).sum(2))
        self.scale[self.scale == 0] = 1.0
        self.blocks = blocks / self.scale[:, :, None]

    def residual(self) -> np.ndarray:
        return (self.grid.v - self.model) * self.grid.root

    def times(self, p: np.ndarray) -> np.ndarray:
        """The weighted image of the (scaled) parameters."""
        return np.bincount(self.index.ravel(), (p.reshape(-1, 1, 3) @ self.blocks).ravel(), self.grid.size)

    def back(self, image: np.ndarray) -> np.ndarray:
        """The transpose: products of every derivative with the image."""
        return (self.blocks @ image[self.index][:, :, None]).ravel()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``i < j`` and the 3 x 3 products of derivatives of all sources whose stamps overlap; pairs of one offset share their slices."""
        side = 2 * self.grid.radius + 1
        order = np.lexsort((self.corner[:, 1], self.corner[:, 0]))
        top = self.corner[order, 0]
        i, j = [], []
        for n, end in enumerate(np.searchsorted(top, top + side)):  # partners with a corner at most a stamp further down
            other = np.arange(n + 1, end)
            near = other[abs(self.corner[order[other], 1] - self.corner[order[n], 1]) < side]
            i.append(np.full(len(near), order[n]))
            j.append(order[near])
        i, j = (np.concatenate(a) if a else np.zeros(0, int) for a in (i, j))
        i, j = np.minimum(i, j), np.maximum(i, j)
        shift = self.corner[j] - self.corner[i]
        cube = self.blocks.reshape(len(self.corner), 3, side, side)
        out = np.empty((len(i), 3, 3))
        code = (shift[:, 0] + side) * 4 * side + shift[:, 1] + side
        by = np.argsort(code, kind="stable")
        for run in np.split(by, np.flatnonzero(np.diff(code[by])) + 1) if len(by) else []:
            a, b = shift[run[0]]
            mine = cube[i[run], :, max(a, 0) : side + min(a, 0), max(b, 0) : side + min(b, 0)]
            theirs = cube[j[run], :, max(-a, 0) : side + min(-a, 0), max(-b, 0) : side + min(-b, 0)]
            out[run] = mine.reshape(len(run), 3, -1) @ theirs.reshape(len(run), 3, -1).transpose(0, 2, 1)
        return i, j, out

    def covariances(self, neighbours: int = 8) -> np.ndarray:
        """3 x 3 covariance of each source for unit weights, marginal over its most coupled neighbours; NaN where it is not determined."""
        return marginal(Blocks(self.blocks @ self.blocks.transpose(0, 2, 1), *self.pairs()), neighbours) / (self.scale[:, :, None] * self.scale[:, None, :])


class Blocks:
    """Normal equations by sources: ``own`` (n, k, k), and for pairs ``i < j`` whose stamps overlap ``cross`` (k, k)."""

    def __init__(self, own: np.ndarray, i: np.ndarray, j: np.ndarray, cross: np.ndarray):
        self.own, self.i, self.j, self.cross = own, i, j, cross

    def merged(self, other: Blocks) -> Blocks:
        """The sum of both; a pair that is in both becomes one."""
        n, k = self.own.shape[:2]
        pairs, at = np.unique(np.concatenate([self.i, other.i]).astype(np.int64) * n + np.concatenate([self.j, other.j]), return_inverse=True)
        cross = np.zeros((len(pairs), k, k))
        np.add.at(cross, at, np.concatenate([self.cross, other.cross]))
        return Blocks(self.own + other.own, pairs // n, pairs % n, cross)

    def scaled(self) -> tuple[Blocks, np.ndarray]:
        """With unit diagonal, and the roots of the old one; parameters that nothing depends on keep 0."""
        root = np.sqrt(np.einsum("nkk->nk", self.own))
        s = np.where(root > 0, root, 1.0)
        return Blocks(self.own / (s[:, :, None] * s[:, None, :]), self.i, self.j, self.cross / (s[self.i][:, :, None] * s[self.j][:, None, :])), s

    def times(self, p: np.ndarray) -> np.ndarray:
        """The matrix times a vector (n, k)."""
        out = (self.own @ p[:, :, None])[:, :, 0]
        if len(self.i):
            right, left = (self.cross @ p[self.j][:, :, None])[:, :, 0], (p[self.i][:, None, :] @ self.cross)[:, 0]
            for c in range(p.shape[1]):
                out[:, c] += np.bincount(self.i, right[:, c], len(p)) + np.bincount(self.j, left[:, c], len(p))
        return out


def conjugate_gradients(h: Blocks, b: np.ndarray, damp: float = 0.0, tol: float = 1e-8) -> np.ndarray:
    """``p`` of (h + damp) p = b, preconditioned by the sources' own blocks; ends when the residual is ``tol`` of its first size, or after as many steps as unknowns and rounding may ask for."""
    n, k = b.shape
    diagonal = damp + 1e-12
    first = np.linalg.inv(h.own + (diagonal + (np.einsum("nkk->nk", h.own) == 0)[:, :, None]) * np.eye(k))
    apply = lambda p: h.times(p) + damp * p
    p, r = np.zeros_like(b), b.copy()
    z = (first @ r[:, :, None])[:, :, 0]
    d, rz, end = z.copy(), (r * z).sum(), tol * np.linalg.norm(b)
    for _ in range(4 * n * k + 100):
        if np.linalg.norm(r) <= end:
            break
        hd = apply(d)
        bend = (d * hd).sum()
        if bend <= 0:  # no descent left within rounding
            break
        a = rz / bend
        p, r = p + a * d, r - a * hd
        z = (first @ r[:, :, None])[:, :, 0]
        rz, old = (r * z).sum(), rz
        d = z + rz / old * d
    return p


def marginal(h: Blocks, neighbours: int = 8) -> np.ndarray:
    """Covariance (n, k, k) of each source, marginal over its most coupled neighbours: the inverse of the Schur complement in their joint block. NaN where it is not determined."""
    n, k = h.own.shape[:2]
    key = h.i.astype(np.int64) * n + h.j
    by_key = np.argsort(key)
    one, two = np.concatenate([h.i, h.j]), np.concatenate([h.j, h.i])
    strength = np.tile((h.cross * h.cross).sum((1, 2)), 2)
    order = np.lexsort((two, -strength, one))
    place = np.arange(len(order)) - np.searchsorted(one[order], one[order])
    kept = order[place < neighbours]
    group = np.full((n, neighbours + 1), -1)
    group[:, 0] = np.arange(n)
    group[one[kept], 1 + place[place < neighbours]] = two[kept]
    out = np.full((n, k, k), math.nan)
    idle = np.einsum("nkk->nk", h.own) == 0  # parameters that no pixel depends on
    fill = np.eye(k) * (1e-12 + idle[:, :, None])
    for at in range(0, n, 512):
        g = group[at : at + 512]
        m = g.shape[1]
        full = np.zeros((len(g), m, k, m, k))
        for p in range(m):
            full[:, p, :, p, :] = np.where((g[:, p] >= 0)[:, None, None], h.own[g[:, p]] + fill[g[:, p]], np.eye(k))
            for q in range(p + 1, m if len(key) else 0):
                low, high = np.minimum(g[:, p], g[:, q]), np.maximum(g[:, p], g[:, q])
                want = low.astype(np.int64) * n + high
                spot = by_key[np.minimum(np.searchsorted(key[by_key], want), len(key) - 1)]
                hit = (low >= 0) & (key[spot] == want)
                block = np.where(hit[:, None, None], h.cross[spot], 0.0)
                block = np.where((g[:, p] > g[:, q])[:, None, None], block.transpose(0, 2, 1), block)
                full[:, p, :, q, :], full[:, q, :, p, :] = block, block.transpose(0, 2, 1)
        full = full.reshape(len(g), k * m, k * m)
        rest = full[:, k:, k:] + 1e-12 * np.eye(k * m - k)
        schur = full[:, :k, :k] - full[:, :k, k:] @ np.linalg.solve(rest, full[:, k:, :k])
        sound = np.linalg.eigvalsh(schur)[:, 0] > 1e-9
        inner = out[at : at + 512]
        inner[sound] = np.linalg.inv(schur[sound])
        gone = idle[at : at + 512]
        inner[gone[:, :, None] | gone[:, None, :]] = math.nan
    return out


def lsqr(times: Callable[[np.ndarray], np.ndarray], back: Callable[[np.ndarray], np.ndarray], b: np.ndarray, n: int, damp: float = 0.0, tol: float = 1e-10) -> np.ndarray:
    """The ``p`` of least |times(p) - b|^2 + damp^2 |p|^2, by bidiagonalisation (Paige and Saunders).

    Ends when the gradient is ``tol`` of its first size, or after as many steps as there are unknowns and rounding may ask for.
    """
    p, u = np.zeros(n), b.copy()
    beta = np.linalg.norm(u)
    if not beta:
        return p
    u /= beta
    v = back(u)
    alpha = np.linalg.norm(v)
    if not alpha:
        return p
    v /= alpha
    w, phi_bar, rho_bar, first = v.copy(), beta, alpha, alpha * beta
    for _ in range(4 * n + 100):
        u = times(v) - alpha * u
        beta = np.linalg.norm(u)
        if beta:
            u /= beta
        v = back(u) - beta * v
        alpha = np.linalg.norm(v)
        if alpha:
            v /= alpha
        rho_damped = math.hypot(rho_bar, damp)
        phi_bar *= rho_bar / rho_damped
        rho = math.hypot(rho_damped, beta)
        c, s = rho_damped / rho, beta / rho
        theta, rho_bar, phi, phi_bar = s * alpha, -c * alpha, c * phi_bar, s * phi_bar
        p += phi / rho * w
        w = v - theta / rho * w
        if abs(phi_bar * alpha * c) <= tol * first:
            break
    return p


def fit_all(grid: Grid, profile: Profile, y: np.ndarray, x: np.ndarray, flux: np.ndarray, steps: int = 6, cap: float = 0.5, solver_tol: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Positions, fluxes and flux errors (for unit weights) of all sources by damped Gauss-Newton steps; a position moves at most ``cap`` pixels a step."""
    n, damp = len(y), 1e-3
    j = Jacobian(grid, profile, y, x, flux)
    cost = (j.residual() ** 2).sum()
    for _ in range(steps):
        for _ in range(8):
            s = lsqr(j.times, j.back, j.residual(), 3 * n, math.sqrt(damp), solver_tol).reshape(n, 3) / j.scale
            new = y + np.clip(s[:, 0], -cap, cap), x + np.clip(s[:, 1], -cap, cap), flux + s[:, 2]
            trial = Jacobian(grid, profile, *new)
            cost2 = (trial.residual() ** 2).sum()
            if cost2 < cost:
                break
            damp *= 10
        else:
            break
        small = cost - cost2 < 1e-6 * cost
        (y, x, flux), j, cost, damp = new, trial, cost2, max(damp / 10, 1e-4)
        if small:
            break
    variance = j.covariances()[:, 2, 2]
    return y, x, flux, np.sqrt(np.where(variance > 0, variance, math.nan))
