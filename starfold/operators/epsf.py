"""Building a tabulated point-spread function from stars.

The image is read once: each star keeps its pixels as a row of arrays. Star pixels are projected on an oversampled grid
around each star and combined by a clipped median, a cell at a time; the grid, a bounded table of
(2 * half * oversample + 1)^2 cells, is then filled, smoothed and centred in numpy, and the stars are placed anew against it,
many at once. A few rounds converge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, ship
from . import robust as R
from .fit import by_group
from .measure import on_image

C = F.col


def cubic_weights(t: np.ndarray) -> np.ndarray:
    return np.stack([(-t + 2 * t**2 - t**3) / 2, (2 - 5 * t**2 + 3 * t**3) / 2, (t + 4 * t**2 - 3 * t**3) / 2, (-(t**2) + t**3) / 2])


def cubic_slopes(t: np.ndarray) -> np.ndarray:
    """Derivatives of the weights."""
    return np.stack([(-1 + 4 * t - 3 * t**2) / 2, (-10 * t + 9 * t**2) / 2, (1 + 8 * t - 9 * t**2) / 2, (-2 * t + 3 * t**2) / 2])


def bicubic(grid: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Values of a grid at positions in cells from 0, edges repeated for the taps, ``fill`` outside."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx = cubic_weights(y - i), cubic_weights(x - j)
    ny, nx = grid.shape
    out = np.zeros(np.broadcast(y, x).shape)
    for a in range(4):
        for b in range(4):
            out = out + wy[a] * wx[b] * grid[np.clip(i + a - 1, 0, ny - 1), np.clip(j + b - 1, 0, nx - 1)]
    return np.where((y >= 0) & (y <= ny - 1) & (x >= 0) & (x <= nx - 1), out, fill)


def sloped(grid: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bicubic`` and its derivatives by y and x, all 0 outside."""
    ny, nx = grid.shape
    inside = (y >= 0) & (y <= ny - 1) & (x >= 0) & (x <= nx - 1)
    y, x = np.where(inside, y, 0.0), np.where(inside, x, 0.0)
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx, sy, sx = cubic_weights(y - i), cubic_weights(x - j), cubic_slopes(y - i), cubic_slopes(x - j)
    cols = [np.clip(j + b - 1, 0, nx - 1) for b in range(4)]
    value, by_y, by_x = np.zeros(y.shape), np.zeros(y.shape), np.zeros(y.shape)
    for a in range(4):
        row = np.clip(i + a - 1, 0, ny - 1) * nx
        taps = [grid.ravel()[row + c] for c in cols]
        line = sum(w * t for w, t in zip(wx, taps))
        value, by_y, by_x = value + wy[a] * line, by_y + sy[a] * line, by_x + wy[a] * sum(w * t for w, t in zip(sx, taps))
    return value * inside, by_y * inside, by_x * inside


def filled(grid: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Holes filled along their row or column by the cubic through two neighbours on either side, else by the median around, else 0."""
    grid = grid.copy()
    for _ in range(rounds):
        holes = np.argwhere(np.isnan(grid))
        if not len(holes):
            return grid
        new = grid.copy()
        for i, j in holes:
            values = []
            for line, k in ((grid[i], j), (grid[:, j], i)):
                near = [q for q in (k - 2, k - 1, k + 1, k + 2) if 0 <= q < len(line) and not math.isnan(line[q])]
                if len(near) == 4:
                    values.append(sum(line[q] * np.prod([(k - p) / (q - p) for p in near if p != q]) for q in near))
            around = grid[max(i - 1, 0) : i + 2, max(j - 1, 0) : j + 2]
            if values:
                new[i, j] = np.mean(values)
            elif not np.isnan(around).all():
                new[i, j] = np.nanmedian(around)
        grid = new
    return np.nan_to_num(grid, nan=0.0)


def smoothed(grid: np.ndarray) -> np.ndarray:
    """Least-squares quartic smoothing in windows of five by five cells, edges repeated."""
    d = np.arange(-2, 3)
    y, x = (a.ravel() for a in np.meshgrid(d, d, indexing="ij"))
    terms = np.stack([y**a * x**b for a in range(5) for b in range(5 - a)], axis=1).astype(float)
    kernel = np.linalg.pinv(terms)[0].reshape(5, 5)
    wide = np.pad(grid, 2, mode="edge")
    return sum(kernel[i, j] * wide[i : i + grid.shape[0], j : j + grid.shape[1]] for i in range(5) for j in range(5))


def centred(grid: np.ndarray, least: float = 0.01, most: float = 2.0) -> np.ndarray:
    """The grid moved so that its light's centre near the middle is the middle cell; tiny and large moves are left out."""
    h = grid.shape[0] // 2
    r = max(2, h // 4)
    core = np.maximum(grid[h - r : h + r + 1, h - r : h + r + 1], 0)
    y, x = np.indices(core.shape) - r
    total = core.sum()
    dy, dx = (core * y).sum() / total, (core * x).sum() / total
    if not least < max(abs(dy), abs(dx)) < most:
        return grid
    i, j = np.indices(grid.shape).astype(float)
    return bicubic(grid, i + dy, j + dx)


def build(stars: DataFrame, image: DataFrame, half: int = 6, oversample: int = 2, rounds: int = 3) -> tuple[np.ndarray, DataFrame]:
    """The grid (unit sum over the pixels of a star at its middle) and the stars with their last positions and fluxes.

    ``stars``: ``id, y, x, flux, bkg``. The grid has ``2 * half * oversample + 1`` cells on a side. A star moves less than a
    pixel a round, so its pixels of all rounds lie within ``half + rounds - 1`` of where it starts.
    """
    ship(image.sparkSession)
    side = 2 * half * oversample + 1
    mid = half * oversample
    grid = np.zeros((side, side))
    kinds = f"id {stars.schema['id'].dataType.simpleString()}, y double, x double, flux double, bkg double"
    whole = ["ay long, ax long, iy array<smallint>, ix array<smallint>, v array<double>"]
    met = on_image(stars.select("id", *[C(c).cast("double").alias(c) for c in ("y", "x", "flux", "bkg")]), image.select("y", "x", "v"), half + rounds - 1).where(C("v").isNotNull() & ~F.isnan("v"))
    one = ["id", "y", "x", "flux", "bkg", "ay", "ax"]
    held = met.groupBy(*one).agg(F.collect_list(F.struct((C("py") - C("ay")).cast("smallint").alias("iy"), (C("px") - C("ax")).cast("smallint").alias("ix"), C("v").cast("double").alias("v"))).alias("p"))
    stars = materialize(held.select(*one, *[C(f"p.{c}").alias(c) for c in ("iy", "ix", "v")]), "stars")
    few = stars.count() <= R.WHOLE  # a star has at most one pixel in a cell
    for k in range(rounds):
        own = stars.mapInPandas(projecting(grid, half, oversample), "cell long, e double")
        cells = by_group(own, "cell", clipped_median, "cell long, e double", ["cell", "e"]) if few else clipped_medians(own)
        new = np.full(side * side, math.nan)
        for r in cells.collect():  # at most side * side
            new[r["cell"]] = r["e"] + grid.ravel()[r["cell"]]
        grid = centred(smoothed(filled(new.reshape(side, side))))
        grid = grid / max(grid.sum() / oversample**2, 1e-12)
        last = k == rounds - 1  # the last places are found when they are asked for
        stars = stars.mapInPandas(placing(grid, half, oversample, not last), ", ".join([kinds, *([] if last else whole)]))
        stars = stars if last else materialize(stars, "stars")
    return grid, stars


def clipped_median(cell: pd.DataFrame) -> tuple[int, float]:
    """A cell and the median of its values within three deviations, as estimated by the median absolute deviation."""
    e = cell["e"].to_numpy()
    d = abs(e - np.median(e))
    return cell["cell"].iloc[0], float(np.median(e[d <= 3 * 1.4826 * np.median(d) + 1e-12]))


def clipped_medians(own: DataFrame) -> DataFrame:
    """The same for all cells, of which a task need not hold one."""
    near = R.about_median(materialize(own, "cells"), ["cell"], "e").where(F.abs(C("e") - C("m")) <= 3 * 1.4826 * C("s") + 1e-12)
    return R.medians(materialize(near.select("cell", "e"), "cells"), ["cell"], "e", "e")


class Pixels:
    """The pixels of many stars in one piece: ``owner`` is the star of each, ``first`` the first of each star."""

    def __init__(self, counts: np.ndarray, py: np.ndarray, px: np.ndarray, v: np.ndarray):
        self.owner, self.first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        self.counts, self.py, self.px, self.v = counts, py, px, v

    @staticmethod
    def of(part: pd.DataFrame, radius: int) -> Pixels:
        """Those of the stamps around the stars' rounded places."""
        counts = part["v"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(counts)), counts)
        iy, ix, v = (np.concatenate(part[c].to_list()) for c in ("iy", "ix", "v"))
        at = Pixels(counts, part["ay"].to_numpy()[owner] + iy.astype(float), part["ax"].to_numpy()[owner] + ix.astype(float), v.astype(float))
        near = lambda place, c: abs(place - np.rint(part[c].to_numpy(float))[owner]) <= radius
        return at.where(near(at.py, "y") & near(at.px, "x"))

    def where(self, kept: np.ndarray) -> Pixels:
        return Pixels(np.bincount(self.owner[kept], minlength=len(self.counts)), self.py[kept], self.px[kept], self.v[kept])

    def of_stars(self, chosen: np.ndarray) -> Pixels:
        """The pixels of some stars, which are numbered anew."""
        kept = chosen[self.owner]
        return Pixels(self.counts[chosen], self.py[kept], self.px[kept], self.v[kept])


def projecting(grid: np.ndarray, half: int, oversample: int):
    """A function of stars that gives, for each pixel on the grid, its ``cell`` and what its share of the star's light has beyond the last grid."""
    side, mid = len(grid), half * oversample

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.iloc[a : a + 2048]
                p = Pixels.of(part, half)
                y, x, flux, bkg = (part[c].to_numpy(float)[p.owner] for c in ("y", "x", "flux", "bkg"))
                dy, dx = (p.py - y) * oversample, (p.px - x) * oversample
                with np.errstate(divide="ignore", invalid="ignore"):
                    e = (p.v - bkg) / flux - bicubic(grid, dy + mid, dx + mid)
                cy, cx = nearest(dy), nearest(dx)
                on = (abs(cy) <= mid) & (abs(cx) <= mid) & np.isfinite(e)
                yield pd.DataFrame({"cell": ((cy + mid) * side + cx + mid)[on].astype(int), "e": e[on]})

    return project


def nearest(a: np.ndarray) -> np.ndarray:
    """Rounded, halves away from 0."""
    return np.trunc(a) + np.sign(a) * (abs(a - np.trunc(a)) >= 0.5)


def placing(grid: np.ndarray, half: int, oversample: int, pixels: bool):
    """A function of stars that fits their positions, fluxes and backgrounds against the grid, by the pixels at most ``half - 1`` away; a star without any is left out."""
    columns = ["y", "x", "flux", "bkg"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.iloc[a : a + 512]
                p = Pixels.of(part, half)
                y, x = (part[c].to_numpy(float)[p.owner] for c in ("y", "x"))
                p = p.where((abs(p.py - y) <= half - 1) & (abs(p.px - x) <= half - 1))
                some = p.counts > 0
                part, p = part[some], p.of_stars(some)
                start = part[columns].to_numpy(float)
                got = placed(grid, oversample, start, p)
                with np.errstate(invalid="ignore"):
                    good = np.isfinite(got).all(1) & (np.hypot(got[:, 0] - start[:, 0], got[:, 1] - start[:, 1]) < 1.0) & (got[:, 2] > 0)
                out = part.copy()
                out[columns] = np.where(good[:, None], got, start)
                yield out if pixels else out[["id", *columns]]

    return place


def placed(grid: np.ndarray, oversample: int, start: np.ndarray, pixels: Pixels, rounds: int = 20) -> np.ndarray:
    """``y, x, flux, bkg`` of many stars, each by the steps of ``fit.least_squares``, with exact slopes."""
    mid = len(grid) // 2

    def linear(p: np.ndarray, at: Pixels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cost, normal matrix and gradient of each star."""
        y, x, flux, bkg = p[at.owner].T
        b, by, bx = sloped(grid, (at.py - y) * oversample + mid, (at.px - x) * oversample + mid)
        r = at.v - bkg - flux * b
        j = [-oversample * flux * by, -oversample * flux * bx, b, np.ones(len(b))]
        add = lambda c: np.add.reduceat(c, at.first)
        a = np.empty((len(p), 4, 4))
        for m in range(4):
            for k in range(m + 1):
                a[:, m, k] = a[:, k, m] = add(j[m] * j[k])
        return add(r * r), a, np.stack([add(c * r) for c in j], axis=1)

    def solved(a: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Solutions, and which matrices are positive definite; the others' solutions are 0."""
        sound = np.isfinite(a).all((1, 2)) & np.isfinite(g).all(1)
        a, g = np.where(sound[:, None, None], a, np.eye(4)), np.where(sound[:, None], g, 0.0)
        try:
            np.linalg.cholesky(a)
            return np.linalg.solve(a, g[:, :, None])[:, :, 0], sound
        except np.linalg.LinAlgError:
            if len(a) == 1:
                return np.zeros_like(g), np.zeros(1, bool)
        halves = [solved(a[k], g[k]) for k in (slice(len(a) // 2), slice(len(a) // 2, None))]
        return np.concatenate([h[0] for h in halves]), sound & np.concatenate([h[1] for h in halves])

    p = start.copy()
    fit = np.flatnonzero(np.isfinite(start).all(1))  # the stars that are still moving
    if not len(fit):
        return p
    chosen = np.isfinite(start).all(1)
    at = pixels.of_stars(chosen)
    q, damp = p[fit], np.full(len(fit), 1e-4)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        cost, a, g = linear(q, at)
        for _ in range(rounds):
            done = abs(g).max(1) < 1e-10 * np.maximum(cost, 1e-30)
            scale = np.maximum(np.einsum("nkk->nk", a), 1e-6)
            step, sound = solved(a + damp[:, None, None] * scale[:, :, None] * np.eye(4), g)
            new = q + step
            cost2, a2, g2 = linear(new, at)
            better = ~done & sound & np.isfinite(cost2) & (cost2 < cost)
            small = (abs(step).max(1) < 1e-8 * np.maximum(1.0, abs(q).max(1))) | (cost - cost2 < 1e-8 * cost)
            damp = np.where(better, np.maximum(damp / 10, 1e-12), np.where(sound, damp * 10, np.minimum(damp * 10, 1e12)))
            done |= np.where(better, small, sound & (damp > 1e12))
            q, cost = np.where(better[:, None], new, q), np.where(better, cost2, cost)
            a, g = np.where(better[:, None, None], a2, a), np.where(better[:, None], g2, g)
            p[fit] = q
            if done.all():
                break
            if done.any():
                at, fit, q, damp, cost, a, g = at.of_stars(~done), fit[~done], q[~done], damp[~done], cost[~done], a[~done], g[~done]
        q, at = p[chosen], pixels.of_stars(chosen)
        cost, a, g = linear(q, at)
        step, sound = solved(a, g)  # a last step without damping
        cost2 = linear(q + step, at)[0]
        p[chosen] = np.where((sound & (cost2 < cost))[:, None], q + step, q)
    return p


def exponential_disk_kernel(scale: float, size: int = 5, step: int = 11) -> np.ndarray:
    """Pixel-integrated circular exponential profile of unit sum, by sub-pixels."""
    k = (np.arange(size * step) + 0.5) / step - size / 2
    fine = np.exp(-np.hypot(k[:, None], k[None, :]) / scale)
    out = fine.reshape(size, step, size, step).sum((1, 3))
    return out / out.sum()


def pixel_response(n: int) -> np.ndarray:
    """One-dimensional box response of a pixel cut in ``n`` parts, odd length, unit sum; ends of an even n count half."""
    if n < 1:
        raise ValueError("n must be positive")
    if n % 2:
        return np.full(n, 1.0 / n)
    out = np.full(n + 1, 1.0 / n)
    out[[0, -1]] /= 2
    return out
