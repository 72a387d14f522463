"""Covariance of the background left in a residual image, by mesh cell and lag, and its part in the errors of fits.

The model of a cell is a A(lag) + b exp(-lag^2 / 2 l^2): A is the autocorrelation of the profile, which unresolved sources leave, the rest
smooth structure. Lag sums are made in tiles with a margin, so pixels are not multiplied by lags; windows of cells,
the fit and the table are DataFrame operations over one row for each cell and lag.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import nnls2
from ..shared import materialize, ship, shuffled
from .joint import tiles_of
from .measure import on_image
from .sparse_fit import gaussian_profile

C = F.col
CELL = ["ci", "cj"]


def gaussian_acf(fwhm: float) -> Callable[[Column, Column], Column]:
    """Autocorrelation of a Gaussian profile, 1 at lag 0."""
    k = 2 * math.log(2) / (fwhm * fwhm)
    return lambda dy, dx: F.exp(-k * (dy * dy + dx * dx))


def fitted_lags(reach: int) -> list[tuple[int, int]]:
    """Lags along the axes and diagonals, one of each pair of opposite ones: a radial model needs no more."""
    steps = range(1, reach + 1)
    return [(0, 0), *[(d, 0) for d in steps], *[(0, d) for d in steps], *[(d, d) for d in steps], *[(d, -d) for d in steps]]


def lag_sums(pixels: DataFrame, box: int, reach: int) -> DataFrame:
    """``ci, cj, dy, dx``: for each cell of ``box`` pixels and lag the sums over pixel pairs that start in the cell: products ``s``, first and second values ``a1, a2``, pairs ``np``; and the cell's ``sr, nv, nn``, sums of values, pixels and noise variances.

    ``pixels`` has ``y, x, r, iv, valid``. Values that are not finite, and pixels without a positive inverse variance, are not valid.
    """
    ship(pixels.sparkSession)
    core = box * max(1, 128 // box)
    lags = fitted_lags(reach)
    good = C("valid") & ~F.isnan("r") & (F.abs("r") < math.inf) & (C("iv") > 0) & (C("iv") < math.inf)
    rows = tiles_of(pixels.where(good).select("y", "x", "r", "iv"), core, reach).select("ty", "tx", "y", "x", "r", "iv")

    def tile(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        y, x = p["y"].to_numpy() - 1 - key[0] * core + reach, p["x"].to_numpy() - 1 - key[1] * core + reach
        value, there, noise = (np.zeros((core + 2 * reach, core + 2 * reach)) for _ in range(3))
        value[y, x], there[y, x], noise[y, x] = p["r"], 1.0, 1 / p["iv"]
        inner = (slice(reach, reach + core),) * 2
        by_cell = lambda a: a.reshape(core // box, box, core // box, box).sum((1, 3)).ravel()
        v, t = value[inner], there[inner]
        once = [by_cell(v), by_cell(t), by_cell(noise[inner])]
        ci, cj = (a.ravel() for a in np.indices((core // box, core // box)))
        out = []
        for dy, dx in lags:
            other = (slice(reach + dy, reach + dy + core), slice(reach + dx, reach + dx + core))
            sums = [by_cell(v * value[other]), by_cell(v * there[other]), by_cell(t * value[other]), by_cell(t * there[other])]
            out.append(pd.DataFrame(dict(zip(("ci", "cj", "dy", "dx", "s", "a1", "a2", "np", "sr", "nv", "nn"), (ci + key[0] * (core // box), cj + key[1] * (core // box), dy, dx, *sums, *once)))))
        found = pd.concat(out)
        return found[found["nv"] > 0]

    return rows.groupBy("ty", "tx").applyInPandas(tile, "ci long, cj long, dy int, dx int, s double, a1 double, a2 double, np double, sr double, nv double, nn double")


def cell_covariances(pixels: DataFrame, box: int, reach: int, acf: Callable[[Column, Column], Column], half_width: float | None = None, lengths: list[float] | None = None) -> DataFrame:
    """``ci, cj, a, b, ell`` of each cell (from 0) with a valid pixel in its window of cells within ``half_width``.

    The window's mean is taken off, and its mean noise variance off lag 0. The lengths are tried in turn, by default 2 ``reach`` times 1/3 to 16/3.
    A cell whose window lacks pairs at some lag has a = b = 0.
    """
    lengths = lengths or [2 * reach * f for f in (1 / 3, 2 / 3, 4 / 3, 8 / 3, 16 / 3)]
    k = max(1, math.ceil(((half_width or 1.5 * box) - box / 2) / box))
    sums = materialize(lag_sums(pixels, box, reach), "lag-sums")
    cells = sums.where("dy = 0 AND dx = 0").select(*CELL)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-k, k + 1) for j in range(-k, k + 1)])
    last = cells.agg(F.max("ci").alias("_i"), F.max("cj").alias("_j"))
    near = sums.select("*", F.inline(around)).withColumns({"ci": C("ci") + C("i"), "cj": C("cj") + C("j")})
    near = near.join(F.broadcast(last)).where("ci BETWEEN 0 AND _i AND cj BETWEEN 0 AND _j")  # one row with the mesh's size
    w = near.groupBy(*CELL, "dy", "dx").agg(*[F.sum(c).alias(c) for c in ("s", "a1", "a2", "np", "sr", "nv", "nn")])
    mean = C("sr") / C("nv")
    excess = (C("s") - mean * (C("a1") + C("a2")) + C("np") * mean * mean) / F.when(C("np") > 0, C("np"))
    cov = w.select(*CELL, "dy", "dx", (excess - F.when((C("dy") == 0) & (C("dx") == 0), C("nn") / C("nv")).otherwise(0.0)).alias("c"))
    r2 = (C("dy") * C("dy") + C("dx") * C("dx")).cast("double")
    terms = cov.select(*CELL, "c", acf(C("dy").cast("double"), C("dx").cast("double")).alias("u"), r2.alias("r2"), F.explode(F.array(*map(F.lit, lengths))).alias("ell"))
    terms = terms.withColumn("v", F.exp(-C("r2") / (2 * C("ell") * C("ell"))))
    pairs = {"uu": ("u", "u"), "uv": ("u", "v"), "vv": ("v", "v"), "uc": ("u", "c"), "vc": ("v", "c"), "cc": ("c", "c")}
    n = terms.groupBy(*CELL, "ell").agg(F.count("c").alias("n"), *[F.sum(C(p) * C(q)).alias(m) for m, (p, q) in pairs.items()])
    a, b, res = nnls2(*[C(m) for m in pairs])
    whole = C("n") == len(fitted_lags(reach))
    fits = n.select(*CELL, "ell", *[F.when(whole, v).otherwise(0.0).alias(m) for m, v in (("a", a), ("b", b), ("res", res))])
    best = fits.groupBy(*CELL).agg(F.min(F.struct("res", "ell", "a", "b")).alias("m"))
    return best.select(*CELL, "m.a", "m.b", "m.ell")


def covariance_table(models: DataFrame, reach: int, acf: Callable[[Column, Column], Column], keys: list[str] = CELL) -> DataFrame:
    """``keys, dy, dx, cov`` for each row of ``models`` (``a, b, ell``: cells, or sources with their cell's) and every lag up to ``reach`` along each axis, which may exceed the fitted range."""
    side = F.sequence(F.lit(-reach), F.lit(reach))
    lags = models.select(*keys, "a", "b", "ell", F.explode(side).alias("dy")).select("*", F.explode(side).alias("dx"))
    dy, dx = C("dy").cast("double"), C("dx").cast("double")
    return lags.select(*keys, "dy", "dx", (C("a") * acf(dy, dx) + C("b") * F.exp(-(dy * dy + dx * dx) / (2 * C("ell") * C("ell")))).alias("cov"))


def cell_of(sources: DataFrame, cells: DataFrame, box: int) -> DataFrame:
    """``sources`` with the model (``a, b, ell``) of the cell of their nearest pixel, moved to the mesh's edge where they lie beyond it."""
    last = cells.agg(F.max("ci").alias("_i"), F.max("cj").alias("_j"))
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.floor((F.rint(c) - 1) / box).cast("long"), C(most)))
    placed = sources.join(F.broadcast(last)).withColumns({"ci": at("y", "_i"), "cj": at("x", "_j")}).drop("_i", "_j")
    return placed.join(cells, CELL, "left")


def correlated_steps(sources: DataFrame, residual: DataFrame, fwhm: float, radius: int, cap: float = 0.5) -> DataFrame:
    """``id, y, x, flux`` after one step that knows the background's covariance, and ``y_var, x_var, flux_var``, by which it raises the variances.

    ``sources`` has ``id, y, x, flux, a, b, ell``; ``residual`` ``y, x, v, iv``, the image less all models. In whitened pixels of the stamp the
    covariance is 1 + W^1/2 B W^1/2. A source whose system is not positive definite, or that has no usable model, keeps its values.
    """
    ship(residual.sparkSession)
    given = sources.select("id", C("y").alias("y0"), C("x").alias("x0"), "flux", "a", "b", "ell")
    stamps = on_image(sources.select("id", "y", "x", "flux"), residual.where("iv > 0"), radius).groupBy("id").agg(F.collect_list(F.struct("py", "px", "v", "iv")).alias("pixels"))
    profile, k = gaussian_profile(fwhm), 2 * math.log(2) / (fwhm * fwhm)

    def one(y: float, x: float, flux: float, a: float, b: float, ell: float, pixels: list) -> tuple[float, ...]:
        py, px, v, iv = np.array([tuple(p) if not isinstance(p, dict) else (p["py"], p["px"], p["v"], p["iv"]) for p in pixels], float).T
        g, gy, gx = profile(py - y, px - x)
        root = np.sqrt(iv)
        j = np.stack([flux * gy, flux * gx, g], axis=1) * root[:, None]
        d2 = (py[:, None] - py) ** 2 + (px[:, None] - px) ** 2
        white = np.eye(len(py)) + root[:, None] * (a * np.exp(-k * d2) + b * np.exp(-d2 / (2 * ell * ell))) * root
        low = np.linalg.cholesky(white)
        jw, rw = np.linalg.solve(low, j), np.linalg.solve(low, v * root)
        scale = np.sqrt((j * j).sum(0))
        full, plain = np.linalg.inv((jw / scale).T @ (jw / scale)), np.linalg.inv((j / scale).T @ (j / scale))
        step = full @ (jw / scale).T @ rw / scale
        more = np.diag(full - plain) / scale**2
        if not (np.isfinite(step).all() and np.isfinite(more).all()):
            raise np.linalg.LinAlgError
        return (*np.clip(step[:2], -cap, cap), step[2], *np.maximum(more, 0))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    s = one(r.y0, r.x0, r.flux, r.a, r.b, r.ell, r.pixels)
                except np.linalg.LinAlgError:
                    s = (0.0,) * 6
                rows.append((r.id, r.y0 + s[0], r.x0 + s[1], r.flux + s[2], *s[3:]))
            yield pd.DataFrame(rows, columns=["id", "y", "x", "flux", "y_var", "x_var", "flux_var"])

    kind = sources.schema["id"].dataType.simpleString()
    known = given.fillna(0.0, ["a", "b"]).fillna(1.0, ["ell"]).join(shuffled(stamps), "id")
    return known.mapInPandas(steps, f"id {kind}, y double, x double, flux double, y_var double, x_var double, flux_var double")
