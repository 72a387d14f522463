"""Per-source nonlinear fits: damped least squares on bounded stamps, one group for each source.

Spark joins sources with their pixels and deals them out; numpy solves a group of at most
(2R+1)^2 pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship
from .measure import on_image

K = 4 * math.log(2)


def erf(x: np.ndarray) -> np.ndarray:
    """Error function: series near zero, continued fraction of its complement beyond."""
    x = np.asarray(x, float)
    a = np.minimum(abs(x), 6.0)
    term = total = a.copy()
    for n in range(1, 60):
        term = term * (-a * a) / n
        total = total + term / (2 * n + 1)
    near = 2 / math.sqrt(math.pi) * total
    frac = np.zeros_like(a)
    safe = np.maximum(a, 1.5)
    for n in range(60, 0, -1):
        frac = n / 2 / (safe + frac)
    far = 1 - np.exp(-safe * safe) / math.sqrt(math.pi) / (safe + frac)
    return np.sign(x) * np.where(a < 2.5, near, far)


def bessel_j1(x: np.ndarray, nodes: int = 400) -> np.ndarray:
    """Bessel function of order one by its integral over half a period (trapezoid: exact for a periodic integrand)."""
    t = (np.arange(nodes) + 0.5) * math.pi / nodes
    return np.cos(t[None, :] - np.asarray(x, float).reshape(-1, 1) * np.sin(t)[None, :]).mean(1).reshape(np.shape(x))


def gaussian(p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(y, x, fwhm, flux, bkg): sampled circular Gaussian."""
    return p[4] + p[3] * K / (math.pi * p[2] ** 2) * np.exp(-K * ((y - p[0]) ** 2 + (x - p[1]) ** 2) / p[2] ** 2)


def gaussian_integrated(p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(y, x, fwhm, flux, bkg): circular Gaussian integrated over each pixel."""
    s = p[2] / math.sqrt(K)
    side = lambda a, c: 0.5 * (erf((a + 0.5 - c) / s) - erf((a - 0.5 - c) / s))
    return p[4] + p[3] * side(y, p[0]) * side(x, p[1])


def elliptical(p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(y, x, y_fwhm, x_fwhm, theta, flux, bkg): sampled Gaussian turned by theta degrees."""
    c, s = math.cos(math.radians(p[4])), math.sin(math.radians(p[4]))
    u, w = (x - p[1]) * c + (y - p[0]) * s, (y - p[0]) * c - (x - p[1]) * s
    return p[6] + p[5] * K / (math.pi * p[2] * p[3]) * np.exp(-K * (u * u / p[3] ** 2 + w * w / p[2] ** 2))


def moffat(p: np.ndarray, y: np.ndarray, x: np.ndarray, beta: float = 2.5) -> np.ndarray:
    """(y, x, fwhm, flux, bkg): circular Moffat profile."""
    a2 = (p[2] / 2) ** 2 / (2 ** (1 / beta) - 1)
    return p[4] + p[3] * (beta - 1) / (math.pi * a2) * (1 + ((y - p[0]) ** 2 + (x - p[1]) ** 2) / a2) ** -beta


def airy(p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(y, x, fwhm, flux, bkg): Airy profile of unit flux before scaling."""
    k = 2 * 1.616339948310703 / p[2]
    z = k * np.hypot(y - p[0], x - p[1])
    core = np.where(z < 1e-6, 0.5, bessel_j1(z) / np.maximum(z, 1e-6))
    return p[4] + p[3] * k * k / math.pi * core**2


MODELS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "gaussian": (gaussian, ("y", "x", "fwhm", "flux", "bkg")),
    "gaussian_integrated": (gaussian_integrated, ("y", "x", "fwhm", "flux", "bkg")),
    "moffat": (moffat, ("y", "x", "fwhm", "flux", "bkg")),
    "airy": (airy, ("y", "x", "fwhm", "flux", "bkg")),
    "elliptical": (elliptical, ("y", "x", "y_fwhm", "x_fwhm", "theta", "flux", "bkg")),
}


@dataclass
class Result:
    """What a fit found; the covariance is NaN where the normal matrix is not positive definite."""

    p: np.ndarray
    cost: float
    converged: bool
    rounds: int
    cov: np.ndarray
    sigma: float


def jacobian(f: Callable[[np.ndarray], np.ndarray], p: np.ndarray) -> np.ndarray:
    """Central differences."""
    out = []
    for k in range(len(p)):
        h = 1e-5 * max(1.0, abs(p[k]))
        e = np.zeros_like(p)
        e[k] = h
        out.append((f(p + e) - f(p - e)) / (2 * h))
    return np.stack(out, axis=1)


def tukey_weight(r: np.ndarray, c: float = 4.685) -> np.ndarray:
    return np.where(abs(r) <= c, (1 - (r / c) ** 2) ** 2, 0.0)


def mad_scale(r: np.ndarray) -> float:
    return max(1.4826 * float(np.median(abs(r - np.median(r)))), 1e-12)


def least_squares(f: Callable[[np.ndarray], np.ndarray], data: np.ndarray, start: np.ndarray, weight: np.ndarray | None = None, robust: bool = False, rounds: int = 200, x_tol: float = 1e-8, f_tol: float = 1e-4, g_tol: float = 1e-4, slopes: Callable[[np.ndarray], np.ndarray] | None = None) -> Result:
    """Levenberg-Marquardt with Marquardt's scaling; ``robust`` reweights by Tukey's function of the scaled residuals.

    A damped matrix that is not positive definite raises the damping and costs a round. ``slopes`` gives the Jacobian; without it, differences do.
    """
    slopes = slopes or (lambda p: jacobian(f, p))
    base = np.ones_like(data) if weight is None else weight
    p, damp = start.astype(float), 1e-4
    r = data - f(p)
    sigma = math.sqrt(1 / max(float(base.mean()), 1e-300)) if weight is not None else mad_scale(r)
    w = base * tukey_weight(r / sigma) if robust else base
    cost, done, n = float((w * r * r).sum()), False, 0
    while n < rounds and not done:
        n += 1
        j = slopes(p)
        a, g = (j * w[:, None]).T @ j, j.T @ (w * r)
        if abs(g).max(initial=0.0) < g_tol * max(cost, 1e-30) * 1e-6:
            done = True
            break
        try:
            step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-6)), g)
            np.linalg.cholesky(a + damp * np.diag(np.maximum(np.diag(a), 1e-6)))
        except np.linalg.LinAlgError:
            damp = min(damp * 10, 1e12)
            continue
        new = p + step
        r_new = data - f(new)
        cost_new = float((w * r_new * r_new).sum())
        if np.isfinite(cost_new) and cost_new < cost:
            small = abs(step).max() < x_tol * max(1.0, abs(p).max()) or cost - cost_new < f_tol * 1e-4 * cost
            p, r, damp = new, r_new, max(damp / 10, 1e-12)
            if robust:
                sigma = mad_scale(r) if weight is None else sigma
                w = base * tukey_weight(r / sigma)
                cost_new = float((w * r * r).sum())
            cost, done = cost_new, small
        else:
            damp *= 10
            done = damp > 1e12
    j = slopes(p)
    a = (j * w[:, None]).T @ j
    try:
        np.linalg.cholesky(a)
        cov = np.linalg.inv(a)
        if not robust:  # a last step without damping, exact where the model is linear
            last = p + cov @ (j.T @ (w * r))
            cost_last = float((w * (data - f(last)) ** 2).sum())
            if cost_last < cost:
                p, cost = last, cost_last
        if weight is None:
            cov = cov * cost / max(len(data) - len(p), 1)
    except np.linalg.LinAlgError:
        cov = np.full((len(p), len(p)), math.nan)
    return Result(p, cost, done, n, cov, sigma)


def by_group(rows: DataFrame, key: str, solve: Callable[[pd.DataFrame], tuple], schema: str, columns: list[str]) -> DataFrame:
    """``solve`` of each group's rows as one row: one shuffle, and a stream over the sorted groups, of which a task holds a batch and one more."""
    ship(rows.sparkSession)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            starts = np.flatnonzero((rest[key] != rest[key].shift()).to_numpy())
            if len(starts) > 1:
                yield solved(rest.iloc[: starts[-1]], starts[1:-1])
                rest = rest.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield solved(rest, [])

    def solved(part: pd.DataFrame, cuts) -> pd.DataFrame:
        ends = [0, *cuts, len(part)]
        return pd.DataFrame([solve(part.iloc[a:b]) for a, b in zip(ends, ends[1:], strict=False)], columns=columns)

    return rows.repartition(key).sortWithinPartitions(key).mapInPandas(stream, schema)


def fit_stars(sources: DataFrame, image: DataFrame, model="gaussian", radius: int = 5, fwhm: float = 3.0, weight: float | str | None = None, robust: bool = False, fixed: dict[str, float | None] | None = None) -> DataFrame:
    """``id``, fitted parameters, their errors, chi-square, rounds; starts at the sources' positions and fluxes.

    ``sources``: ``id, y, x, flux, bkg`` without null ids, which are skipped. ``model``: a name of ``MODELS``, or an object with ``names``,
    a call for values and perhaps ``slopes``. ``weight``: one inverse variance, or the image's column of them; pixels without a positive
    finite one take no part. ``fixed`` holds parameters at a value, or at the source's own where it is None; their error is 0.
    A source with no more pixels than free parameters gets nulls.
    """
    profile, names = MODELS[model] if isinstance(model, str) else (model, model.names)
    fixed = fixed or {}
    if unknown := set(fixed) - set(names):
        raise ValueError(f"the model has no parameter {', '.join(sorted(unknown))}")
    free = [k for k, n in enumerate(names) if n not in fixed]
    if not free:
        raise ValueError("all parameters are fixed")
    exact = getattr(profile, "slopes", None)
    by_pixel = isinstance(weight, str)
    inverse = [F.col(weight).cast("double").alias("iv")] if by_pixel else []
    met = on_image(sources.select("id", "y", "x", "flux", "bkg").where("id is not null"), image.select("y", "x", "v", *inverse), radius)
    met = met.select("id", "y", "x", "flux", "bkg", "py", "px", "v", *["iv"] * by_pixel).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if by_pixel:
        met = met.where((F.col("iv") > 0) & (F.col("iv") < math.inf))
    columns = ["id", *names, *[f"{n}_err" for n in names], "chisq", "rounds", "converged"]
    id_type = sources.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, " + ", ".join(f"{c} double" for c in columns[1:-2]) + ", rounds long, converged boolean"

    def solve(pdf: pd.DataFrame) -> tuple:
        first = pdf.iloc[0]
        given = {"y": first["y"], "x": first["x"], "flux": first["flux"], "bkg": first["bkg"], "fwhm": fwhm, "y_fwhm": fwhm, "x_fwhm": fwhm * 1.1, "theta": 0.0}
        start = np.array([given[n] if fixed.get(n) is None else fixed[n] for n in names], float)
        if len(pdf) <= len(free):
            return (first["id"], *[math.nan] * (2 * len(names) + 1), 0, False)
        y, x, v = (pdf[c].to_numpy(float) for c in ("py", "px", "v"))
        w = pdf["iv"].to_numpy(float) if by_pixel else None if weight is None else np.full(len(v), weight)

        def whole(q: np.ndarray) -> np.ndarray:
            p = start.copy()
            p[free] = q
            return p

        r = least_squares(lambda q: profile(whole(q), y, x), v, start[free], w, robust, slopes=exact and (lambda q: exact(whole(q), y, x)[:, free]))
        err = np.zeros(len(names))
        err[free] = np.sqrt(np.maximum(np.diag(r.cov), 0))
        return (first["id"], *whole(r.p), *err, r.cost / (len(v) - len(free)), r.rounds, r.converged)

    return by_group(met, "id", solve, schema, columns)
