"""Moments with all sums that their errors need, errors of shapes, and weighted centroids of 3 x 3 patches.

Every moment is linear in the pixels, so covariances of moments are sums of the window's square over the inverse variance, to fourth order.
A statistic's error is the quadratic form of its gradient in them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import debiased_square, deconvolved, nan, ratio
from ..shared import ship
from .coadd import step
from .measure import on_image

C = F.col
ORDERS = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
HIGHER = [(3, 0), (0, 3), (2, 1), (1, 2), (4, 0), (0, 4), (3, 1), (1, 3), (2, 2)]


def _power(base: Column, n: int) -> Column:
    return F.lit(1.0) if not n else base if n == 1 else _power(base, n - 1) * base


def windowed_moments(sources: DataFrame, image: DataFrame, radius: int, background: float = 0.0, window: float | None = None) -> DataFrame:
    """``id``, moments ``m00`` to ``m11`` of the light (weighted by the inverse variance ``iv``), ``w00`` to ``w22``, and aperture sums.

    A Gaussian ``window`` of that deviation tapers the weights about the source's position. ``w_pq`` is the covariance of moments whose orders sum to
    p, q. Light is signed; pixels without a positive inverse variance take no part. The aperture's sum, area and error are neither weighted nor tapered.
    """
    dy, dx, iv = C("dy"), C("dx"), C("iv")
    g = F.exp(-(dy * dy + dx * dx) / (2 * window * window)) if window else F.lit(1.0)
    met = step(on_image(sources, image, radius).where((iv > 0) & (iv < math.inf) & ~F.isnan("v")), z=C("v") - background, u=iv * g, t=iv * g * g)
    light = [F.sum(C("u") * C("z") * _power(dy, p) * _power(dx, q)).alias(f"m{p}{q}") for p, q in ORDERS]
    weights = [F.sum(C("t") * _power(dy, p) * _power(dx, q)).alias(f"w{p}{q}") for p, q in ORDERS + HIGHER]
    return met.groupBy("id").agg(*light, *weights, F.sum("z").alias("aperture_sum"), F.count("*").alias("aperture_area"), F.sqrt(F.sum(1 / iv)).alias("aperture_err"))


def shape_errors(m: DataFrame, window: float | None = None) -> DataFrame:
    """``id``, the moments without the window, ``ellipticity1``, ``ellipticity2``, ``compactness`` with errors, their covariance ``c12``, and ``ellipticity_sq`` without its noise.

    NaN where the light or the moments' total is not positive. A moment below 0 counts as 0, and its error is that about 0.
    The window's inverse variance k is taken off as (m^-1 - k)^-1; with A = (1 - k m)^-1 a change of m arrives as A dm A.
    """
    k = 0.0 if window is None else 1 / (window * window)
    at = lambda c: ratio(C(c), F.when(C("m00") > 0, C("m00")).otherwise(F.lit(0.0)))
    m = step(m, uy=at("m10"), ux=at("m01"), ryy=at("m20"), rxx=at("m02"), rxy=at("m11"))
    m = step(m, m_yy=F.greatest(C("ryy") - C("uy") * C("uy"), F.lit(0.0)), m_xx=F.greatest(C("rxx") - C("ux") * C("ux"), F.lit(0.0)), m_xy=C("rxy") - C("uy") * C("ux"))
    s = deconvolved(C("m_yy"), C("m_xx"), C("m_xy"), k) if k else (C("m_yy"), C("m_xx"), C("m_xy"))
    m = step(m, s_yy=s[0], s_xx=s[1], s_xy=s[2], q=(1 - k * C("m_yy")) * (1 - k * C("m_xx")) - k * k * C("m_xy") * C("m_xy"))
    m = step(m, total=F.when(C("s_yy") + C("s_xx") > 0, C("s_yy") + C("s_xx")).otherwise(nan()), a_yy=ratio(1 - k * C("m_xx"), C("q")), a_xx=ratio(1 - k * C("m_yy"), C("q")), a_xy=ratio(k * C("m_xy"), C("q")))
    m = step(m, ellipticity1=(C("s_yy") - C("s_xx")) / C("total"), ellipticity2=2 * C("s_xy") / C("total"), compactness=1 / C("total"))
    # gradients of the statistics by s, as symmetric matrices (yy, xx, and half of xy)
    one = 1 / C("total")
    slopes = {"1": (one * (1 - C("ellipticity1")), -one * (1 + C("ellipticity1")), F.lit(0.0)), "2": (-one * C("ellipticity2"), -one * C("ellipticity2"), one), "c": (-one * one, -one * one, F.lit(0.0))}
    m = step(m, **{f"t{n}{a}": v for n, t in slopes.items() for a, v in zip(("yy", "xx", "xy"), t)})
    moved = {}
    for n in slopes:
        yy, xx, xy = (C(f"t{n}{a}") for a in ("yy", "xx", "xy"))
        p, r, q = C("a_yy"), C("a_xx"), C("a_xy")
        moved |= {f"b{n}yy": p * p * yy + 2 * p * q * xy + q * q * xx, f"b{n}xx": q * q * yy + 2 * q * r * xy + r * r * xx, f"b{n}xy": 2 * (p * q * yy + (p * r + q * q) * xy + q * r * xx)}
    m = step(m, **moved)
    # the influence of a pixel at (dy, dx) as a polynomial in its place
    influence = {}
    for n in slopes:
        yy, xx, xy = (C(f"b{n}{a}") for a in ("yy", "xx", "xy"))
        uy, ux = C("uy"), C("ux")
        parts = [yy * (uy * uy - C("m_yy")) + xx * (ux * ux - C("m_xx")) + xy * (uy * ux - C("m_xy")), -2 * uy * yy - ux * xy, -2 * ux * xx - uy * xy, yy, xx, xy]
        influence |= {f"i{n}_{p}{q}": v / C("m00") for (p, q), v in zip(ORDERS, parts)}
    m = step(m, **influence)

    def form(a: str, b: str) -> Column:
        terms = [C(f"i{a}_{p}{q}") * C(f"i{b}_{r}{t}") * C(f"w{p + r}{q + t}") for p, q in ORDERS for r, t in ORDERS]
        return sum(terms[1:], terms[0])

    positive = lambda v: F.when(F.isnan(v), v).otherwise(F.greatest(v, F.lit(0.0)))
    m = step(m, v1=form("1", "1"), v2=form("2", "2"), c12=form("1", "2"), vc=form("c", "c"))
    m = m.withColumns({n: positive(C(n)) for n in ("v1", "v2", "vc")})
    value, err = debiased_square(C("ellipticity1"), C("ellipticity2"), C("v1"), C("v2"), C("c12"))
    return m.select("id", "s_yy", "s_xx", "s_xy", "ellipticity1", F.sqrt("v1").alias("ellipticity1_err"), "ellipticity2", F.sqrt("v2").alias("ellipticity2_err"), "c12", "compactness", F.sqrt("vc").alias("compactness_err"), value.alias("ellipticity_sq"), err.alias("ellipticity_sq_err"))


CENTROIDS = "y, x, peak, y_err, x_err, peak_err, curvature, curvature_err, com_y, com_x, com_y_err, com_x_err".split(", ")


def quadratic_peaks(z: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Peaks of weighted quadratics and centres of mass of many patches (n, 9), rows first, relative to their middle pixels; NaN where not determined.

    The basis 1, y, x, y^2/2, x^2/2, xy makes coefficients the value, gradient and Hessian at the middle. Errors follow from how the stationary
    point moves: H ds = -dg - dH s.
    """
    dy, dx = (a.ravel().astype(float) for a in np.mgrid[-1:2, -1:2])
    basis = np.stack([np.ones(9), dy, dx, dy * dy / 2, dx * dx / 2, dy * dx], axis=1)
    w = np.where(np.isfinite(w) & (w > 0) & np.isfinite(z), w, 0.0)
    z = np.where(w > 0, z, 0.0)
    normal = np.einsum("np,pa,pb->nab", w, basis, basis)
    sound = np.linalg.eigvalsh(normal)[:, 0] > 1e-9 * np.einsum("naa->n", normal)
    cov = np.full(normal.shape, math.nan)
    cov[sound] = np.linalg.inv(normal[sound])
    c = np.einsum("nab,nb->na", cov, np.einsum("np,pa->na", w * z, basis))
    hess = np.stack([c[:, [3, 5]], c[:, [5, 4]]], axis=1)
    det = hess[:, 0, 0] * hess[:, 1, 1] - hess[:, 0, 1] ** 2
    curved = sound & (abs(det) > 1e-12 * (hess**2).sum((1, 2)))
    inverse = np.full(hess.shape, math.nan)
    inverse[curved] = np.linalg.inv(hess[curved])
    s = -np.einsum("nab,nb->na", inverse, c[:, 1:3])
    peak = c[:, 0] + (c[:, 1:3] * s).sum(1) / 2
    at = np.stack([np.ones(len(s)), s[:, 0], s[:, 1], s[:, 0] ** 2 / 2, s[:, 1] ** 2 / 2, s[:, 0] * s[:, 1]], axis=1)
    push = np.zeros((len(s), 2, 6))  # how each coefficient changes the gradient at the peak
    push[:, 0, 1] = push[:, 1, 2] = 1
    push[:, 0, 3], push[:, 0, 5], push[:, 1, 4], push[:, 1, 5] = s[:, 0], s[:, 1], s[:, 1], s[:, 0]
    move = -inverse @ push
    bend, size = -(c[:, 3] + c[:, 4]), np.maximum(abs(peak), np.finfo(float).eps)
    by_bend = -(bend * np.sign(peak) / size**2)[:, None] * at
    by_bend[:, 3:5] -= (1 / size)[:, None]
    err = lambda g: np.sqrt(np.maximum(np.einsum("na,nab,nb->n", g, cov, g), 0))
    mass, wz = (w * z).sum(1), w * z
    ok = mass > 0
    centre = [np.where(ok, (wz * d).sum(1) / np.where(ok, mass, 1), math.nan) for d in (dy, dx)]
    lean = [np.where(ok, np.sqrt((w * (d - m[:, None]) ** 2).sum(1)) / np.where(ok, mass, 1), math.nan) for d, m in zip((dy, dx), centre)]
    return dict(zip(CENTROIDS, (s[:, 0], s[:, 1], peak, err(move[:, 0]), err(move[:, 1]), err(at), bend / size, err(by_bend), *centre, *lean)))


def weighted_centroids(patches: DataFrame, background: float = 0.0) -> DataFrame:
    """``patches`` (``y, x``, and ``z, iv``: arrays of three rows of three) with the columns ``CENTROIDS`` under ``fit_``, positions absolute, and the chosen ``yc, xc, source``."""
    ship(patches.sparkSession)
    keep = [c for c in patches.columns if c not in ("z", "iv")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema.fields if f.name in keep)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = lambda c: np.array([[math.nan if v is None else v for row in a for v in row] for a in b[c]], float).reshape(len(b), 9)  # noqa: B023, E731
            yield b[keep].assign(**{f"fit_{n}": v for n, v in quadratic_peaks(flat("z") - background, flat("iv")).items()})

    out = patches.mapInPandas(fit, f"{kinds}, " + ", ".join(f"fit_{n} double" for n in CENTROIDS))
    for n in ("y", "x"):
        out = out.withColumns({f"fit_{n}": C(f"fit_{n}") + C(n), f"fit_com_{n}": C(f"fit_com_{n}") + C(n)})
    return choose(out.withColumn("fit_peak", C("fit_peak") + background))


def choose(fits: DataFrame, worse: float = 100.0) -> DataFrame:
    """``yc, xc, source``: the quadratic's peak, or the centre of mass where the peak is undetermined or its variance ``worse`` times that of the centre of mass."""
    finite = lambda *names: F.forall(F.array(*[C(f"fit_{n}") for n in names]), lambda v: ~F.isnan(v) & (F.abs(v) < math.inf))
    poly = finite("y", "x", "y_err", "x_err") & (C("fit_y_err") > 0) & (C("fit_x_err") > 0)
    com = finite("com_y", "com_x", "com_y_err", "com_x_err")
    far = lambda n: C(f"fit_{n}_err") * C(f"fit_{n}_err") > worse * F.greatest(C(f"fit_com_{n}_err") * C(f"fit_com_{n}_err"), F.lit(2.0**-52))
    mass = com & (~poly | far("y") | far("x"))
    return fits.withColumns({"source": F.when(mass, "com").otherwise("poly"), "yc": F.when(mass, C("fit_com_y")).otherwise(C("fit_y")), "xc": F.when(mass, C("fit_com_x")).otherwise(C("fit_x"))})
