"""Rendering, apertures, curves of growth, moments, centroids and fit diagnostics of sources on pixels.

A source meets its pixels by an equi-join: its stamp of (2R+1)^2 positions is unfolded around the
rounded position and joined with the image on (y, x), both sides sorted. Every statistic of a source is then one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import nan, ratio
from ..shared import ship, shuffled, spread

C = F.col
K = 4 * math.log(2)


def stamps(sources: DataFrame, radius: int) -> DataFrame:
    """Each source with the pixel positions ``py, px`` of its square stamp and their offsets ``dy, dx``."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    at = spread(sources).withColumns({"ay": F.rint("y").cast("long"), "ax": F.rint("x").cast("long")})
    rows = at.select("*", F.explode(span).alias("_i")).select("*", F.explode(span).alias("_j"))
    rows = rows.withColumns({"py": C("ay") + C("_i"), "px": C("ax") + C("_j")})
    return rows.withColumns({"dy": C("py") - C("y"), "dx": C("px") - C("x")}).drop("_i", "_j")


def gaussian(dy: Column, dx: Column, fwhm: float) -> Column:
    """Circular Gaussian of unit flux, sampled at the pixel centre."""
    return F.lit(K / (math.pi * fwhm * fwhm)) * F.exp(-K * (dy * dy + dx * dx) / (fwhm * fwhm))


def gaussian_gradient(dy: Column, dx: Column, fwhm: float, flux: Column) -> dict[str, Column]:
    """Derivatives of ``flux * gaussian`` by position, width and flux."""
    g = gaussian(dy, dx, fwhm)
    r2 = dy * dy + dx * dx
    return {"d_y": flux * g * 2 * K * dy / fwhm**2, "d_x": flux * g * 2 * K * dx / fwhm**2, "d_fwhm": flux * g * (2 * K * r2 / fwhm**3 - 2 / fwhm), "d_flux": g}


def elliptical_gaussian(dy: Column, dx: Column, y_fwhm: float, x_fwhm: float, theta: Column) -> Column:
    """Gaussian of unit flux whose x width is turned by ``theta`` degrees."""
    c, s = F.cos(F.radians(theta)), F.sin(F.radians(theta))
    u, w = dx * c + dy * s, dy * c - dx * s
    return F.lit(K / (math.pi * y_fwhm * x_fwhm)) * F.exp(-K * (u * u / x_fwhm**2 + w * w / y_fwhm**2))


def moffat(dy: Column, dx: Column, fwhm: float, beta: float) -> Column:
    """Circular Moffat profile of unit flux."""
    alpha2 = (fwhm / 2) ** 2 / (2 ** (1 / beta) - 1)
    return F.lit((beta - 1) / (math.pi * alpha2)) * F.pow(1 + (dy * dy + dx * dx) / alpha2, F.lit(-beta))


def elliptical_moffat(dy: Column, dx: Column, y_fwhm: float, x_fwhm: float, theta: Column, beta: float) -> Column:
    """Moffat profile of unit flux whose x width is turned by ``theta`` degrees."""
    c, s = F.cos(F.radians(theta)), F.sin(F.radians(theta))
    per_width = 4 * (2 ** (1 / beta) - 1)  # squared half widths to squared scales
    u2, w2 = (F.pow(v, F.lit(2.0)) * (per_width / f**2) for v, f in ((dx * c + dy * s, x_fwhm), (dy * c - dx * s, y_fwhm)))
    return F.lit((beta - 1) * per_width / (math.pi * y_fwhm * x_fwhm)) * F.pow(1 + u2 + w2, F.lit(-beta))


def encircled_gaussian(r: Column, fwhm: float) -> Column:
    """Share of a circular Gaussian's light within ``r``."""
    return 1 - F.exp(-K * r * r / fwhm**2)


def encircled_moffat(r: Column, fwhm: float, beta: float) -> Column:
    """Share of a circular Moffat profile's light within ``r``."""
    return 1 - F.pow(1 + r * r * (4 * (2 ** (1 / beta) - 1) / fwhm**2), F.lit(1 - beta))


def ring_light(curve: DataFrame, keys: list[str], light: str = "ee") -> DataFrame:
    """``curve`` with ``ring``, the light between each radius and the one before, and ``brightness``, that by the ring's area."""
    w = Window.partitionBy(*keys).orderBy("r")
    inner = F.coalesce(F.lag("r").over(w), F.lit(0.0))
    ring = C(light) - F.coalesce(F.lag(light).over(w), F.lit(0.0))
    return curve.withColumns({"ring": ring, "brightness": ring / (math.pi * (C("r") * C("r") - inner * inner))})


def brightest(image: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Place and value of each image's largest finite pixel; of equal ones the first by row."""
    best = F.max(F.struct(C(value).alias("v"), (-C("y")).alias("y"), (-C("x")).alias("x"))).alias("b")
    return image.where(C(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(best).select(*keys, (-C("b.y")).alias("y"), (-C("b.x")).alias("x"), C("b.v").alias(value))


def render(sources: DataFrame, fwhm: float, radius: int) -> DataFrame:
    """``y, x, model``: the summed light of all sources, where there is any."""
    light = stamps(sources, radius).select(C("py").alias("_y"), C("px").alias("_x"), (C("flux") * gaussian(C("dy"), C("dx"), fwhm)).alias("m"))
    return light.groupBy("_y", "_x").agg(F.sum("m").alias("model")).select(C("_y").alias("y"), C("_x").alias("x"), "model")


def overlap(dy: Column, dx: Column, r: float, method: str, subpixels: int = 5) -> Column:
    """Weight of the pixel at an offset in a circle: by its centre, wholly inside, or by sub-pixels."""
    if method == "center":
        return F.when(dx * dx + dy * dy < r * r, 1.0).otherwise(0.0)
    if method == "whole":
        corner = lambda c: F.abs(c) + 0.5
        return F.when(corner(dx) * corner(dx) + corner(dy) * corner(dy) <= r * r, 1.0).otherwise(0.0)
    if method == "subpixel":
        at = [(k + 0.5) / subpixels - 0.5 for k in range(subpixels)]
        inside = [F.when((dx + a) * (dx + a) + (dy + b) * (dy + b) < r * r, 1).otherwise(0) for a in at for b in at]
        return sum(inside[1:], inside[0]) / float(subpixels * subpixels)
    if method == "exact":
        return exact_overlap(dy, dx, F.lit(float(r)))
    raise ValueError(f"unknown overlap method {method}")


def circle_area(x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Area of the circle of radius r at the origin within [0, x] x [0, y]; odd in x and in y."""
    sign = np.sign(x) * np.sign(y)
    x, y = np.minimum(abs(x), r), np.minimum(abs(y), r)
    inside = x * x + y * y <= r * r
    half = lambda a: 0.5 * (a * np.sqrt(np.maximum(r * r - a * a, 0)) + r * r * np.arcsin(np.clip(a / r, -1, 1)))
    left = np.sqrt(np.maximum(r * r - y * y, 0))  # up to here the height is y, beyond it the arc
    return sign * np.where(inside, x * y, np.minimum(left, x) * y + half(x) - half(np.minimum(left, x)))


def exact_overlap(dy: Column, dx: Column, r: Column) -> Column:
    """Exact area of the unit pixel at an offset within the circle."""

    @F.pandas_udf("double")
    def area(a: pd.Series, b: pd.Series, r: pd.Series) -> pd.Series:
        y, x, r = a.to_numpy(), b.to_numpy(), r.to_numpy()
        corner = lambda i, j: circle_area(x + j, y + i, r)
        return pd.Series(corner(0.5, 0.5) - corner(-0.5, 0.5) - corner(0.5, -0.5) + corner(-0.5, -0.5))

    return area(dy, dx, r)


def on_image(sources: DataFrame, image: DataFrame, radius: int) -> DataFrame:
    """Stamps of the sources with the image's columns ``v`` (and others)."""
    pixels = image.withColumnsRenamed({"y": "py", "x": "px"})
    return stamps(sources, radius).join(shuffled(pixels), ["py", "px"])


def curve_of_growth(sources: DataFrame, image: DataFrame, radii: list[float], method: str = "center", background: float = 0.0, inverse_variance: str | None = None) -> DataFrame:
    """``id, r, flux, area``: background-free light within each radius. Radii must be positive and rise.

    With a column of inverse variances there is ``err``, the flux's deviation; pixels whose inverse variance is
    not positive and finite add nothing to it, while the light and the area keep them.
    """
    if any(b <= a for a, b in zip([0.0, *radii], radii, strict=False)):
        raise ValueError("radii must be positive and strictly increasing")
    if method == "exact":
        ship(image.sparkSession)
    met = on_image(sources, image, math.ceil(max(radii)) + 1)
    sums = []
    for k, r in enumerate(radii):
        w = overlap(C("dy"), C("dx"), r, method)
        met = met.withColumn(f"_w{k}", w)
        sums += [F.sum(C(f"_w{k}") * (C("v") - background)).alias(f"f{k}"), F.sum(f"_w{k}").alias(f"a{k}")]
        if inverse_variance:
            iv = C(inverse_variance)
            known = (iv > 0) & ~F.isnan(iv) & (iv < math.inf)
            sums.append(F.sqrt(F.coalesce(F.sum(F.when(known, w * w / F.when(known, iv))), F.lit(0.0))).alias(f"e{k}"))
    wide = met.groupBy("id").agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(r)).alias("r"), C(f"f{k}").alias("flux"), C(f"a{k}").alias("area"), *([C(f"e{k}").alias("err")] if inverse_variance else [])) for k, r in enumerate(radii)])
    return wide.select("id", F.inline(rows))


def rising_part(curves: DataFrame) -> DataFrame:
    """The rows of each curve up to where its flux first stops rising."""
    w = Window.partitionBy("id").orderBy("r")
    step = curves.withColumn("_stop", F.coalesce((C("flux") <= F.lag("flux").over(w)).cast("int"), F.lit(0)))
    return step.withColumn("_stop", F.max("_stop").over(w)).where("_stop = 0").drop("_stop")


def lookup(curves: DataFrame, x: str, y: str, at: float | Column) -> DataFrame:
    """``id, value``: linear interpolation of y at x on the rising part; NaN outside it."""
    at = F.lit(at) if isinstance(at, float) else at
    w = Window.partitionBy("id").orderBy(x)
    seg = rising_part(curves).select("*", F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1"), F.row_number().over(w).alias("_k"))
    inside = (C(x) <= at) & (at < C("_x1"))
    value = F.when(inside, C(y) + ratio(at - C(x), C("_x1") - C(x)) * (C("_y1") - C(y))).when((C(x) == at) & C("_x1").isNull(), C(y))
    return seg.groupBy("id").agg(F.coalesce(F.max(value), nan()).alias("value"))


def moments(sources: DataFrame, image: DataFrame, radius: int, background: float, weight: Column | None = None) -> DataFrame:
    """Signed weighted moments to second order about each source's position, and unweighted aperture sums."""
    w = F.lit(1.0) if weight is None else weight
    z = C("v") - background
    met = on_image(sources, image, radius).withColumn("_w", w).where("_w > 0")
    dy, dx, wz = C("dy"), C("dx"), C("_w") * z
    return met.groupBy("id").agg(
        F.sum(wz).alias("m00"), F.sum(wz * dy).alias("m10"), F.sum(wz * dx).alias("m01"),
        F.sum(wz * dy * dy).alias("m20"), F.sum(wz * dx * dx).alias("m02"), F.sum(wz * dx * dy).alias("m11"),
        F.sum(z).alias("aperture_sum"), F.count("*").alias("aperture_area"), F.sqrt(F.sum(1 / C("_w"))).alias("aperture_err"),
    )


def shapes(m: DataFrame) -> DataFrame:
    """Widths, angle and ellipticities from the moments; NaN where the total is not positive."""
    good = C("m00") > 0
    at = lambda c: ratio(C(c), C("m00"))
    yy, xx, xy = at("m20") - at("m10") * at("m10"), at("m02") - at("m01") * at("m01"), at("m11") - at("m10") * at("m01")
    base = m.withColumns({"s_yy": F.greatest(yy, F.lit(0.0)), "s_xx": F.greatest(xx, F.lit(0.0)), "s_xy": xy})
    total = C("s_yy") + C("s_xx")
    out = {
        "y_fwhm": 2.3548200450309493 * F.sqrt("s_yy"), "x_fwhm": 2.3548200450309493 * F.sqrt("s_xx"),
        "theta": F.degrees(F.atan2(2 * C("s_xy"), C("s_xx") - C("s_yy")) / 2),
        "ellipticity1": ratio(C("s_yy") - C("s_xx"), total), "ellipticity2": ratio(2 * C("s_xy"), total), "compactness": ratio(F.lit(1.0), total),
    }
    return base.withColumns({k: F.when(good, v).otherwise(nan()) for k, v in out.items()})


def quadratic_centroid(nb: str, y: Column, x: Column, background: float = 0.0) -> dict[str, Column]:
    """Peak of the quadratic through a 3 x 3 neighbourhood (array of rows), unweighted least squares; NaN where it is flat.

    With basis 1, y, x, y^2/2, x^2/2, xy the fitted coefficients are the value, the gradient g and the Hessian at the centre, each a
    fixed stencil of the nine values. The peak is one Newton step s = -H^-1 g away, and its value is half of g s higher.
    """
    cells = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]

    def stencil(weight: Callable[[int, int], float]) -> Column:
        terms = [float(weight(i, j)) * (C(nb)[i + 1][j + 1] - background) for i, j in cells if weight(i, j)]
        return sum(terms[1:], terms[0])

    value, whole = stencil(lambda i, j: (5 - 3 * i * i - 3 * j * j) / 9), stencil(lambda i, j: 1)
    g_y, g_x = stencil(lambda i, j: i / 6), stencil(lambda i, j: j / 6)
    h_yy, h_xx, h_xy = stencil(lambda i, j: i * i - 2 / 3), stencil(lambda i, j: j * j - 2 / 3), stencil(lambda i, j: i * j / 4)
    spread = h_yy * h_yy + h_xx * h_xx + 2 * h_xy * h_xy
    det = F.when(F.abs(h_yy * h_xx - h_xy * h_xy) > 1e-12 * spread, h_yy * h_xx - h_xy * h_xy).otherwise(F.lit(0.0))
    s_y, s_x = ratio(h_xy * g_x - h_xx * g_y, det), ratio(h_xy * g_y - h_yy * g_x, det)
    peak = value + (g_y * s_y + g_x * s_x) / 2
    mass = lambda moment: F.when(whole > 0, 6 * moment / whole).otherwise(nan())
    return {"yc": y + s_y, "xc": x + s_x, "peak": peak + background, "curvature": ratio(-(h_yy + h_xx), F.abs(peak)), "com_y": y + mass(g_y), "com_x": x + mass(g_x)}
