"""Photometry, projection and interpolation as column expressions.

Missing values are NaN, as in the catalogs: a magnitude of a flux that is not positive is NaN,
and divisions are guarded so that ANSI mode never raises.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC_PER_RAD = 180 * 3600 / math.pi


def nan() -> Column:
    return F.lit(float("nan"))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NaN where ``b`` is zero."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(nan())


def abmag(flux: Column, zero: float = 3631.0) -> Column:
    return F.when(flux > 0, 2.5 * F.log10(zero / F.when(flux > 0, flux))).otherwise(nan())


def abmag_err(flux: Column, err: Column) -> Column:
    return F.when(flux > 0, F.lit(2.5 / math.log(10)) * err / F.when(flux > 0, flux)).otherwise(nan())


def total_error(data: Column, sigma: Column, gain: Column) -> Column:
    """Background and source noise; only the background's where gain or data are not positive."""
    return F.when((gain > 0) & (data > 0), F.sqrt(sigma * sigma + data / F.when(gain > 0, gain))).otherwise(F.abs(sigma))


def noise_area(area: Column, background: Column, read_noise: Column, gain: Column) -> Column:
    return area * (background / gain + read_noise * read_noise)


def flux_for_snr(snr: Column, noise: Column, gain: Column) -> Column:
    """The positive root of flux / sqrt(flux / gain + noise) = snr."""
    a = snr * snr / gain
    return (a + F.sqrt(a * a + 4 * snr * snr * noise)) / 2


def snr_for_flux(flux: Column, noise: Column, gain: Column) -> Column:
    return ratio(flux, F.sqrt(flux / gain + noise))


def tan_forward(ra: Column, dec: Column, ra0: float, dec0: float, scale: float, cy: float, cx: float) -> tuple[Column, Column]:
    """Gnomonic grid position of a sky position in degrees; 90 degrees away or more raises an error."""
    a, d = F.radians(ra - ra0), F.radians(dec)
    s0, c0 = math.sin(math.radians(dec0)), math.cos(math.radians(dec0))
    cosc = s0 * F.sin(d) + c0 * F.cos(d) * F.cos(a)
    safe = F.when(cosc > 0, cosc).otherwise(F.raise_error(F.lit("position is 90 degrees or more from the tangent point")).cast("double"))
    xi, eta = F.cos(d) * F.sin(a) / safe, (c0 * F.sin(d) - s0 * F.cos(d) * F.cos(a)) / safe
    k = ARCSEC_PER_RAD / scale
    return cy + eta * k, cx - xi * k


def tan_inverse(row: Column, col: Column, ra0: float, dec0: float, scale: float, cy: float, cx: float) -> tuple[Column, Column]:
    k = scale / ARCSEC_PER_RAD
    eta, xi = (row - cy) * k, -(col - cx) * k
    s0, c0 = math.sin(math.radians(dec0)), math.cos(math.radians(dec0))
    d = c0 - eta * s0
    ra = F.lit(ra0) + F.degrees(F.atan2(xi, d))
    return ra - 360 * F.floor(ra / 360).cast("double"), F.degrees(F.atan2(s0 + eta * c0, F.sqrt(xi * xi + d * d)))


def morton(y: Column, x: Column) -> Column:
    """Z-order key of two non-negative integers below 2^31."""

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(y.cast("long")).bitwiseOR(F.shiftleft(spread(x.cast("long")), 1))


def catmull_rom_weights(t: Column) -> list[Column]:
    t2, t3 = t * t, t * t * t
    return [(-t + 2 * t2 - t3) / 2, (2 - 5 * t2 + 3 * t3) / 2, (t + 4 * t2 - 3 * t3) / 2, (-t2 + t3) / 2]


def cubic4(f1: Column, f2: Column, f3: Column, f4: Column, t: Column) -> tuple[Column, Column]:
    """Cubic convolution through four neighbours: value and derivative between the middle two."""
    m1, m2 = (f3 - f1) / 2, (f4 - f2) / 2
    a = 2 * (f2 - f3) + m1 + m2
    b = 3 * (f3 - f2) - 2 * m1 - m2
    return ((a * t + b) * t + m1) * t + f2, (3 * a * t + 2 * b) * t + m1


def tukey(r: Column, c: float = 4.685) -> tuple[Column, Column, Column, Column]:
    """Bisquare loss, its first and second derivative, and the reweighting factor."""
    u = 1 - (r / c) * (r / c)
    near = F.abs(r) <= c
    zero = F.lit(0.0)
    return (
        F.when(near, c * c / 6 * (1 - u * u * u)).otherwise(F.lit(c * c / 6)),
        F.when(near, r * u * u).otherwise(zero),
        F.when(near, u * (5 * u - 4)).otherwise(zero),
        F.when(near, u * u).otherwise(zero),
    )


def deconvolved(yy: Column, xx: Column, xy: Column, k: float) -> tuple[Column, Column, Column]:
    """Second moments without a Gaussian window of inverse variance ``k``; NaN where that is unphysical."""
    d = yy * xx - xy * xy
    q = 1 - k * (yy + xx) + k * k * d
    a, b = ratio(yy - k * d, q), ratio(xx - k * d, q)
    good = (d > 0) & (q > 0) & (a > 0) & (b > 0)
    return tuple(F.when(good, v).otherwise(nan()) for v in (a, b, ratio(xy, q)))


def debiased_square(d1: Column, d2: Column, v1: Column, v2: Column, c12: Column) -> tuple[Column, Column]:
    """|d|^2 less its noise, and the error of that.

    For d normal with mean m and covariance C, |d|^2 has the mean m'm + tr C and the variance
    2 tr CC + 4 m'Cm = 2 tr CC + 4 tr C(mm'). The outer product mm' is estimated by dd' - C, its
    squares not below 0.
    """
    noise = {(0, 0): v1, (0, 1): c12, (1, 0): c12, (1, 1): v2}
    d = (d1, d2)
    signal = {(i, j): d[i] * d[j] - c for (i, j), c in noise.items()}
    floored = {(i, j): F.greatest(F.lit(0.0), x) if i == j else x for (i, j), x in signal.items()}

    def trace(a: dict, b: dict) -> Column:  # of the product of two symmetric matrices
        return reduce(operator.add, [a[at] * b[at] for at in a])

    variance = 2 * trace(noise, noise) + 4 * F.greatest(F.lit(0.0), trace(noise, floored))
    return signal[0, 0] + signal[1, 1], F.sqrt(F.greatest(F.lit(0.0), variance))


def jansky_factor(megajansky_per_sr: Column, pixel_sr: Column) -> Column:
    """Jansky of one unit in a pixel, from its surface brightness in MJy per steradian and its area; an error if either is missing."""
    known = megajansky_per_sr.isNotNull() & ~F.isnan(megajansky_per_sr) & pixel_sr.isNotNull() & ~F.isnan(pixel_sr)
    return F.when(known, megajansky_per_sr * 1e6 * pixel_sr).otherwise(F.raise_error(F.lit("no photometric calibration")).cast("double"))


def ellipse_bounds(a: Column, b: Column, theta: Column) -> tuple[Column, Column]:
    """Half height and half width of an ellipse with axes ``a`` (at ``theta`` degrees from x) and ``b``."""
    c, s = F.cos(F.radians(theta)), F.sin(F.radians(theta))
    return F.sqrt(a * s * a * s + b * c * b * c), F.sqrt(a * c * a * c + b * s * b * s)


def nnls2(suu: Column, suv: Column, svv: Column, suy: Column, svy: Column, syy: Column) -> tuple[Column, Column, Column]:
    """Non-negative least squares in two variables from the normal sums: both values and the residual.

    The problem is convex, so a point is the solution if no direction that keeps both values non-negative leads
    down. An edge's own minimum is that if the gradient across the edge is not negative there; if
    neither edge's is, the solution lies inside and solves the normal equations. Where the two columns are
    parallel within rounding, the better edge is a solution.
    """
    zero = F.lit(0.0)
    clip = lambda y, s: F.when(s > 0, F.greatest(zero, ratio(y, s))).otherwise(zero)
    edge_u, edge_v = clip(suy, suu), clip(svy, svv)
    on_u, on_v = edge_u * suv >= svy, edge_v * suv >= suy
    det = suu * svv - suv * suv
    inside, better_u = det > 1e-12 * suu * svv, edge_u * suy >= edge_v * svy
    u = F.when(on_u, edge_u).when(on_v, zero).when(inside, ratio(svv * suy - suv * svy, det)).otherwise(F.when(better_u, edge_u).otherwise(zero))
    v = F.when(on_u, zero).when(on_v, edge_v).when(inside, ratio(suu * svy - suv * suy, det)).otherwise(F.when(better_u, zero).otherwise(edge_v))
    return u, v, syy + u * (u * suu + v * suv - 2 * suy) + v * (u * suv + v * svv - 2 * svy)
