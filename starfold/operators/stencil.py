"""Stencils over pixel tables: correlation, local maxima, median filter, mesh interpolation.

An image is cut into tiles of ``TILE`` x ``TILE`` pixels; each tile also gets the pixels up to the
stencil's half width around it, and is a group of bounded size. Within it a neighbourhood is built by two
window passes, along the rows into arrays, then along the columns over those arrays. Both need the
one shuffle by tile; a pixel is repeated only near the edges of tiles, never for each tap.
``keys`` name the image; ``y, x`` are 1-based.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import catmull_rom_weights
from ..shared import shuffled

C = F.col


TILE = 64


def tiled(df: DataFrame, h: int) -> tuple[DataFrame, list[str], Column]:
    """Pixels dealt to tiles with a margin of ``h``, the tiles' columns, and what tells a tile's own pixels."""
    side = max(TILE, h)
    at = lambda c, k: F.floor((C(c) - 1 + k) / side).cast("long")
    near = lambda c: F.explode(F.filter(F.array_distinct(F.array(at(c, -h), at(c, 0), at(c, h))), lambda t: t >= 0))
    dealt = df.withColumn("_ty", near("y")).withColumn("_tx", near("x"))
    return dealt, ["_ty", "_tx"], (at("y", 0) == C("_ty")) & (at("x", 0) == C("_tx"))


def neighbourhood(df: DataFrame, h: int, value: str = "v", border: str = "replicate", keys: tuple[str, ...] = (), out: str = "nb") -> DataFrame:
    """``df`` with an array of 2h+1 arrays: the values around each pixel, row by row.

    ``border``: "replicate" repeats the edge, "zero" is 0 beyond it, "null" is null.
    """
    dealt, tile, own = tiled(df, h)
    dealt = dealt.repartition(*keys, *tile)

    def line(c: str, along: str, across: str, missing: Column | None) -> Column:
        w = Window.partitionBy(*keys, *tile, across).orderBy(along)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends = (F.first(c).over(whole), F.last(c).over(whole)) if border == "replicate" else (missing, missing)
        held = lambda value, end: value if end is None else F.coalesce(value, end)
        before = [held(F.lag(c, k).over(w), ends[0]) for k in range(h, 0, -1)]
        after = [held(F.lead(c, k).over(w), ends[1]) for k in range(1, h + 1)]
        return F.array(*before, C(c), *after)

    zero = F.lit(0.0) if border == "zero" else None
    rows = dealt.withColumn("_row", line(value, "x", "y", zero))
    blank = F.array(*[F.lit(0.0) if border == "zero" else F.lit(None).cast(df.schema[value].dataType)] * (2 * h + 1))
    return rows.withColumn(out, line("_row", "y", "x", blank)).where(own).drop("_row", *tile)


def tap(nb: str, h: int, dy: int, dx: int) -> Column:
    return C(nb)[dy + h][dx + h]


def weighted_sum(nb: str, kernel: np.ndarray, part: str | None = None) -> Column:
    """The sum of the neighbours, or of one field of theirs, times the kernel."""
    h = kernel.shape[0] // 2
    held = lambda dy, dx: tap(nb, h, dy, dx) if part is None else tap(nb, h, dy, dx)[part]
    terms = [float(kernel[i, j]) * held(i - h, j - h) for i in range(2 * h + 1) for j in range(2 * h + 1) if kernel[i, j]]
    total = terms[0] if terms else F.lit(0.0)
    for t in terms[1:]:
        total = total + t
    return total


def correlate(df: DataFrame, kernel: np.ndarray, value: str = "v", out: str = "c", border: str = "replicate", keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the correlation (the kernel is not flipped) of an odd-sized square kernel."""
    if kernel.ndim != 2 or kernel.shape[0] != kernel.shape[1] or kernel.shape[0] % 2 == 0:
        raise ValueError("the kernel must be square with an odd side")
    return neighbourhood(df, kernel.shape[0] // 2, value, border, keys, "_nb").withColumn(out, weighted_sum("_nb", kernel)).drop("_nb")


def factored(kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Column and row factors of a kernel of rank one, else None."""
    u, s, vt = np.linalg.svd(kernel)
    if len(s) > 1 and s[1] >= math.sqrt(np.finfo(float).eps) * s[0]:
        return None
    return u[:, 0] * math.sqrt(s[0]), vt[0] * math.sqrt(s[0])


def correlate_separable(df: DataFrame, column: np.ndarray, row: np.ndarray, value: str = "v", out: str = "c", keys: tuple[str, ...] = ()) -> DataFrame:
    """Correlation with an outer product, as one pass along the rows and one along the columns; edges repeat."""

    dealt, tile, own = tiled(df, max(len(column), len(row)) // 2)

    def along(c: str, line: str, across: str, taps: np.ndarray) -> Column:
        h = len(taps) // 2
        w = Window.partitionBy(*keys, *tile, across).orderBy(line)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        total = float(taps[h]) * C(c)
        for k in range(1, h + 1):
            total = total + float(taps[h - k]) * F.coalesce(F.lag(c, k).over(w), F.first(c).over(whole)) + float(taps[h + k]) * F.coalesce(F.lead(c, k).over(w), F.last(c).over(whole))
        return total

    return dealt.repartition(*keys, *tile).withColumn("_r", along(value, "x", "y", row)).withColumn(out, along("_r", "y", "x", column)).where(own).drop("_r", *tile)


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    d = np.arange(size) - size // 2
    k = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def zero_sum(p: np.ndarray) -> tuple[np.ndarray, float]:
    """The matched filter that ignores a constant level, and its norm; the template itself if that is void."""
    d = (p * p).sum() - p.sum() ** 2 / p.size
    return ((p - p.mean()) / d, math.sqrt(d)) if d > 0 else (p, 1.0)


def matched_filter(df: DataFrame, template: np.ndarray, weight: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``smoothed``, ``den`` and ``significance`` of a point source at each pixel.

    Pixels of weight 0 count as value 0, whatever they hold.
    """
    k, norm = zero_sum(template)
    if weight is None:
        return correlate(df, k, "v", "smoothed", keys=keys).withColumns({"den": F.lit(1.0), "significance": C("smoothed") * norm})
    w = F.when((C(weight) > 0) & (C(weight) < math.inf), C(weight)).otherwise(F.lit(0.0))
    ready = df.withColumn("_w", w).withColumn("_both", F.struct(F.when(C("_w") > 0, C("_w") * C("v")).otherwise(F.lit(0.0)).alias("wv"), C("_w").alias("w")))
    nb = neighbourhood(ready.drop("_w"), k.shape[0] // 2, "_both", "replicate", keys, "_nb")
    both = nb.withColumns({"smoothed": weighted_sum("_nb", k, "wv"), "den": weighted_sum("_nb", k * k, "w")}).drop("_nb", "_both")
    return both.withColumn("significance", F.when(C("den") > 0, C("smoothed") / F.sqrt(F.when(C("den") > 0, C("den")))).otherwise(F.lit(0.0)))


def above_neighbours(nb: str, value: str, edges: bool) -> Column:
    """True where a pixel is strictly above all eight neighbours; those beyond the edge are below it only with ``edges``."""
    each = [F.coalesce(C(value) > tap(nb, 1, dy, dx), F.lit(edges)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    return reduce(operator.and_, each)


def local_maxima(df: DataFrame, value: str = "v", edges: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """The pixels strictly above all eight neighbours; at the edges only on request. A plateau has none."""
    return neighbourhood(df, 1, value, "null", keys, "_nb").where(above_neighbours("_nb", value, edges)).drop("_nb")


def refined_peaks(df: DataFrame, floor: float, border: int, ny: int, nx: int, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Maxima of at least ``floor`` away from the border, moved by a parabola along each axis (at most half a pixel)."""
    nb = neighbourhood(df, 1, value, "null", keys, "_nb").where(above_neighbours("_nb", value, False))
    t = lambda dy, dx: tap("_nb", 1, dy, dx)
    shift = lambda a, b: F.coalesce(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.try_divide(a - b, 2 * (2 * C(value) - a - b)))), F.lit(0.0))
    inside = (C("y") > border) & (C("y") <= ny - border) & (C("x") > border) & (C("x") <= nx - border) & (C(value) >= floor)
    return nb.where(inside).select(*keys, "y", "x", (C("y") + shift(t(1, 0), t(-1, 0))).alias("py"), (C("x") + shift(t(0, 1), t(0, -1))).alias("px"), C(value).alias("peak"))


def median_filter(df: DataFrame, h: int, value: str = "v", out: str = "m", keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the median of the window of side 2h+1; window positions beyond the edge repeat the edge."""
    nb = neighbourhood(df, h, value, "replicate", keys, "_nb")
    flat = F.array_sort(F.flatten("_nb"))
    return nb.withColumn(out, F.get(flat, F.lit(((2 * h + 1) ** 2) // 2))).drop("_nb")


def zoom(mesh: DataFrame, pixels: DataFrame, value: str, rows: int, cols: int, height: int, width: int, out: str) -> DataFrame:
    """``pixels`` with the Catmull-Rom interpolation of a mesh (``mi, mj`` from 0) at box centres.

    ``height`` and ``width`` are those of the padded image. Each cell of the mesh first gets its 16
    values around, so that a pixel meets one row.
    """
    m = mesh.select((C("mi") + 1).alias("y"), (C("mj") + 1).alias("x"), C(value).alias("v"))
    patch = neighbourhood(m, 2, "v", "replicate", (), "_patch").select(C("y").alias("_i"), C("x").alias("_j"), "_patch")

    def place(c: str, k_mesh: int, k_out: int) -> Column:
        return F.greatest(F.lit(1.0), F.least(F.lit(float(k_mesh)), (C(c) - 0.5) * k_mesh / k_out + 0.5))

    at = pixels.withColumns({"_cy": place("y", rows, height), "_cx": place("x", cols, width)}).withColumns({"_i": F.floor("_cy").cast("long"), "_j": F.floor("_cx").cast("long")})
    joined = at.join(patch, ["_i", "_j"])
    wy, wx = catmull_rom_weights(C("_cy") - C("_i")), catmull_rom_weights(C("_cx") - C("_j"))
    total = F.lit(0.0)
    for a in range(4):
        for b in range(4):
            total = total + wy[a] * wx[b] * C("_patch")[a + 1][b + 1]
    return joined.withColumn(out, total).drop("_cy", "_cx", "_i", "_j", "_patch")


def lag_products(df: DataFrame, lags: list[tuple[int, int]], value: str = "v") -> DataFrame:
    """``dy, dx, n, cov``: mean product of pixels at each lag, by equi-joins of the image with its shifted self."""
    moved = df.select("y", "x", C(value).alias("_a"), F.inline(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in lags])))
    other = df.select(C("y").alias("_y"), C("x").alias("_x"), C(value).alias("_b"))
    pairs = moved.join(shuffled(other), (C("y") + C("dy") == C("_y")) & (C("x") + C("dx") == C("_x")))
    return pairs.groupBy("dy", "dx").agg(F.count("*").alias("n"), F.avg(C("_a") * C("_b")).alias("cov"))
