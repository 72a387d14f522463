"""Multi-pass photometry: detect, fit all sources together, subtract, and look again.

The image and the catalog are DataFrames. The background is measured in boxes. Each pass subtracts the model and detects
peaks by tiles, drops those near known or discarded positions, and fits all sources by tiles. A tile is
a bounded group (core and halo); it solves the linearised joint fit of its sources in numpy and keeps those in its core. Catalogs between passes are written
to the shared folder, so a pass depends on one table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joint as J
from ..operators import robust as R
from ..operators import sparse_fit as S
from ..operators import spatial as P
from ..operators import stencil as T
from ..operators.measure import K, render
from ..shared import materialize, parts, ship, shuffled

C = F.col
CATALOG = "id long, y double, x double, flux double, flux_err double, snr double, pass int"


@dataclass(frozen=True)
class Options:
    """Defaults of the loop; ``error`` is the noise of a pixel."""

    fwhm: float = 3.0
    radius: int = 8
    error: float = 0.5
    detect_sigma: float = 5.0
    min_separation: float = 1.5
    prune_snr: float = 3.0
    prune_separation: float = 1.0
    max_passes: int = 4
    min_growth: float = 0.01
    box: int = 32
    tile: int = 48
    halo: int = 10
    steps: int = 6
    sequential: bool = False


@dataclass
class Outcome:
    catalog: DataFrame
    discards: DataFrame
    residual: DataFrame
    history: list[dict] = field(default_factory=list)


def profile(dy: np.ndarray, dx: np.ndarray, fwhm: float) -> np.ndarray:
    return K / (math.pi * fwhm * fwhm) * np.exp(-K * (dy * dy + dx * dx) / (fwhm * fwhm))


def fit_together(y: np.ndarray, x: np.ndarray, flux: np.ndarray, pixels: pd.DataFrame, o: Options) -> tuple[np.ndarray, ...]:
    """Positions, fluxes and flux errors of all sources of a tile at once, without a matrix of all parameters."""
    py, px, v = (pixels[c].to_numpy(float) for c in ("py", "px", "v"))
    grid = S.Grid(py, px, v, 1.0, o.radius)
    y, x, flux, err = S.fit_all(grid, S.gaussian_profile(o.fwhm), y, x, flux, o.steps)
    return y, x, flux, err * o.error


def fit_in_turn(y: np.ndarray, x: np.ndarray, flux: np.ndarray, pixels: pd.DataFrame, o: Options) -> tuple[np.ndarray, ...]:
    """One source after the other, the brightest first, each against the residual of all others.

    The profile is a product of a column and a row, so the light of a source is an outer product, and a window without gaps is fitted by
    the sums along its sides.
    """
    err = np.full(len(y), math.nan)
    if not len(pixels):
        return y, x, flux, err
    py, px = (pixels[c].to_numpy(int) for c in ("py", "px"))
    low, high = (py.min(), px.min()), (py.max(), px.max())
    rows, cols = (np.arange(a, b + 1.0) for a, b in zip(low, high))
    rest, have = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)), bool)
    rest[py - low[0], px - low[1]], have[py - low[0], px - low[1]] = pixels["v"].to_numpy(float), True
    c = K / (o.fwhm * o.fwhm)
    light = lambda rows, cols, y, x, flux: np.outer(flux * c / math.pi * np.exp(-c * (rows - y) ** 2), np.exp(-c * (cols - x) ** 2))
    for k in range(len(y)):
        rest -= light(rows, cols, y[k], x[k], flux[k])
    for k in np.argsort(-flux, kind="stable"):
        side = lambda at, first, n: slice(max(math.ceil(at - 4.5) - first, 0), max(min(math.floor(at + 4.5) - first + 1, n), 0))
        box = side(y[k], low[0], len(rows)), side(x[k], low[1], len(cols))
        real = have[box]
        if real.sum() < 8:
            continue
        own = rest[box] + light(rows[box[0]], cols[box[1]], y[k], x[k], flux[k])
        p, variance = fit_alone(own, real, rows[box[0]], cols[box[1]], np.array([y[k], x[k], flux[k], 0.0]), c, 1 / o.error**2)
        if not np.isfinite(p).all() or math.hypot(p[0] - y[k], p[1] - x[k]) > 1.0:
            continue
        rest += light(rows, cols, y[k], x[k], flux[k]) - light(rows, cols, *p[:3])
        y[k], x[k], flux[k], err[k] = p[0], p[1], p[2], math.sqrt(max(variance, 0))
    return y, x, flux, err


def fit_alone(own: np.ndarray, real: np.ndarray, rows: np.ndarray, cols: np.ndarray, start: np.ndarray, c: float, weight: float, rounds: int = 8) -> tuple[np.ndarray, float]:
    """``y, x, flux, bkg`` of a source in a window, where it is ``real``, and the flux's variance, by the steps of ``least_squares`` with exact slopes."""
    whole = real.all()

    def linear(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Cost, normal matrix and gradient: each slope is the product of a column and a row."""
        dy, dx = rows - p[0], cols - p[1]
        up, along = np.ones((4, len(rows))), np.ones((4, len(cols)))
        u, t = up[2], along[2]
        np.exp(-c * dy * dy, out=u)
        np.exp(-c * dx * dx, out=t)
        u *= c / math.pi
        up[1] = p[2] * u
        up[0], along[0], along[1] = 2 * c * dy * up[1], t, 2 * c * dx * t
        r = own - p[3] - up[1][:, None] * t
        if whole:
            a = (up @ up.T) * (along @ along.T)
        else:
            r = np.where(real, r, 0.0)
            j = (up[:, :, None] * along[:, None, :])[:, real]
            a = j @ j.T
        return weight * float((r * r).sum()), weight * a, weight * ((up @ r) * along).sum(1)

    p, damp = start, 1e-4
    cost, a, g = linear(p)
    for _ in range(rounds):
        if abs(g).max() < 1e-10 * max(cost, 1e-30):
            break
        damped = a.copy()
        damped.flat[::5] += damp * np.maximum(a.flat[::5], 1e-6)
        try:
            np.linalg.cholesky(damped)
            step = np.linalg.solve(damped, g)
        except np.linalg.LinAlgError:
            damp = min(damp * 10, 1e12)
            continue
        cost2, a2, g2 = linear(p + step)
        if np.isfinite(cost2) and cost2 < cost:
            small = abs(step).max() < 1e-8 * max(1.0, abs(p).max()) or cost - cost2 < 1e-8 * cost
            p, cost, a, g, damp = p + step, cost2, a2, g2, max(damp / 10, 1e-12)
            if small:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    try:
        np.linalg.cholesky(a)
        cov = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return p, math.nan
    last = p + cov @ g  # a last step without damping
    return last if linear(last)[0] < cost else p, float(cov[2, 2])


def fit_pass(catalog: DataFrame, image: DataFrame, o: Options) -> DataFrame:
    """All sources fitted by tiles with halos; each source is taken from the tile whose core holds it."""
    ship(image.sparkSession)
    grid = image.select("y", "x", "v")
    n = parts(image)  # not fewer for small tables, as fits take longer than reading
    tiles = J.tiles_of(grid, o.tile, o.halo).select("ty", "tx", C("y").alias("py"), C("x").alias("px"), "v").repartition(n, "ty", "tx")
    at = catalog.withColumns({"_y": C("y"), "_x": C("x"), "y": F.rint("y").cast("long"), "x": F.rint("x").cast("long")})
    corner = image.agg(F.max("y"), F.max("x")).first()
    inside = at.where(C("y").between(1, corner[0]) & C("x").between(1, corner[1]))
    span = lambda c, most: F.sequence(F.greatest(F.lit(0), F.floor((C(c) - 1 - o.halo) / o.tile)).cast("long"), F.least(F.lit((most - 1) // o.tile), F.floor((C(c) - 1 + o.halo) / o.tile)).cast("long"))
    sources = inside.select("*", F.explode(span("y", corner[0])).alias("ty")).select("*", F.explode(span("x", corner[1])).alias("tx"))
    owned = (C("ty") == F.floor((C("y") - 1) / o.tile)) & (C("tx") == F.floor((C("x") - 1) / o.tile))
    sources = sources.select("ty", "tx", "id", C("_y").alias("y"), C("_x").alias("x"), "flux", "pass", owned.alias("owned"))
    solve: Callable = fit_in_turn if o.sequential else fit_together

    def tile(own: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "y", "x", "flux", "flux_err", "snr", "pass"]
        if not len(own) or not len(pixels):
            return pd.DataFrame(columns=columns)
        y, x, flux, err = solve(own["y"].to_numpy(float).copy(), own["x"].to_numpy(float).copy(), own["flux"].to_numpy(float).copy(), pixels[np.isfinite(pixels["v"])], o)
        out = own.assign(y=y, x=x, flux=flux, flux_err=err, snr=flux / np.where(err > 0, err, math.nan))
        return out[out["owned"]][columns]

    return sources.repartition(n, "ty", "tx").groupBy("ty", "tx").cogroup(tiles.groupBy("ty", "tx")).applyInPandas(tile, CATALOG)


def subtract(image: DataFrame, catalog: DataFrame, o: Options) -> DataFrame:
    """The image less the light of the catalog."""
    light = render(catalog.select("id", "y", "x", "flux"), o.fwhm, o.radius)
    return image.select("y", "x", "v").join(shuffled(light), ["y", "x"], "left").select("y", "x", (C("v") - F.coalesce("model", F.lit(0.0))).alias("v"))


def level(image: DataFrame, box: int) -> DataFrame:
    """The image less its mesh background, its void boxes filled, median-filtered and interpolated."""
    m = R.fill_mesh(R.mesh(image, (box, box)), ("bkg",)).select((C("mi") + 1).alias("y"), (C("mj") + 1).alias("x"), C("bkg").alias("v"))
    flat = T.median_filter(m, 1).select((C("y") - 1).alias("mi"), (C("x") - 1).alias("mj"), "m")
    flat = materialize(flat, "mesh")
    rows, cols = (v + 1 for v in flat.agg(F.max("mi"), F.max("mj")).first())
    return T.zoom(flat, image, "m", rows, cols, rows * box, cols * box, "_b").select("y", "x", (C("v") - C("_b")).alias("v"))


def detect(image: DataFrame, o: Options, catalog: DataFrame | None = None) -> DataFrame:
    """``y, x, flux, rank`` of the significant peaks of the image, less the light of the catalog as ``subtract`` has it.

    A tile is a bounded group: its pixels with the margin of the filter and of a neighbour, and the sources that reach them. Pixels
    beyond an edge repeat it, absent and null ones are passed over.
    """
    ship(image.sparkSession)
    size = 2 * math.ceil(o.fwhm) + 1
    d = np.arange(size) - size // 2
    kernel, norm = T.zero_sum(profile(d[:, None].astype(float), d[None, :].astype(float), o.fwhm))
    margin, n = size // 2 + 1, parts(image)
    dealt, tile, own = T.tiled(image.select("y", "x", "v").where(C("v").isNotNull()), margin)
    dealt = dealt.select(*tile, "y", "x", "v", own.alias("own")).repartition(n, *tile)

    def find(pixels: pd.DataFrame, sources: pd.DataFrame | None = None) -> pd.DataFrame:
        pixels = pixels[["y", "x", "v", "own"]].sort_values(["y", "x"])
        y, x, v, own = (pixels[c].to_numpy() for c in pixels)
        if not own.any():
            return pd.DataFrame(columns=["y", "x", "flux", "rank"])
        if sources is not None and len(sources):
            v = v - light_at(y, x, *(sources[c].to_numpy(float) for c in ("y", "x", "flux")), o)
        significance = filtered(y, x, v, kernel) * norm / o.error
        top = summits(y, x, significance) & own & (significance >= o.detect_sigma)
        return pd.DataFrame({"y": y[top].astype(float), "x": x[top].astype(float), "flux": significance[top] * o.error / norm, "rank": significance[top]})

    schema = "y double, x double, flux double, rank double"
    if catalog is None:
        return dealt.groupBy(*tile).applyInPandas(lambda pixels: find(pixels), schema)
    reach = o.radius + margin
    near = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.rint(c) - 1 - reach) / T.TILE)).cast("long"), F.floor((F.rint(c) - 1 + reach) / T.TILE).cast("long")))
    stars = catalog.where((C("y") > -reach) & (C("x") > -reach)).select("y", "x", "flux").withColumn(tile[0], near("y")).withColumn(tile[1], near("x")).repartition(n, *tile)
    return stars.groupBy(*tile).cogroup(dealt.groupBy(*tile)).applyInPandas(lambda sources, pixels: find(pixels, sources), schema)


def light_at(y: np.ndarray, x: np.ndarray, sy: np.ndarray, sx: np.ndarray, flux: np.ndarray, o: Options) -> np.ndarray:
    """The light of sources at pixels, each in the stamp around its rounded place."""
    low, shape = (y.min(), x.min()), (y.max() - y.min() + 1, x.max() - x.min() + 1)
    rows, cols = (np.rint(c).astype(int)[:, None] + np.arange(-o.radius, o.radius + 1) for c in (sy, sx))
    values = profile((rows - sy[:, None])[:, :, None], (cols - sx[:, None])[:, None, :], o.fwhm) * flux[:, None, None]
    rows, cols = (rows - low[0])[:, :, None], (cols - low[1])[:, None, :]
    on = (rows >= 0) & (rows < shape[0]) & (cols >= 0) & (cols < shape[1])
    total = np.bincount((rows * shape[1] + cols)[on], values[on], shape[0] * shape[1])
    return total[(y - low[0]) * shape[1] + x - low[1]]


def ends(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member of a sorted array the first and the last place of its value."""
    at = np.arange(len(line))
    new = np.r_[True, line[1:] != line[:-1]]
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return starts[run], np.r_[starts[1:], len(at)][run] - 1


def filtered(y: np.ndarray, x: np.ndarray, v: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The correlation of pixels sorted by row and column with a kernel; beyond the ends of a row or column its last pixel repeats."""
    h, at = len(kernel) // 2, np.arange(len(y))
    first, last = ends(y)
    across = np.stack([v[np.clip(at + k, first, last)] for k in range(-h, h + 1)], axis=1) @ kernel.T  # by row of the kernel
    down = np.lexsort((y, x))
    first, last = ends(x[down])
    out = np.empty(len(y))
    out[down] = sum(across[down[np.clip(at + k, first, last)], k + h] for k in range(-h, h + 1))
    return out


def summits(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pixels, sorted by row and column, are strictly above all eight neighbours; at the edges none is."""
    n = len(y)
    at = np.arange(n)
    first, last = ends(y)
    left, right = np.r_[np.where(at > first, at - 1, n), n], np.r_[np.where(at < last, at + 1, n), n]  # n is no pixel
    down = np.lexsort((y, x))
    first, last = ends(x[down])
    above, below = np.empty(n, int), np.empty(n, int)
    above[down], below[down] = np.where(at > first, down[at - 1], n), np.where(at < last, down[np.minimum(at + 1, n - 1)], n)
    held = np.r_[v, math.nan]
    top = np.ones(n, bool)
    for near in (left[:n], right[:n], above, below, left[above], right[above], left[below], right[below]):
        top &= v > held[near]
    return top


def multipass(image: DataFrame, o: Options = Options()) -> Outcome:
    """Catalog, discards, final residual and the history of a whole run.

    Stops when a pass from the third on adds no more than ``min_growth`` of the catalog.
    """
    spark = image.sparkSession
    image = materialize(level(image.select("y", "x", "v"), o.box), "image")
    catalog = spark.createDataFrame([], CATALOG)
    discards = spark.createDataFrame([], "id long, y double, x double, pass int, reason string")
    history, next_id = [], 0
    for turn in range(1, o.max_passes + 1):
        peaks = materialize(detect(image, o, catalog).withColumn("id", -1 - F.xxhash64("y", "x").bitwiseAND(F.lit((1 << 62) - 1))), "peaks")
        new = P.away_from(P.away_from(peaks, catalog, o.min_separation), discards, o.min_separation)
        new = P.greedy_suppress(materialize(new, "new"), o.min_separation)
        named = materialize(number(new, next_id).select("id", "y", "x", "flux", F.lit(math.nan).alias("flux_err"), F.lit(math.nan).alias("snr"), F.lit(turn).alias("pass")), "named")
        n_new = named.count()
        next_id += n_new
        fitted = materialize(fit_pass(catalog.unionByName(named), image, o), "fitted")
        strong = fitted.where((C("snr") >= o.prune_snr) & (C("flux") > 0))
        kept = P.greedy_suppress(materialize(strong.withColumn("rank", C("snr")), "strong"), o.prune_separation).drop("rank")
        before = catalog.count() + n_new
        catalog = materialize(kept, "catalog")
        weak = fitted.join(strong.select("id"), "id", "left_anti").select("id", "y", "x", F.lit(turn).alias("pass"), F.lit("snr").alias("reason"))
        close = strong.join(catalog.select("id"), "id", "left_anti").select("id", "y", "x", F.lit(turn).alias("pass"), F.lit("close").alias("reason"))
        discards = materialize(discards.unionByName(weak).unionByName(close), "discards")
        n = catalog.count()
        history.append({"pass": turn, "n_peaks": peaks.count(), "n_new": n_new, "n_pruned": before - n, "n_catalog": n})
        if not n_new or (turn >= 3 and n_new <= o.min_growth * n):
            break
    return Outcome(catalog, discards, subtract(image, catalog, o), history)


def number(df: DataFrame, start: int) -> DataFrame:
    """``df`` with ids from ``start`` in order of position, numbered without one task: ranges first, then places within them."""
    from pyspark.sql import Window

    slab = F.floor(C("y") / 256).cast("long")
    counts = {r["_s"]: r["n"] for r in df.groupBy(slab.alias("_s")).agg(F.count("*").alias("n")).collect()}  # one row for each slab of 256 image rows
    base, rows = start, []
    for s in sorted(counts):
        rows.append((s, base))
        base += counts[s]
    offsets = df.sparkSession.createDataFrame(rows, "_s long, _base long")
    placed = df.drop("id").withColumn("_s", slab).withColumn("_k", F.row_number().over(Window.partitionBy("_s").orderBy("y", "x")) - 1)
    return placed.join(offsets, "_s").withColumn("id", C("_base") + C("_k")).drop("_s", "_k", "_base")
