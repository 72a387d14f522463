"""Many images at once: band statistics, coaddition, tiles with halos, and selection of stars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import nan, ratio
from .robust import medians, overall

C = F.col


def fold_bands(sums: DataFrame, node: list[str]) -> DataFrame:
    """Cross-band statistic of each node from its band sums ``n, d, v`` and weight ``w``: nu and the bands that count."""
    good = (C("d") > 0) & (C("v") > 0)
    nu = F.when(good, C("n") / F.sqrt(F.when(good, C("v"))))
    folded = sums.groupBy(*node).agg(F.sum(C("w") * nu).alias("num"), F.sum(F.when(good, C("w") * C("w"))).alias("den"), F.count(nu).alias("bands"))
    return folded.select(*node, ratio(C("num"), F.sqrt(F.coalesce("den", F.lit(0.0)))).alias("nu"), "bands")


def drizzle(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap coaddition of axis-aligned pixels: ``oy, ox`` is a pixel's centre on the output grid, ``v, w`` its value and weight.

    Each input pixel is dropped on the at most four output pixels that it overlaps; each output pixel
    is the mean weighted by overlap and weight.
    """
    corner = lambda c: F.floor(c)
    fy, fx = C("oy") - corner(C("oy")), C("ox") - corner(C("ox"))
    drops = F.array(*[F.struct((corner(C("oy")) + i).cast("long").alias("y"), (corner(C("ox")) + j).cast("long").alias("x"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("a")) for i in (0, 1) for j in (0, 1)])
    each = pixels.select(*keys, "image", "v", "w", F.inline(drops)).where((C("a") > 0) & (C("w") > 0))
    aw = C("a") * C("w")
    out = each.groupBy(*keys, "y", "x").agg(F.sum(aw * C("v")).alias("s"), F.sum(aw).alias("weight"), F.sum(C("a") * aw).alias("q"), F.count_distinct("image").alias("nimg"))
    return out.select(*keys, "y", "x", ratio(C("s"), C("weight")).alias("value"), ratio(F.sqrt("q"), C("weight")).alias("rms"), "weight", "nimg")


def clip_stack(pixels: DataFrame, keys: list[str], k: float, least: int = 5) -> DataFrame:
    """Rows of a stack (``v, w`` for each of ``keys``) without those far from the median, where enough images cover the place."""
    centre = pixels.groupBy(*keys).agg(F.median("v").alias("_m"), F.count("*").alias("_n"))
    far = F.abs(C("v") - C("_m")) * F.sqrt("w") > k
    return pixels.join(centre, keys).where(~(far & (C("_n") >= least))).drop("_m", "_n")


def tiles_of(pixels: DataFrame, core: int, halo: int) -> DataFrame:
    """``ty, tx, owned``: each pixel once for every tile whose padded box holds it."""
    span = lambda c: F.sequence(F.floor((C(c) - 1 - halo) / core).cast("long"), F.floor((C(c) - 1 + halo) / core).cast("long"))
    rows = pixels.select("*", F.explode(span("y")).alias("ty")).select("*", F.explode(span("x")).alias("tx"))
    owned = (C("ty") == F.floor((C("y") - 1) / core)) & (C("tx") == F.floor((C("x") - 1) / core))
    last = pixels.agg(F.floor((F.max("y") - 1) / core).alias("_my"), F.floor((F.max("x") - 1) / core).alias("_mx")).first()
    return rows.where((C("ty") >= 0) & (C("tx") >= 0) & (C("ty") <= last["_my"]) & (C("tx") <= last["_mx"])).withColumn("owned", owned)


def model_radius(flux: Column, sigma: float, nsigma: float, profile: list[float]) -> Column:
    """The smallest radius (index from 1) at which the flux times the profile falls to nsigma sigma; the last one if none."""
    out = F.lit(len(profile))
    for r in range(len(profile), 0, -1):
        out = F.when(flux * profile[r - 1] <= nsigma * sigma, r).otherwise(out)
    return out


def flux_law(u: Column, kind: str, low: float, high: float, alpha: float = 2.0) -> Column:
    """A flux from a uniform number in [0, 1)."""
    if kind == "uniform":
        return low + u * (high - low)
    if kind == "loguniform" or (kind == "powerlaw" and abs(alpha - 1) < 1e-9):
        return F.exp(math.log(low) + u * math.log(high / low))
    if kind == "powerlaw":
        q = 1 - alpha
        return F.pow(low**q + u * (high**q - low**q), F.lit(1 / q))
    raise ValueError(f"unknown flux law {kind}")


def poly_map(cy: list[list[float]], u: Column, v: Column) -> Column:
    """A bivariate polynomial, rows by powers of u, columns by powers of v, in Horner form."""
    total = F.lit(0.0)
    for row in reversed(cy):
        inner = F.lit(0.0)
        for c in reversed(row):
            inner = inner * v + c
        total = total * u + inner
    return total


def pick_stars(stars: DataFrame, faint: float, bins: int, value: str, k: float) -> DataFrame:
    """Stars above a flux quantile whose ``value`` lies within k deviations of the median of their brightness bin."""
    cut = overall(stars, "flux", faint)
    bright = stars.where(C("flux") >= (cut if cut is not None else 0.0))
    lo, hi = bright.agg(F.min("flux"), F.max("flux")).first()
    step = ((hi or 1.0) - (lo or 0.0)) / bins or 1.0
    binned = bright.withColumn("_bin", F.least(F.floor((C("flux") - (lo or 0.0)) / step), F.lit(bins - 1)))
    stats = binned.groupBy("_bin").agg(F.stddev_pop(value).alias("_s"), F.count("*").alias("_n")).join(medians(binned, ["_bin"], value, "_m"), "_bin")
    return binned.join(stats, "_bin").where((C("_n") >= 4) & (F.abs(C(value) - C("_m")) <= k * C("_s"))).drop("_bin", "_m", "_s", "_n")


def worst_first(df: DataFrame, score: str, fraction: float, limit: float) -> DataFrame:
    """``df`` without the rows above ``limit``, the worst first (of equal ones the smallest id), but never more than a share of all.

    Where the share binds, the score at its end comes from an exact quantile, so that only rows of
    that very score are ranked.
    """
    most = math.ceil(fraction * df.count())
    above = df.where(C(score) > limit)
    n = above.count()
    if n <= most:
        return df.join(above.select("id"), "id", "left_anti")
    if not most:
        return df
    cut = overall(above, score, (n - most - 0.5) / (n - 1))  # between the last row to go and the next, or both their score
    worse = above.where(C(score) > cut)
    tied = above.where(C(score) == cut).orderBy("id").limit(most - worse.count())
    return df.join(worse.select("id").unionByName(tied.select("id")), "id", "left_anti")


def missing_columns(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both, by name; a float column that one side lacks is NaN there."""
    both = df.unionByName(other, allowMissingColumns=True)
    gaps = set(df.columns) ^ set(other.columns)
    return both.select(*[F.coalesce(c, nan()).alias(c) if c in gaps else C(c) for c in both.columns])


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the first place of each."""
    return df.groupBy(value).agg(F.min(order).alias("first"))


def top_coupled(pairs: DataFrame, k: int) -> DataFrame:
    """For each source its k neighbours of the largest coupling."""
    w = Window.partitionBy("i").orderBy(F.desc("coupling"), "j")
    return pairs.withColumn("place", F.row_number().over(w)).where(C("place") <= k)
