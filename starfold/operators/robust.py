"""Robust statistics of groups.

Groups of at most ``WHOLE`` rows are handled whole: tasks stream over sorted groups, or the built-in
exact percentile counts a group's values. A larger group keeps its rows where they are: clipping moves one
pair of bounds for each group, so a round is a scan, a join with the small table of bounds and an
aggregate, and medians are narrowed by counting bins with map-side combining. Results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize, ship

C = F.col
WHOLE = 1_000_000  # rows of a group that one task holds at most


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)


def quantiles(df: DataFrame, keys: list[str], value: str, q: float, limit: int | None = None, bins: int = 1024) -> DataFrame:
    """``keys, n, q``: the exact interpolated quantile of each group's finite values.

    Groups of at most ``limit`` rows (``WHOLE``) use the built-in exact percentile. A larger one is not
    gathered: its value range is cut into bins, counted with map-side combining, and narrowed to the bins that
    hold the two ranks around the quantile, until each holds a single value. Bins are of equal width and by logarithm in turn: the first narrow
    most data in few rounds, the second any data, as signs take one such round, powers of two two more, and the other digits six.
    """
    limit = limit or WHOLE
    df = df.where(finite(C(value)))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    large = sizes.where(C("_n") > limit)
    if not large.head(1):
        return df.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(value, F.lit(q)).alias("q"))
    small = df.join(large.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(value, F.lit(q)).alias("q"))
    rank = F.lit(q) * (C("_n") - 1)
    state = materialize(large.select(*keys, "_n", (rank - F.floor(rank)).alias("_part"), F.explode(F.array(F.floor(rank), F.ceil(rank))).alias("_rank"), C("_lo").cast("double").alias("_lo"), C("_hi").cast("double").alias("_hi"), F.lit(0).cast("long").alias("_below")).distinct(), "quantiles")
    turn = 0
    while state.where("_hi > _lo").head(1):
        turn += 1
        open_ = state.where("_hi > _lo")
        inside = df.join(open_, keys).where(C(value).between(C("_lo"), C("_hi")))
        held = inside.groupBy(*keys, "_rank", _slot(C(value).cast("double"), C("_lo"), C("_hi"), bins, turn % 2 == 0).alias("_slot")).agg(F.count("*").alias("_c"), F.min(value).cast("double").alias("_min"), F.max(value).cast("double").alias("_max"))
        run = F.sum("_c").over(Window.partitionBy(*keys, "_rank").orderBy("_slot"))
        placed = held.join(open_.select(*keys, "_rank", "_n", "_part", "_below"), [*keys, "_rank"]).withColumn("_to", C("_below") + run)
        hit = placed.where((C("_rank") < C("_to")) & (C("_rank") >= C("_to") - C("_c")))
        narrowed = hit.select(*keys, "_n", "_part", "_rank", C("_min").alias("_lo"), C("_max").alias("_hi"), (C("_to") - C("_c")).alias("_below"))
        state = materialize(narrowed.unionByName(state.where("_hi <= _lo")), "quantiles")
    ends = state.groupBy(*keys).agg(F.max("_n").alias("n"), F.max("_part").alias("_part"), F.min("_lo").alias("_a"), F.max("_lo").alias("_b"))
    between = F.when(C("_a") == C("_b"), C("_a")).otherwise((1 - C("_part")) * C("_a") + C("_part") * C("_b"))  # as the built-in percentile has it
    return materialize(small.unionByName(ends.select(*keys, "n", between.alias("q"))), "quantiles")


def _slot(v: Column, lo: Column, hi: Column, bins: int, by_logarithm: bool) -> Column:
    """The bin of a value in [lo, hi], never falling with the value: of equal width, or by sign where the range holds zero and by logarithm where its ends differ by more than a factor of 4."""
    steps = lambda x: F.greatest(F.lit(0), F.least(F.floor(x * bins), F.lit(bins - 1)))
    apart = lambda a, b: F.log2(a) - F.log2(b)
    even = steps((v - lo) / (hi - lo))
    by_sign = F.signum(v) + 1
    if not by_logarithm:
        return F.when(hi - lo < math.inf, even).otherwise(by_sign).cast("long")
    return (
        F.when((lo <= 0) & (hi >= 0), by_sign)
        .when((lo > 0) & (apart(hi, lo) > 2), steps(apart(v, lo) / apart(hi, lo)))
        .when((hi < 0) & (apart(-lo, -hi) > 2), bins - 1 - steps(apart(-v, -hi) / apart(-lo, -hi)))
        .otherwise(even)
        .cast("long")
    )


def medians(df: DataFrame, keys: list[str], value: str, name: str = "m") -> DataFrame:
    """``keys`` and the exact median of each group's finite values; null where there are none."""
    return quantiles(df, keys, value, 0.5).select(*keys, C("q").alias(name))


def overall(df: DataFrame, value: str, q: float = 0.5) -> float | None:
    """One exact quantile of a whole table."""
    row = quantiles(df.select(F.lit(1).alias("_all"), value), ["_all"], value, q).first()
    return row and row["q"]


def clip_bounds(df: DataFrame, keys: list[str], value: str, low: float = 3.0, high: float = 3.0, rounds: int = 10) -> DataFrame:
    """``keys, lo, hi``: inclusive bounds after iterative clipping around the median by population deviations about the mean."""
    rows = df.where(finite(C(value))).select(*keys, C(value).alias("_v"))
    large = materialize(rows.groupBy(*keys).count().where(C("count") > WHOLE).select(*keys), "clip-large")
    if not large.head(1):
        return _clip_whole(rows, keys, low, high, rounds)
    small = _clip_whole(rows.join(large, keys, "left_anti"), keys, low, high, rounds)
    return materialize(small.unionByName(_clip_spread(rows.join(large, keys, "left_semi"), keys, low, high, rounds)), "clip-bounds")


def _clip_whole(rows: DataFrame, keys: list[str], low: float, high: float, rounds: int) -> DataFrame:
    """Bounds of groups that a task can hold: one shuffle, and a stream over the sorted groups."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    ship(rows.sparkSession)

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            new = (rest[keys] != rest[keys].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield found(rest.iloc[: starts[-1]], starts[:-1])
                rest = rest.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield found(rest, np.array([0]))

    def found(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        kept = [clip_array(a, low, high, rounds) for a in np.split(part["_v"].to_numpy(), starts[1:])]
        return part.iloc[starts][keys].assign(lo=[a[0] for a in kept], hi=[a[-1] for a in kept])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(bounds, f"{kinds}, lo double, hi double")


def _clip_spread(rows: DataFrame, keys: list[str], low: float, high: float, rounds: int) -> DataFrame:
    """Bounds of groups whose rows stay where they are."""
    bounds = materialize(rows.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"), F.lit(True).alias("changed")), "clip-bounds")
    for _ in range(rounds):
        inside = rows.join(bounds.select(*keys, "lo", "hi"), keys).where(C("_v").between(C("lo"), C("hi"))).select(*keys, "_v")
        stats = inside.groupBy(*keys).agg(F.stddev_pop("_v").alias("s")).join(medians(inside, keys, "_v"), keys)
        limit = lambda by, end: F.when(C("s") > 0, C("m") + by * C("s")).otherwise(F.lit(end))
        moved = bounds.join(stats, keys).select(*keys, F.greatest("lo", limit(-low, -math.inf)).alias("lo"), F.least("hi", limit(high, math.inf)).alias("hi"), "n")
        left = rows.join(moved.select(*keys, "lo", "hi"), keys).where(C("_v").between(C("lo"), C("hi"))).groupBy(*keys).agg(F.count("*").alias("left"))
        bounds = materialize(moved.join(left, keys).select(*keys, "lo", "hi", C("left").alias("n"), (C("left") != C("n")).alias("changed")), "clip-bounds")
        if not bounds.where("changed").head(1):
            break
    return bounds.select(*keys, "lo", "hi")


def clipped(df: DataFrame, keys: list[str], value: str, **how: float) -> DataFrame:
    """The rows that survive clipping within their group."""
    return df.where(finite(C(value))).join(clip_bounds(df, keys, value, **how), keys).where(C(value).between(C("lo"), C("hi"))).drop("lo", "hi")


def clip_range(df: DataFrame, keys: list[str], value: str, low: float = 3.0, high: float = 3.0, least: int = 4) -> DataFrame:
    """``keys, n, lo, hi``: the survivors' median less ``low`` and plus ``high`` deviations; NaN where fewer than ``least`` survive."""
    kept = clipped(df, keys, value, low=low, high=high)
    s = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop(value).alias("s")).join(medians(kept, keys, value), keys)
    enough = lambda v: F.when(C("n") >= least, v).otherwise(F.lit(math.nan))
    return s.select(*keys, "n", enough(C("m") - low * C("s")).alias("lo"), enough(C("m") + high * C("s")).alias("hi"))


def about_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with their group's median ``m`` and unnormalised median absolute deviation ``s``."""
    near = df.join(medians(df, keys, value), keys)
    spreads = medians(near.select(*keys, F.abs(C(value) - C("m")).alias("_d")), keys, "_d", "s")
    return near.join(spreads, keys)


def locations(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, mode estimates and population deviation of each group."""
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).join(medians(df, keys, value, "median"), keys)
    return s.withColumns({"sextractor": mode_estimate(C("mean"), C("median"), C("std")), "mmm": 3 * C("median") - 2 * C("mean")})


def mode_estimate(mean: Column, median: Column, std: Column) -> Column:
    skewed = F.abs(mean - median) / F.when(std > 0, std) > 0.3
    return F.when(std <= 0, mean).when(skewed, median).otherwise(2.5 * median - 1.5 * mean)


def biweight(df: DataFrame, keys: list[str], value: str, c_location: float = 6.0, c_scale: float = 9.0) -> DataFrame:
    """Biweight location and scale of each group; the median and 0 where the deviation is 0."""
    d = C(value) - C("m")
    term = lambda c: 1 - F.pow(d / (c * F.when(C("s") > 0, C("s"))), 2)
    near = lambda c, x: F.sum(F.when(term(c) > 0, x))
    a, b = term(c_location), term(c_scale)
    sums = about_median(df, keys, value).groupBy(*keys).agg(
        F.first("m").alias("m"), F.first("s").alias("s"), F.count("*").alias("n"),
        near(c_location, d * a * a).alias("p"), near(c_location, a * a).alias("q"),
        near(c_scale, d * d * F.pow(b, 4)).alias("u"), near(c_scale, b * (5 * b - 4)).alias("w"),
    )
    return sums.select(
        *keys,
        F.when(C("s") > 0, C("m") + C("p") / C("q")).otherwise(C("m")).alias("location"),
        F.when(C("s") > 0, F.sqrt(C("n") * C("u")) / F.abs(C("w"))).otherwise(F.lit(0.0)).alias("scale"),
    )


def m_scale(df: DataFrame, keys: list[str], value: str, delta: float = 0.5, rounds: int = 30, tol: float = 1e-6) -> DataFrame:
    """Huber's proposal-2 scale: the sigma at which the mean of squares, capped at 3 sigma, is ``delta`` sigma squared."""
    df = materialize(df.select(*keys, value).hint("rebalance", *keys), "m-rows")  # a group's rows together, so that a round shuffles groups, not rows
    near = about_median(df, keys, value)
    state = materialize(near.groupBy(*keys).agg(F.greatest(1.4826 * F.first("s"), F.lit(2.0**-52)).alias("sigma")).withColumn("done", F.lit(False)), "m-scale")
    for _ in range(rounds):
        capped = df.join(state, keys).groupBy(*keys).agg(F.first("sigma").alias("sigma"), F.first("done").alias("done"), F.avg(F.least(C(value) * C(value), 9 * C("sigma") * C("sigma"))).alias("chi"))
        new = F.sqrt(C("chi") / delta)
        step = capped.select(*keys, F.when(C("done"), C("sigma")).otherwise(new).alias("sigma"), (C("done") | (F.abs(new - C("sigma")) < tol * C("sigma"))).alias("done"))
        state = materialize(step, "m-scale")
        if not state.where("not done").head(1):
            break
    return state.select(*keys, "sigma")


def clip_array(a: np.ndarray, low: float = 3.0, high: float = 3.0, rounds: int = 10) -> np.ndarray:
    """The finite values of a bounded array after iterative clipping, sorted."""
    a = np.sort(a[np.isfinite(a)])
    for _ in range(rounds):
        s = a.std() if len(a) else 0.0
        if not s:
            break
        m = np.median(a)
        kept = a[(a >= m - low * s) & (a <= m + high * s)]
        if len(kept) == len(a):
            break
        a = kept
    return a


def mode_of(a: np.ndarray) -> float:
    mean, med, std = a.mean(), np.median(a), a.std()
    if std <= 0:
        return float(mean)
    return float(med if abs(mean - med) / std > 0.3 else 2.5 * med - 1.5 * mean)


def mesh(pixels: DataFrame, box: tuple[int, int], exclude_percentile: float = 10.0, sigma: float = 3.0) -> DataFrame:
    """``mi, mj, n, bkg, rms`` for each box of the image: mode estimate and deviation about it after clipping.

    A box with fewer survivors than the percentile of its nominal size has NaN statistics. A box
    is a group of at most height x width pixels.
    """
    h, w = box
    least = exclude_percentile / 100 * h * w
    ship(pixels.sparkSession)

    def one(a: np.ndarray) -> tuple[int, float, float]:
        a = clip_array(a, sigma, sigma)
        if len(a) < least or not len(a):
            return len(a), math.nan, math.nan
        at = mode_of(a)
        return len(a), at, float(np.sqrt(((a - at) ** 2).mean()))

    def boxes(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n, bkg, rms = zip(*[one(a) for a in np.split(part["v"].to_numpy(), starts[1:])])
        return part.iloc[starts][["mi", "mj"]].assign(n=n, bkg=bkg, rms=rms)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            new = np.flatnonzero((batch[["mi", "mj"]] != batch[["mi", "mj"]].shift()).any(axis=1).to_numpy())
            if held and len(batch) and (held[-1][["mi", "mj"]].iloc[-1] == batch[["mi", "mj"]].iloc[0]).all():
                new = new[1:]  # the batch goes on with the box before
            if len(new):
                whole = pd.concat([*held, batch.iloc[: new[-1]]])
                if len(whole):
                    yield boxes(whole, np.flatnonzero((whole[["mi", "mj"]] != whole[["mi", "mj"]].shift()).any(axis=1).to_numpy()))
                held = [batch.iloc[new[-1] :]]
            elif len(batch):
                held.append(batch)
        if held:
            yield boxes(pd.concat(held), np.array([0]))

    cell = [F.floor((C("y") - 1) / h).cast("long").alias("mi"), F.floor((C("x") - 1) / w).cast("long").alias("mj")]
    return pixels.select(*cell, "v").repartition("mi", "mj").sortWithinPartitions("mi", "mj").mapInPandas(stream, "mi long, mj long, n long, bkg double, rms double")


def filled(grid: np.ndarray) -> np.ndarray:
    """NaN cells as the mean of their neighbours (those beyond the edge repeat it), row by row with cells filled before, until none is left; 0 if there is no value at all."""
    grid = grid.copy()
    if np.isnan(grid).all():
        return np.zeros_like(grid)
    rows, cols = grid.shape
    while len(open_ := np.argwhere(np.isnan(grid))):
        for i, j in open_.tolist():
            around = grid[np.ix_(np.clip([i - 1, i, i + 1], 0, rows - 1), np.clip([j - 1, j, j + 1], 0, cols - 1))]
            if not np.isnan(around).all():
                grid[i, j] = np.nanmean(around)
    return grid


def void_regions(voids: DataFrame) -> DataFrame:
    """``mi, mj, region`` of void boxes (``mi, mj, id``): the smallest id that is reached from box to neighbouring box.

    Each round takes the least region around a box, then the region of the box with that id, so rounds grow with the logarithm of a region's width.
    """
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    state = materialize(voids.select("mi", "mj", "id", C("id").alias("region")), "voids")
    while True:
        sent = state.select("mi", "mj", "region", F.explode(around).alias("a")).select((C("mi") + C("a.i")).alias("mi"), (C("mj") + C("a.j")).alias("mj"), "region")
        near = state.join(sent.groupBy("mi", "mj").agg(F.min("region").alias("_near")), ["mi", "mj"])
        root = state.select(C("id").alias("_near"), C("region").alias("_root"))
        new = materialize(near.join(root, "_near").select("mi", "mj", "id", C("_root").alias("new"), "region"), "voids")
        state = new.select("mi", "mj", "id", C("new").alias("region"))
        if not new.where("new <> region").head(1):
            return state.select("mi", "mj", "region")


def fill_mesh(mesh: DataFrame, values: tuple[str, ...] = ("bkg", "rms")) -> DataFrame:
    """``mi, mj`` and ``values`` of every box between the first and the last, with NaN or absent ones filled as ``filled`` does; 0 if there is no value at all.

    A void box is filled from boxes around it, so boxes of different connected void regions do not see each other: each
    region, with the boxes that border it, is a group of its own.
    """
    spark = mesh.sparkSession
    ship(spark)
    mesh = materialize(mesh.select("mi", "mj", *values), "mesh")
    low_i, high_i, low_j, high_j = mesh.agg(F.min("mi"), F.max("mi"), F.min("mj"), F.max("mj")).first()
    if low_i is None:
        return mesh
    rows, cols = high_i - low_i + 1, high_j - low_j + 1
    every = spark.range(rows * cols).select((F.expr(f"id div {cols}") + low_i).alias("mi"), (C("id") % cols + low_j).alias("mj"), "id")
    grid = materialize(every.join(mesh, ["mi", "mj"], "left").select("mi", "mj", "id", *[F.coalesce(v, F.lit(math.nan)).alias(v) for v in values]), "mesh")
    some = grid.agg(*[F.max(~F.isnan(v)).alias(v) for v in values]).first()
    grid = grid.select("mi", "mj", "id", *[C(v) if some[v] else F.lit(0.0).alias(v) for v in values])
    void = F.lit(False)
    for v in values:
        void = void | F.isnan(v)
    if not grid.where(void).head(1):
        return grid.drop("id")
    regions = void_regions(grid.where(void))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    seen = regions.select("region", F.explode(around).alias("a"), "mi", "mj").select("region", (C("mi") + C("a.i")).alias("mi"), (C("mj") + C("a.j")).alias("mj")).distinct()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        at = list(zip(pdf["mi"].tolist(), pdf["mj"].tolist()))
        out, was = {"mi": pdf["mi"], "mj": pdf["mj"]}, np.zeros(len(pdf), bool)
        for v in values:
            known = dict(zip(at, pdf[v].tolist()))
            was |= pdf[v].isna().to_numpy()
            open_ = sorted(k for k in at if math.isnan(known[k]))
            while open_:
                left = []
                for i, j in open_:
                    near = [known[(min(max(i + p, low_i), high_i), min(max(j + q, low_j), high_j))] for p in (-1, 0, 1) for q in (-1, 0, 1)]
                    near = [x for x in near if not math.isnan(x)]
                    if near:
                        known[(i, j)] = float(np.mean(near))
                    else:
                        left.append((i, j))
                open_ = left
            out[v] = [known[k] for k in at]
        return pd.DataFrame(out)[was]

    new = seen.join(grid, ["mi", "mj"]).groupBy("region").applyInPandas(fill, "mi long, mj long, " + ", ".join(f"{v} double" for v in values))
    return grid.where(~void).select("mi", "mj", *values).unionByName(new)
