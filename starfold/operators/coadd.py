"""Coaddition of mapped images on a common grid: square drops of any orientation, rejection of outliers, noise maps.

A pixel is dropped on every output node that it overlaps. The node's square, mapped into the image, is a parallelogram; its
overlap with the drop is a closed expression of its four edges, so a coadd is one explode and two aggregates, the first of them by
(band, node, image). Rejection ranks the images of a node (a stack), not pixels of an image.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize, parts

C = F.col
NODE = ["band", "r", "c"]
VALUES = ("data", "background", "model", "residual")
QUANTITIES = (*VALUES, "rms", "rms_aperture", "weight", "nimg")
PIXELS = 100_000  # pixels whose drops one task holds


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once: a generator keeps filters and projections above from being merged into it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _ramp_mean(p: Column, q: Column, h: Column) -> Column:
    """Mean of a line from p to q, clamped to [0, h]."""
    low, high = F.least(p, q), F.greatest(p, q)
    a, b = F.least(F.greatest(low, F.lit(0.0)), h), F.least(F.greatest(high, F.lit(0.0)), h)
    part = ((b - a) * (a + b) / 2 + F.greatest(high - F.greatest(h, low), F.lit(0.0)) * h) / (high - low)
    return F.when(high > low, part).otherwise(a)


def polygon_overlap(df: DataFrame, corners: list[tuple[Column, Column]], half: float, name: str) -> DataFrame:
    """``df`` with the area that a convex polygon (corners y, x in order) shares with the square of side ``2 half`` about the origin.

    The area below each edge, within the square, is summed with the sign of the edge's direction.
    """
    df = step(df, **{f"_{k}{n}": c for n, corner in enumerate(corners) for k, c in zip("yx", corner)})
    edges = [(n, (n + 1) % len(corners)) for n in range(len(corners))]
    ends = {}
    for n, (a, b) in enumerate(edges):
        ends[f"_l{n}"] = F.greatest(F.least(C(f"_x{a}"), C(f"_x{b}")), F.lit(-half))
        ends[f"_r{n}"] = F.least(F.greatest(C(f"_x{a}"), C(f"_x{b}")), F.lit(half))
    df = step(df, **ends)
    y_at = lambda a, b, x: C(f"_y{a}") + (C(f"_y{b}") - C(f"_y{a}")) * (x - C(f"_x{a}")) / (C(f"_x{b}") - C(f"_x{a}")) + half
    df = step(df, **{f"_{k}{n}": F.when(C(f"_r{n}") > C(f"_l{n}"), y_at(a, b, C(f"_{side}{n}"))) for n, (a, b) in enumerate(edges) for k, side in (("p", "l"), ("q", "r"))})
    df = step(df, **{f"_m{n}": _ramp_mean(C(f"_p{n}"), C(f"_q{n}"), F.lit(2 * half)) for n in range(len(edges))})
    parts = [F.coalesce((C(f"_r{n}") - C(f"_l{n}")) * C(f"_m{n}") * F.signum(C(f"_x{b}") - C(f"_x{a}")), F.lit(0.0)) for n, (a, b) in enumerate(edges)]
    scratch = [f"_{k}{n}" for k in "yxlrpqm" for n in range(len(corners))]
    return step(df, **{name: F.abs(sum(parts[1:], parts[0]))}).drop(*scratch)


def poly_with_slopes(coefficients: Column, u: Column, v: Column, degree: int) -> tuple[Column, Column, Column]:
    """Value and both derivatives of a bivariate polynomial up to ``degree``: ``coefficients[i][j]`` belongs to u^i v^j, and what is absent is 0."""
    k = [[F.coalesce(F.get(F.get(coefficients, F.lit(i)), F.lit(j)), F.lit(0.0)) for j in range(degree + 1 - i)] for i in range(degree + 1)]

    def horner(parts: list[Column], z: Column) -> Column:
        out = parts[-1]
        for p in reversed(parts[:-1]):
            out = out * z + p
        return out

    slope = lambda parts: [n * p for n, p in enumerate(parts)][1:] or [F.lit(0.0)]
    rows = [horner(r, v) for r in k]
    return horner(rows, u), horner(slope(rows), u), horner([horner(slope(r), v) for r in k], u)


def placed_nodes(pixels: DataFrame, images: DataFrame, degree: int = 1, pixfrac: float = 1.0, tasks: int | None = None) -> DataFrame:
    """``pixels`` (``image, y, x`` and more) once for every node ``r, c`` that its drop overlaps, with ``band, flux_scale``, ``a``, the overlap in output pixels, and ``f``, the node's area in image pixels.

    ``images`` has ``image, band, flux_scale`` and the map of the grid into the image: ``my, mx``, the coefficients for the image's y and x as
    polynomials in ``(r - r0) / extent`` and ``(c - c0) / extent``, which lie in [-1, 1] on the image's part of the grid. Nodes beyond that part get
    nothing. The node is looked for around the pixel's place by the linear terms, as far as the others can move it.
    An image's pixels go to its map in slices, so that ``tasks`` (the session's shuffle partitions) are alike, however few images there are.
    """
    if not 0 < pixfrac <= 1:
        raise ValueError(f"pixfrac must be in (0, 1], got {pixfrac}")
    at = lambda name, i, j: F.coalesce(F.get(F.get(C(name), F.lit(i)), F.lit(j)), F.lit(0.0))
    bend = lambda name: sum((F.abs(at(name, i, j)) for i in range(degree + 1) for j in range(degree + 1 - i) if i + j > 1), F.lit(0.0))
    tilt = lambda name: sum(((i + j) * F.abs(at(name, i, j)) for i in range(degree + 1) for j in range(degree + 1 - i) if i + j > 1), F.lit(0.0))
    yr, yc, xr, xc = at("my", 1, 0), at("my", 0, 1), at("mx", 1, 0), at("mx", 0, 1)
    det = yr * xc - yc * xr
    # the image's corners of a node lie within (slope + tilt) / 2 of its centre; the linear inverse takes that, the drop and the bend back to the grid
    wide_y, wide_x = ((F.abs(a) + F.abs(b) + 2 * tilt(n)) / (2 * C("extent")) + bend(n) + pixfrac / 2 for a, b, n in ((yr, yc, "my"), (xr, xc, "mx")))
    inverse = {"_rr": C("r0") - C("extent") * (at("my", 0, 0) * xc - at("mx", 0, 0) * yc) / det, "_ry": C("extent") * xc / det, "_rx": -C("extent") * yc / det, "_cc": C("c0") + C("extent") * (at("my", 0, 0) * xr - at("mx", 0, 0) * yr) / det, "_cy": -C("extent") * xr / det, "_cx": C("extent") * yr / det}
    maps = images.select("*", *[e.alias(n) for n, e in inverse.items()], wide_y.alias("_wy"), wide_x.alias("_wx"))
    maps = maps.withColumns({"_wr": F.abs("_ry") * C("_wy") + F.abs("_rx") * C("_wx"), "_wc": F.abs("_cy") * C("_wy") + F.abs("_cx") * C("_wx")})
    centre = {"_r": C("_rr") + C("_ry") * C("y") + C("_rx") * C("x"), "_c": C("_cc") + C("_cy") * C("y") + C("_cx") * C("x")}


    def span(at: str, wide: str, middle: str) -> Column:
        first = F.ceil(F.greatest(C(at) - C(wide), C(middle) - C("extent"))).cast("long")
        last = F.floor(F.least(C(at) + C(wide), C(middle) + C("extent"))).cast("long")
        return F.when(last >= first, F.sequence(first, last))

    tasks = tasks or parts(pixels)
    slices = 16 * -(-tasks // max(1, images.count()))
    dealt = pixels.withColumn("_slice", F.pmod(F.hash("y", "x"), F.lit(slices))).repartition(tasks, "image", "_slice")
    sliced = maps.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    rows = dealt.join(sliced.hint("shuffle_hash"), ["image", "_slice"]).withColumns(centre)
    rows = rows.select("*", F.explode(span("_r", "_wr", "r0")).alias("r")).select("*", F.explode(span("_c", "_wc", "c0")).alias("c"))
    u, v = (C("r") - C("r0")) / C("extent"), (C("c") - C("c0")) / C("extent")
    (ny, nyu, nyv), (nx, nxu, nxv) = poly_with_slopes(C("my"), u, v, degree), poly_with_slopes(C("mx"), u, v, degree)
    rows = step(rows.where((F.abs(u) <= 1) & (F.abs(v) <= 1)), _y=ny - C("y"), _x=nx - C("x"), _ya=nyu / C("extent"), _yb=nyv / C("extent"), _xa=nxu / C("extent"), _xb=nxv / C("extent"))
    corners = [(C("_y") + (i * C("_ya") + j * C("_yb")) / 2, C("_x") + (i * C("_xa") + j * C("_xb")) / 2) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    rows = polygon_overlap(step(rows, f=F.abs(C("_ya") * C("_xb") - C("_yb") * C("_xa"))), corners, pixfrac / 2, "_share")
    return rows.where("_share > 0 AND f > 0").select(*pixels.columns, "band", "flux_scale", "r", "c", "f", (C("_share") / C("f")).alias("a"))


def usable(pixels: DataFrame, weight: str) -> DataFrame:
    """``image, y, x`` with ``w`` (for averages), ``iv`` (the given inverse variance) and the values, of the pixels that count: finite values and finite positive weights.

    ``weight`` is ``rms`` (1 / rms^2) or ``input``; an absent background or model is 0.
    """
    have = set(pixels.columns)
    background, model = (C(n).cast("double") if n in have else F.lit(0.0) for n in ("background", "model"))
    data, iv = C("data").cast("double"), C("weight").cast("double")
    signal = model if "model" in have else F.greatest(data - background, F.lit(0.0))
    w = {"rms": lambda: F.try_divide(F.lit(1.0), C("rms") * C("rms")), "input": lambda: iv}
    if weight not in w:
        raise ValueError(f"weight must be one of {sorted(w)}, got {weight!r}")
    rows = pixels.select("image", "y", "x", w[weight]().alias("w"), iv.alias("iv"), data.alias("data"), background.alias("background"), model.alias("model"), (data - background - model).alias("residual"), signal.alias("signal"))
    good = F.lit(True)
    for n in ("w", "iv", "data", "background", "model"):
        good = good & C(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < math.inf)
    return rows.where(good & (C("w") > 0) & (C("iv") > 0))


def stack_sums(drops: DataFrame, weight: str, values: tuple[str, ...]) -> DataFrame:
    """For each image at each node: ``W`` = sum of a w', ``V`` = sum of a^2 w', and ``s_<value>``, sums of a w' value, in the band's units."""
    scale = C("f") / C("flux_scale")
    aw = C("a") * C(weight) / (scale * scale)
    return drops.groupBy(*NODE, "image").agg(F.sum(aw).alias("W"), F.sum(C("a") * aw).alias("V"), *[F.sum(aw * scale * C(v)).alias(f"s_{v}") for v in values])


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, name: str = "med") -> DataFrame:
    """Rows with the lower weighted median of their group: the least value at which the weights up to it reach half of all."""
    order = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    half = rows.withColumn("_run", F.sum(weight).over(order)).withColumn("_half", F.sum(weight).over(whole) / 2)
    return half.withColumn(name, F.min(F.when(C("_run") >= C("_half"), C(value))).over(whole)).drop("_run", "_half")


def rejected(drops: DataFrame, k: float, mu: float = 0.003, least: int = 5) -> DataFrame:
    """``band, r, c, image``: images whose resampled residual is further from the weighted median of their stack than ``k`` deviations of the difference.

    Variances are those of the given weights, and ``mu`` times the square of the model for imperfect models of bright sources. Stacks of
    fewer than ``least`` images are left alone.
    """
    sums = stack_sums(drops, "iv", ("residual", "signal"))
    signal = F.greatest(C("s_signal") / C("W"), F.lit(0.0))
    rows = sums.select(*NODE, "image", (C("s_residual") / C("W")).alias("x"), (C("V") / (C("W") * C("W")) + mu * signal * signal).alias("v")).withColumn("p", 1 / C("v"))
    whole = Window.partitionBy(*NODE)
    judged = weighted_median(rows, NODE, "x", "p").withColumns({"_n": F.count("*").over(whole), "_p": F.sum("p").over(whole)})
    far = C("x") - C("med")
    return judged.where((C("_n") >= least) & (far * far > k * k * (C("v") + math.pi / 2 / C("_p")))).select(*NODE, "image")


def grown(marks: DataFrame, by: int) -> DataFrame:
    """Marked nodes and those within ``by`` rows and columns of them."""
    if not by:
        return marks
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-by, by + 1) for j in range(-by, by + 1)])
    return marks.select("*", F.inline(steps)).select("band", (C("r") + C("i")).alias("r"), (C("c") + C("j")).alias("c"), "image").distinct()


def aperture_variance(drops: DataFrame, pixfrac: float, weight: str = "w") -> DataFrame:
    """``band, r, c, VA``: each drop's part in the variance of any sum that holds all of it, w' G^2 with G = sum of a / W over its nodes, shared among them by overlap."""
    scale = C("f") / C("flux_scale")
    rows = drops.select(*NODE, "image", "y", "x", "a", (C(weight) / (scale * scale)).alias("_w"), (pixfrac * pixfrac / C("f")).alias("_A"))
    totals = rows.groupBy(*NODE).agg(F.sum(C("a") * C("_w")).alias("_total"))
    reach = rows.join(totals, NODE).groupBy("image", "y", "x").agg(F.sum(C("a") / C("_total")).alias("_G"))
    return rows.join(reach, ["image", "y", "x"]).groupBy(*NODE).agg(F.sum(C("a") * C("_w") / C("_A") * C("_G") * C("_G")).alias("VA"))


def coadd(pixels: DataFrame, images: DataFrame, quantities: tuple[str, ...] = ("data",), weight: str = "rms", pixfrac: float = 1.0, degree: int = 1, brightness: tuple[float, float, float] | None = None, clip: float | None = None, clip_grow: int = 1, clip_mu: float = 0.003, clip_least: int = 5) -> DataFrame:
    """``band, r, c`` and the ``quantities`` of every node with data.

    Values are weighted means in the band's flux units for each output pixel, or for each square arcsecond with ``brightness`` = (central row, central
    column, pixel scale in arcseconds) of a gnomonic grid. ``rms`` is the noise of a node, ``rms_aperture`` that of sums over wide areas, without
    rejection; ``weight`` the total weight; ``nimg`` the number of images. ``clip`` rejects by ``rejected``, and also nodes within ``clip_grow`` of a rejected one of the same image.
    """
    if bad := set(quantities) - set(QUANTITIES):
        raise ValueError(f"unknown quantities {sorted(bad)}; there are {QUANTITIES}")
    if "model" in quantities and "model" not in pixels.columns:
        raise ValueError("quantity model needs a column model")
    counted = usable(pixels, weight)
    tasks = parts(counted, PIXELS)
    drops = placed_nodes(counted, images, degree, pixfrac, tasks)
    twice = clip is not None or "rms_aperture" in quantities
    drops = materialize(drops, "drops") if twice else drops
    by_node = drops.repartition(tasks, *NODE)  # one shuffle, for the sums of an image at a node and for those of a node
    values = tuple(v for v in VALUES if v in quantities)
    sums = stack_sums(by_node, "w", values)
    if clip is not None:
        sums = sums.join(grown(rejected(by_node, clip, clip_mu, clip_least), clip_grow), [*NODE, "image"], "left_anti")
    out = sums.groupBy(*NODE).agg(F.count("*").alias("nimg"), *[F.sum(c).alias(c) for c in ("W", "V", *[f"s_{v}" for v in values])])
    if "rms_aperture" in quantities:
        out = out.join(aperture_variance(drops, pixfrac), NODE)
    u = F.lit(1.0)
    if brightness:
        cy, cx, scale = brightness
        u = F.pow(1 + math.radians(scale / 3600) ** 2 * ((C("r") - cy) * (C("r") - cy) + (C("c") - cx) * (C("c") - cx)), F.lit(1.5)) / (scale * scale)
    made: dict[str, Callable[[], Column]] = {v: (lambda v=v: C(f"s_{v}") / C("W") * u) for v in VALUES} | {"rms": lambda: F.sqrt("V") / C("W") * u, "rms_aperture": lambda: F.sqrt("VA") * u, "weight": lambda: C("W") / (u * u), "nimg": lambda: C("nimg")}
    return out.select(*NODE, *[made[q]().alias(q) for q in quantities])
