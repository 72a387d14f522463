"""Normal equations of all sources of a frame as a table of blocks: own ones, and one for each pair whose stamps share pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, shuffled
from .measure import K, gaussian, on_image

C = F.col
PARTS = ("dy", "dx", "df")


def derivatives(sources: DataFrame, residual: DataFrame, fwhm: float, radius: int) -> DataFrame:
    """``id, py, px, r, dy, dx, df``: the residual and the model's derivatives by a source's y, x and flux at each pixel of its stamp, times the root of the weight ``w``."""
    met = on_image(sources, residual.where("w > 0"), radius)
    g, k = gaussian(C("dy"), C("dx"), fwhm), 2 * K / (fwhm * fwhm)
    root = F.sqrt("w")
    return met.select("id", "py", "px", (C("v") * root).alias("r"), (C("flux") * g * k * C("dy") * root).alias("dy"), (C("flux") * g * k * C("dx") * root).alias("dx"), (g * root).alias("df"))


def normal_equations(sources: DataFrame, residual: DataFrame, fwhm: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """``i, j, a_b`` for i <= j, sums of products of derivatives a of i and b of j over their common pixels, and ``i, g_a``, the gradient.

    ``sources`` has ``id, y, x, flux``, ``residual`` ``y, x, v, w``. A pixel meets as many sources as have it in their stamp.
    """
    d = materialize(derivatives(sources, residual, fwhm, radius), "derivatives")
    other = d.select(C("id").alias("j"), "py", "px", *[C(p).alias(f"_{p}") for p in PARTS])
    pairs = d.withColumnRenamed("id", "i").join(shuffled(other), ["py", "px"]).where("i <= j")
    blocks = pairs.groupBy("i", "j").agg(*[F.sum(C(a) * C(f"_{b}")).alias(f"{a}_{b}") for a in PARTS for b in PARTS])
    return blocks, d.groupBy(C("id").alias("i")).agg(*[F.sum(C(a) * C("r")).alias(f"g_{a}") for a in PARTS])


def solve(blocks: DataFrame, gradient: DataFrame, damp: float = 0.0, tol: float = 1e-8) -> DataFrame:
    """``i, s_dy, s_dx, s_df``: the step of (blocks + damp) s = gradient for all sources at once, by conjugate gradients over the table of blocks.

    Parameters are scaled to a unit diagonal. A round is a join of the blocks with the direction, an aggregate, and two sums over the sources; it ends when
    the residual is ``tol`` of its first size, or no descent is left within rounding.
    """
    own = blocks.where("i = j").select("i", *[F.when(C(f"{a}_{a}") > 0, F.sqrt(f"{a}_{a}")).otherwise(1.0).alias(f"n_{a}") for a in PARTS])
    right = own.select(C("i").alias("j"), *[C(f"n_{a}").alias(f"m_{a}") for a in PARTS])
    unit = blocks.join(shuffled(own), "i").join(shuffled(right), "j").select("i", "j", *[(C(f"{a}_{b}") / (C(f"n_{a}") * C(f"m_{b}"))).alias(f"{a}_{b}") for a in PARTS for b in PARTS])
    mirrored = unit.where("i < j").select(C("j").alias("i"), C("i").alias("j"), *[C(f"{b}_{a}").alias(f"{a}_{b}") for a in PARTS for b in PARTS])
    h = materialize(unit.unionByName(mirrored), "blocks")
    state = own.join(gradient, "i").select("i", *[F.lit(0.0).alias(f"s_{a}") for a in PARTS], *[(C(f"g_{a}") / C(f"n_{a}")).alias(f"r_{a}") for a in PARTS])
    state = materialize(state.select("*", *[C(f"r_{a}").alias(f"d_{a}") for a in PARTS]), "state")
    dot = lambda p, q: F.sum(sum((C(f"{p}_{a}") * C(f"{q}_{a}") for a in PARTS[1:]), C(f"{p}_{PARTS[0]}") * C(f"{q}_{PARTS[0]}")))
    rr = first = state.agg(dot("r", "r")).first()[0] or 0.0
    while rr > tol * tol * first:
        d = state.select(C("i").alias("j"), *[C(f"d_{a}").alias(f"e_{a}") for a in PARTS])
        moved = h.join(d, "j").groupBy("i").agg(*[F.sum(sum((C(f"{a}_{b}") * C(f"e_{b}") for b in PARTS[1:]), C(f"{a}_{PARTS[0]}") * C(f"e_{PARTS[0]}"))).alias(f"q_{a}") for a in PARTS])
        with_q = materialize(state.join(moved, "i").withColumns({f"q_{a}": C(f"q_{a}") + damp * C(f"d_{a}") for a in PARTS}), "state")
        bend = with_q.agg(dot("d", "q")).first()[0]
        if bend <= 0:
            break
        a_ = rr / bend
        stepped = with_q.select("i", *[(C(f"s_{p}") + a_ * C(f"d_{p}")).alias(f"s_{p}") for p in PARTS], *[(C(f"r_{p}") - a_ * C(f"q_{p}")).alias(f"r_{p}") for p in PARTS], *[C(f"d_{p}") for p in PARTS])
        rr, old = stepped.agg(dot("r", "r")).first()[0], rr
        state = stepped.select("i", *[f"s_{p}" for p in PARTS], *[f"r_{p}" for p in PARTS], *[(C(f"r_{p}") + rr / old * C(f"d_{p}")).alias(f"d_{p}") for p in PARTS])
        state = materialize(state, "state")
    return state.join(own, "i").select("i", *[(C(f"s_{p}") / C(f"n_{p}")).alias(f"s_{p}") for p in PARTS])
