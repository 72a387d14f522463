"""Range joins of positions: pairs within a radius, nearest, anti joins, greedy suppression.

Positions are put in square cells as wide as the radius; one side is repeated for the 3 x 3
cells around it, and the join is an equi-join on the cell. The work follows the number of
neighbours, not the square of the catalog. Positions that are not finite match nothing.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize, shuffled, spread

C = F.col


def placed(points: DataFrame) -> DataFrame:
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    return points.where(ok(C("y")) & ok(C("x")))


def cell(c: Column, r: float) -> Column:
    return F.floor(c / r).cast("long")


def cross_pairs(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """``a_id, b_id, d2`` for all pairs at most ``r`` apart; both sides have ``id, y, x``."""
    left = placed(a).select(C("id").alias("a_id"), C("y").alias("ay"), C("x").alias("ax"), cell(C("y"), r).alias("cy"), cell(C("x"), r).alias("cx"))
    around = F.array(*[F.struct((cell(C("y"), r) + dy).alias("cy"), (cell(C("x"), r) + dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    right = spread(placed(b)).select(C("id").alias("b_id"), C("y").alias("by"), C("x").alias("bx"), F.inline(around))
    d2 = (C("ay") - C("by")) * (C("ay") - C("by")) + (C("ax") - C("bx")) * (C("ax") - C("bx"))
    return left.join(shuffled(right), ["cy", "cx"]).select("a_id", "b_id", d2.alias("d2")).where(C("d2") <= r * r)


def pairs_within(points: DataFrame, r: float) -> DataFrame:
    """``i, j, d2`` for all pairs with i < j at most ``r`` apart."""
    return cross_pairs(points, points, r).where("a_id < b_id").select(C("a_id").alias("i"), C("b_id").alias("j"), "d2")


def nearest_within(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """For each id of ``a`` the nearest of ``b`` within ``r`` (ties: the smaller id), or null."""
    best = cross_pairs(a, b, r).groupBy("a_id").agg(F.min(F.struct("d2", "b_id")).alias("m"))
    return a.select("id").join(shuffled(best), C("id") == C("a_id"), "left").select("id", C("m.b_id").alias("nearest"), C("m.d2").alias("d2"))


def away_from(points: DataFrame, others: DataFrame, r: float) -> DataFrame:
    """The points with no other within ``r`` (inclusive)."""
    near = cross_pairs(points.select("id", "y", "x"), others.select("id", "y", "x"), r).select(C("a_id").alias("id")).distinct()
    return points.join(shuffled(near), "id", "left_anti")


def overlap_pairs(points: DataFrame, reach: int, cap: int) -> DataFrame:
    """Pairs of points whose stamps overlap (both offsets at most ``2 * reach``), kept if one is among the other's ``cap`` nearest."""
    r = float(2 * reach)
    at = points.select("id", F.rint("y").alias("y"), F.rint("x").alias("x"))
    wide = cross_pairs(at, at, r * math.sqrt(2)).where("a_id <> b_id")
    side = lambda s: shuffled(at.select(C("id").alias(f"{s}_id"), C("y").alias(f"{s}y"), C("x").alias(f"{s}x")))
    both = wide.join(side("a"), "a_id").join(side("b"), "b_id")
    near = both.where((F.abs(C("ay") - C("by")) <= r) & (F.abs(C("ax") - C("bx")) <= r)).select("a_id", "b_id", C("d2").alias("r2"))
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("a_id").orderBy("r2", "b_id"))).where(C("k") <= cap)
    return ranked.select(F.least("a_id", "b_id").alias("i"), F.greatest("a_id", "b_id").alias("j")).distinct()


def greedy_suppress(points: DataFrame, r: float, strict: bool = False, rounds: int | None = None) -> DataFrame:
    """The points that a visit in order of falling ``rank`` accepts: those with no accepted point within ``r``.

    Ties of rank go to the smaller id. Equal to the sequential visit: in each round, every
    undecided point without an undecided better neighbour is accepted and its neighbours are
    dropped; the rounds follow the longest chain of falling neighbours, not the catalog. They go
    on until no pair is open; a limit that is hit, or ranks without an order, are an error.
    """
    pairs = pairs_within(points, r)
    if strict:
        pairs = pairs.where(C("d2") < r * r)
    rank = points.select("id", "rank")
    ranked = pairs.join(shuffled(rank.select(C("id").alias("i"), C("rank").alias("ri"))), "i").join(shuffled(rank.select(C("id").alias("j"), C("rank").alias("rj"))), "j")
    first = C("ri") >= C("rj")  # i < j
    edges = materialize(ranked.select(F.when(first, C("i")).otherwise(C("j")).alias("better"), F.when(first, C("j")).otherwise(C("i")).alias("worse")), "suppress-edges")
    open_, dropped = edges, None
    for k in count():
        if not open_.head(1):
            break
        if k == rounds:
            raise RuntimeError(f"pairs are still open after {rounds} rounds")
        held = open_.select(C("worse").alias("id")).distinct()
        accepted = open_.select(C("better").alias("id")).distinct().join(held, "id", "left_anti")
        out = materialize(open_.join(accepted, C("better") == C("id"), "left_semi").select(C("worse").alias("id")).distinct(), "suppress-dropped")
        if not out.head(1):
            raise ValueError("ranks have no order")
        open_ = materialize(open_.join(out, C("worse") == C("id"), "left_anti").join(out, C("better") == C("id"), "left_anti"), "suppress-open")
        dropped = out if dropped is None else dropped.unionByName(out)
    return points if dropped is None else points.join(dropped, "id", "left_anti")
