"""Places and running sums within groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

C = F.col


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns of one name on both sides."""
    met = F.lit(True)
    for n in names:
        met = met & left[n].eqNullSafe(right[n])
    return met


def placed(df: DataFrame, group: str, order: list[Column], weight: str | None = None) -> DataFrame:
    """``df`` with ``at``, each row's place from 0 within its ``group`` (null is one too) in ``order``, ``group_n`` and, given ``weight``, ``before`` and ``group_sum``.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks. A row's place is that in
    its task plus the counts of the tasks before, which form a table of one row for each task and group met there.
    ``order`` must be total but for equal rows. Groups ascend, null first, unless the first of ``order`` sorts ``group`` itself.
    """
    keys = [C(group), *order]
    dealt = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), "placed")
    dealt = dealt.withColumn("_task", F.shiftright("_row", 33))
    sums = [F.min("_row").alias("_first"), F.count("*").alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    tasks, whole = dealt.groupBy("_task", group).agg(*sums), Window.partitionBy(group)
    earlier = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    over = {"_shift": F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - C("_first"), "group_n": F.sum("_n").over(whole)}
    if weight:
        over |= {"_before": F.coalesce(F.sum("_w").over(earlier), F.lit(0)), "group_sum": F.sum("_w").over(whole)}
    shifts = materialize(tasks.select("_task", group, *[c.alias(n) for n, c in over.items()]), "places")
    met = dealt.join(shifts, same(dealt, shifts, "_task", group)).drop(shifts["_task"], shifts[group])
    out = met.withColumn("at", C("_row") + C("_shift"))
    if weight:
        inner = Window.partitionBy("_task", group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", C("_before") + F.coalesce(F.sum(weight).over(inner), F.lit(0))).drop("_before")
    return out.drop("_row", "_task", "_shift")
