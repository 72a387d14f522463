"""Hard negatives for anchors: products of anchor blocks with candidate blocks, in two passes.

Anchors are taken in slices of at most ``ANCHORS`` rows. A slice is broadcast; tasks stream over all candidates and multiply
block by block in float64, whose sums of integers are exact below 2^53 (a block that could exceed this is
multiplied in 64-bit integers). The first pass keeps the best positives of each anchor, the second the best
negatives within each positive's window. What tasks keep can be merged: it is at most k rows for each anchor and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..shared import materialize, ship, table_path

C = F.col
ANCHORS = 16_384  # rows of a slice: with 1,024 components 128 MB
BLOCK = 1_024  # anchors, and twice as many candidates, of one product: 16 MB


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that take part as far as Spark sees it, with labels of every seventh id moved on by one."""
    moved = F.when(C("vec_id") % 7 == 0, (C("label") + 1) % 10).otherwise(C("label")).cast("long")
    return vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(C("vec_id").cast("long").alias("vec_id"), moved.alias("label"), C("embedding").cast("array<double>").alias("embedding"))


def quantised(batch: pa.RecordBatch, scale: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and floor(scale * x) of the rows without null or non-finite components; shorter vectors are padded with zeros."""
    ids, labels, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    width = int(lengths.max(initial=0))
    grid = np.zeros((len(ids), width))
    grid[np.arange(width) < lengths[:, None]] = values
    good = np.isfinite(grid).all(axis=1)
    ids, labels, grid = ids[good], labels[good], np.floor(scale * grid[good])
    order = np.argsort(ids, kind="stable")
    return ids[order], labels[order], grid[order]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of integers, exactly: float64 below 2^53, else int64."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if bound < 2.0**53:
        return a @ b.T
    if not bound < 2.0**63:
        raise OverflowError("an inner product of quantised vectors may not fit a 64-bit integer")
    return a.astype(np.int64) @ b.T.astype(np.int64)


def lowest(scores: np.ndarray) -> float | int:
    return -math.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min


class Best:
    """For each of ``n`` rows the k best (score, id): higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), -1)
        self.k = k

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (overwritten) of ``rows`` against candidates of ascending ``ids``; the lowest value is no candidate."""
        none = lowest(scores)
        near = (scores > none) & (scores >= self.scores[rows, -1][:, None])
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return
        at, scores = rows[some], scores[some]
        found, who = [self.scores[at]], [self.ids[at]]
        for _ in range(min(self.k, len(ids))):
            best = scores.argmax(axis=1)  # the first of equal scores has the smallest id
            top = scores[np.arange(len(at)), best]
            found.append(np.where(top > none, top, 0).astype(np.int64)[:, None])
            found[-1][top <= none] = np.iinfo(np.int64).min
            who.append(np.where(top > none, ids[best], -1)[:, None])
            scores[np.arange(len(at)), best] = none
        found, who = np.hstack(found), np.hstack(who)
        order = np.lexsort((who, ~found), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(found, order, 1), np.take_along_axis(who, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.scores > np.iinfo(np.int64).min)
        return row, self.ids[row, place], self.scores[row, place]


def _blocks(n: int, size: int) -> Iterator[slice]:
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def _table(best: Best, first: np.ndarray) -> pa.RecordBatch:
    row, ids, scores = best.rows()
    return pa.RecordBatch.from_arrays([pa.array(first[row]), pa.array(ids), pa.array(scores)], names=["no", "id", "score"])


def _positives(anchors, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, grid = anchors.value
        best = Best(len(ids), k)
        for batch in batches:
            c_ids, c_labels, c_grid = quantised(batch)
            for label in np.intersect1d(labels, c_labels):
                mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(c_labels == label)
                for a in (mine[s] for s in _blocks(len(mine), BLOCK)):
                    for c in (theirs[s] for s in _blocks(len(theirs), 2 * BLOCK)):
                        scores = product(grid[a], c_grid[c])
                        scores[ids[a][:, None] == c_ids[c]] = lowest(scores)
                        best.offer(a, scores, c_ids[c])
        yield _table(best, np.arange(len(ids)))

    return task


def _negatives(anchors, windows, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, grid = anchors.value
        owner, low, high = windows.value
        best = Best(len(owner), k)
        for batch in batches:
            c_ids, c_labels, c_grid = quantised(batch)
            for p in _blocks(len(owner), BLOCK):  # pairs are sorted by anchor: each anchor's products are made once for a block of pairs
                a, which = np.unique(owner[p], return_inverse=True)
                for c in _blocks(len(c_ids), 2 * BLOCK):
                    scores = product(grid[a], c_grid[c])
                    none = lowest(scores)
                    scores[labels[a][:, None] == c_labels[c]] = none
                    for nth in _nth(which):
                        rows = np.arange(p.start, p.stop)[nth]
                        s = scores[which[nth]]
                        s[(s < low[rows, None]) | (s > high[rows, None])] = none
                        best.offer(rows, s, c_ids[c])
        yield _table(best, np.arange(len(owner)))

    return task


def _nth(which: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the first, second, ... of each run of equal values."""
    nth = np.arange(len(which)) - np.searchsorted(which, which)
    return (np.flatnonzero(nth == n) for n in range(int(nth.max(initial=-1)) + 1))


def _merged(kept: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", place).where(C("rank") <= k)


def slices(anchors: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors' ids, labels and quantised vectors in slices of at most ``most`` rows, one at a time."""
    rows: list[Row] = []
    for row in anchors.toLocalIterator():
        rows.append(row)
        if len(rows) == most:
            yield _slice(rows)
            rows = []
    if rows:
        yield _slice(rows)


def _slice(rows: list[Row]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64())]
    return quantised(pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["vec_id", "label", "embedding"]))


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, most: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (``vec_id, label, embedding``).

    Anchors are the rows whose id ``every`` divides. Their positives are the best other rows of their label, that is rows of another id, and
    each positive's negatives the best rows of other labels with 50 p <= 100 n <= 95 p. Rows with a null id, label or vector, or a null
    or non-finite component, take no part; an empty vector's scores are 0, and a shorter vector counts as padded with zeros.
    A repeated row is a candidate for each time it is there, and an anchor for each time it is there. No anchors, or an
    empty table, give no rows. Other columns take no part, whatever their names. Scores beyond 64 bits are an error.
    All candidates are read twice for each slice of ``most`` anchors; nothing is dropped to save that.
    """
    spark = vectors.sparkSession
    ship(spark)
    all_rows = prepared(vectors)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = table_path(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    kept = "no long, id long, score long"
    for anchors in slices(materialize(all_rows.where(C("vec_id") % every == 0), "anchors"), most):
        if not len(anchors[0]):
            continue
        sent = spark.sparkContext.broadcast(anchors)
        found = sorted((r.no, r.rank, r.id, r.score) for r in _merged(all_rows.mapInArrow(_positives(sent, positives), kept), positives).collect())  # at most ``positives`` for each anchor of the slice
        if found:
            owner = np.array([f[0] for f in found])
            windows = spark.sparkContext.broadcast((owner, np.array([-(-f[3] // 2) for f in found]), np.array([19 * f[3] // 20 for f in found])))
            pairs = spark.createDataFrame([(n, int(anchors[0][f[0]]), f[2], f[3]) for n, f in enumerate(found)], "no long, anchor_id long, positive_id long, positive_score long")
            best = _merged(all_rows.mapInArrow(_negatives(sent, windows, negatives), kept), negatives).join(F.broadcast(pairs), "no")
            best.select("anchor_id", "positive_id", "rank", C("id").alias("negative_id"), "positive_score", C("score").alias("negative_score")).write.mode("append").parquet(path)
            windows.destroy()
        sent.destroy()
    return spark.read.schema(schema).parquet(path)
