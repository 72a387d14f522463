"""Benchmark decontamination by the q-gram lemma in overlapping diagonal bands.

Texts and benchmark items are lower-cased and reduced to letters and digits separated by
single spaces. If a region of a text is within ``k`` edits of an item of ``m`` bytes, the two
share at least ``m + 1 - q - k * q`` of the item's q-grams, at diagonals (text position less
item position) that lie within ``k`` of each other. So shared q-grams are counted in bands of
diagonals, each twice as wide as ``k`` needs and overlapping the next by half; regions that
reach the bound are verified by an alignment that stays within ``k`` of the region's diagonal.
No region within the edit budget is missed.

The benchmark is the small side: its q-gram table is sent to the executors, and
``MAX_BENCHMARK_BYTES`` bounds it (a larger one is searched in slices of that size). Texts are read once for each slice and never shuffled.

The budget of an item of ``m`` bytes is ``share`` of them, and at most ``m // q - 1``, so that the bound
never is below one shared q-gram. Items shorter than ``q`` bytes have no q-gram; they match where
their words stand in the text without an edit. A very long text that repeats common q-grams is
counted part by part (``PART`` pairs of places), so a task's memory does not follow its matches.

Defined results: a null or empty text or item matches nothing. Equal items each give a row.
Repeated rows are judged row by row. Empty tables give empty results. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import ship

MAX_BENCHMARK_BYTES = 2_000_000
TABLE_BITS = 22
PART = 2_000_000  # pairs of a text's and an item's places that are counted at once
_KEEP = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _KEEP[_c] = _c + 32 if 65 <= _c <= 90 else _c
_TABLE = bytes(_KEEP)


def reduced(text: str | None) -> bytes:
    """Lower-cased runs of letters, digits and non-ASCII bytes, separated by single spaces."""
    return b" ".join((text or "").encode().translate(_TABLE).split())


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, equal for equal q-grams (exact up to 8 bytes)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    key = data[:n].astype(np.uint64)
    for k in range(1, q):
        key <<= np.uint64(8)
        key |= data[k : n + k]
    return key


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


@dataclass
class Index:
    """The items, and where each of their q-grams stands."""

    ids: np.ndarray
    texts: list[bytes]
    q: int
    share: float
    keys: np.ndarray  # the distinct q-grams, sorted
    first: np.ndarray  # where a q-gram's places begin
    item: np.ndarray
    at: np.ndarray
    filled: np.ndarray  # by slot
    size: np.ndarray  # of each item
    k: np.ndarray  # its edit budget
    need: np.ndarray  # q-grams that a region within the budget shares at least
    short: list[int]  # items without a q-gram

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], q: int, share: float) -> Index:
        all_keys = [gram_hashes(np.frombuffer(t, np.uint8), q) for _, t in items]
        item = np.repeat(np.arange(len(items)), [len(x) for x in all_keys])
        at = np.concatenate([np.arange(len(x)) for x in all_keys] or [np.empty(0, np.int64)])
        flat = np.concatenate(all_keys or [np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        filled = np.zeros(1 << TABLE_BITS, bool)
        filled[slot(keys).astype(np.int64)] = True
        size = np.array([len(t) for _, t in items], np.int64)
        k = np.clip(np.floor(size * share).astype(np.int64), 0, np.maximum(size // q - 1, 0))
        need = np.maximum(1, size + 1 - q * (k + 1))
        return cls(np.array([i for i, _ in items]), [t for _, t in items], q, share, keys, np.append(first, len(flat)), item[order], at[order], filled, size, k, need, [o for o, (_, t) in enumerate(items) if len(t) < q])


def banded(item: bytes, text: bytes, k: int) -> tuple[int, int] | None:
    """Fewest edits from the whole item to a region of ``text`` and the region's end, if at most ``k``.

    Row by row over the item; the band holds the diagonals from 0 to ``len(text) - len(item)``
    and ``k`` on either side. A region may begin and end anywhere.
    """
    m, n = len(item), len(text)
    wide = n - m + 2 * k + 1 if n >= m else 2 * k + 1
    t = np.full(m + wide + 1, -1, np.int16)  # text position j stands at j + k
    t[k : k + n] = np.frombuffer(text, np.uint8)[: len(t) - k]
    far = np.int32(1 << 20)
    lane = np.arange(wide, dtype=np.int32)
    row = np.where((lane >= k) & (lane <= n + k), 0, far).astype(np.int32)  # before the item's first byte: j = lane - k
    for i in range(m):
        new = row + (t[i : i + wide] != item[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # the item's byte is left out
        j = lane + (i + 1 - k)
        new[(j < 0) | (j > n)] = far
        row = np.minimum.accumulate(new - lane) + lane  # a byte of the text is left out
        row[(j < 0) | (j > n)] = far
        if row.min() > k:
            return None
    best = int(row.argmin())
    return (int(row[best]), best + m - k) if row[best] <= k else None


def regions(index: Index, data: np.ndarray) -> list[tuple[int, int, int]]:
    """Items and text regions (begin, end) whose shared q-grams reach the bound."""
    keys = gram_hashes(data, index.q)
    near = np.flatnonzero(index.filled[slot(keys).astype(np.int64)])
    if not len(near):
        return []
    where = np.searchsorted(index.keys, keys[near])
    same = index.keys[np.minimum(where, len(index.keys) - 1)] == keys[near]
    near, where = near[same], where[same]
    if not len(near):
        return []
    begin, count = index.first[where], index.first[where + 1] - index.first[where]
    cuts = np.searchsorted(np.cumsum(count), np.arange(0, count.sum(), PART), "left")[1:]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text positions with the items' places that hold the same q-gram, part by part."""
        for some, first, n in zip(np.split(near, cuts), np.split(begin, cuts), np.split(count, cuts), strict=True):
            ends = np.cumsum(n)
            if len(n):
                yield np.repeat(some, n), np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first, n)

    shared = sum(np.bincount(index.item[place], minlength=len(index.need)) for _, place in pairs())
    enough = shared >= index.need  # over all diagonals
    if not enough.any():
        return []
    size, k = index.size, index.k
    width, most = 2 * k + 2, np.int64(size.max() + 1)
    span = int((len(data) + size.max()) // 2 + 3)
    seen = [np.empty(0, np.int64), np.empty(0, np.int64)]
    for pos, place in pairs():
        some = enough[index.item[place]]
        pos, place = pos[some], place[some]
        item = index.item[place]
        diagonal = pos - index.at[place] + size[item]  # never negative
        for half in (0, 1):  # bands of 2k + 2 diagonals, and the same bands moved by half
            band = (diagonal + half * (width[item] // 2)) // width[item]
            # A q-gram of the item counts once in a band, however often the text repeats it.
            once = np.unique((item.astype(np.int64) * span + band) * most + index.at[place])
            seen[half] = np.union1d(seen[half], once) if len(seen[half]) else once
    found = set()
    for half in (0, 1):
        cells, shared = np.unique(seen[half] // most, return_counts=True)
        owner = cells // span
        need = index.need[owner]
        for c, o in zip(cells[shared >= need].tolist(), owner[shared >= need].tolist(), strict=True):
            low = (c % span) * int(width[o]) - half * int(width[o] // 2) - int(size[o])
            found.add((o, max(0, low - int(k[o])), min(len(data), low + int(width[o]) + int(size[o]) + int(k[o]))))
    return sorted(found)


def matches(index: Index, text: str | None) -> list[tuple[int, int, int, int]]:
    """Item, edits, begin and end (in the reduced text) for each item that the text holds."""
    raw = reduced(text)
    best: dict[int, tuple[int, int, int]] = {}
    for o in index.short:
        at = (b" " + raw + b" ").find(b" " + index.texts[o] + b" ")
        if at >= 0:
            best[o] = (0, at, at + len(index.texts[o]))
    if len(raw) < index.q or not len(index.keys):
        return [(o, *best[o]) for o in sorted(best)]
    for o, begin, end in regions(index, np.frombuffer(raw, np.uint8)):
        item, part = index.texts[o], raw[begin:end]
        k = int(index.k[o])
        at = part.find(item)
        if at >= 0:
            hit = (0, begin + at, begin + at + len(item))
        elif o in best and best[o][0] == 0:
            continue
        else:
            done = banded(item, part, k)
            if done is None:
                continue
            hit = (done[0], max(0, begin + done[1] - len(item) - done[0]), begin + done[1])
        best[o] = min(best.get(o, hit), hit)
    return [(o, *best[o]) for o in sorted(best)]


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, q: int, share: float) -> Iterator[tuple[list, Broadcast]]:
    """The item ids and the broadcast index of each slice of the benchmark."""
    if not 1 <= q <= 8 or share * q >= 1:
        raise ValueError("q must be at most 8 and below 1 / share")
    spark = benchmark.sparkSession
    ship(spark)
    total = benchmark.agg(F.sum(F.octet_length(item_text)).alias("n")).first()["n"] or 0
    slices = max(1, -(-total // MAX_BENCHMARK_BYTES))
    key = F.pmod(F.xxhash64(item_id, item_text), F.lit(slices))
    for s in range(slices):
        rows = benchmark.where(key == s).select(item_id, item_text).collect()  # about MAX_BENCHMARK_BYTES
        items = sorted(((r[0], reduced(r[1])) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        items = [(i, t) for i, t in items if t]
        yield [i for i, _ in items], spark.sparkContext.broadcast(Index.of([(k, t) for k, (_, t) in enumerate(items)], q, share))


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, share: float = 0.08) -> DataFrame:
    """One row per document and benchmark item that it holds: edits and the region in the reduced text.

    ``share`` is the edit budget per byte of an item; ``1 / share`` must be above ``q``, else the
    bound on shared q-grams is void.
    """
    kept = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    types = f"id {docs.schema[id].dataType.simpleString()}, item {benchmark.schema[item_id].dataType.simpleString()}, edits int, begin long, end long"

    def found(names: list, shared: Broadcast) -> DataFrame:
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, names[o], e, a, z) for d, t in zip(batch["_id"], batch["_text"], strict=True) for o, e, a, z in matches(shared.value, t)]
                yield pd.DataFrame(rows, columns=["id", "item", "edits", "begin", "end"])

        return kept.mapInPandas(find, types)

    parts = [found(*x) for x in _indexes(benchmark, item_id, item_text, q, share)]
    return reduce(DataFrame.unionByName, parts).select(F.col("id").alias(id), F.col("item").alias(item_id), "edits", "begin", "end")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, share: float = 0.08) -> DataFrame:
    """``docs`` less the documents that hold an item; nothing is shuffled."""

    def clean(shared: Broadcast) -> Column:
        @F.pandas_udf("boolean")
        def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                yield pd.Series([not matches(shared.value, t) for t in batch], dtype=bool)

        return column(F.col(text))

    for _, shared in _indexes(benchmark, item_id, item_text, q, share):
        docs = docs.where(clean(shared))
    return docs
