"""SimHash near-duplicates: fingerprints, bit-sliced comparison, connected classes.

Texts are lower-cased (A-Z), split at ASCII white space and cut into word shingles. A
fingerprint bit is set if it is set in over half of the shingles' XXH64 hashes. Documents
link if their fingerprints differ in at most ``radius`` bits; linked documents share a class.

Equal fingerprints are one class from the start, so copies never meet each other. Two
fingerprints within the radius agree in at least ``parts - radius`` of ``parts`` bit ranges;
every choice of so many ranges is a bucket key. A bucket's members are compared bit-sliced: the
members' bit planes stand vertically in packed words, one pass of xor over the planes feeds
carry-save counters that hold the distances of all pairs at one lag, and a block is abandoned
once all its counters exceed the radius. A bucket reports links to a spanning tree, never all
its pairs.

A bucket of more than ``bucket_limit`` fingerprints is not compared in one task: its members are
dealt to chunks by a hash, and every two chunks meet in a task of their own. So each pair is
compared, a member is sent once for each other chunk, and no task holds more than two chunks.

Defined results: a null or empty text has fingerprint 0 and links like any other; a document
of fewer words than a shingle has one shingle of all its words. Rows with a null id get a
fingerprint and the class of their fingerprint; null ids never name a class that has other
ids. Repeated rows each stay a row. Empty tables give empty results. Only the id and the text
column are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, ship

BITS = 64
BLOCK = 64  # members from which a bucket is compared by itself, 64 members at a time


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=False)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 5, seed: int = 42) -> Column:
    """A bigint column with the fingerprint's bits."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(x, shingle, seed) for x in batch], np.uint64).view(np.int64))

    return column(F.col(text))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of values of one or more 64-bit words: row b holds bit b of every value, packed 64 values to a word."""
    words = values.reshape(len(values), -1)
    words = np.concatenate([words, np.zeros((-len(words) % 64, words.shape[1]), np.uint64)])
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(left: np.ndarray, right: np.ndarray, alive: np.ndarray, radius: int) -> np.ndarray:
    """Packed mask of the lanes in which ``left`` and ``right`` (bit planes) differ in at most ``radius`` bits.

    Carry-save counters: counter k holds bit k of every lane's distance; two planes and a counter
    are added at once, their carries wait for another of the next level. After every 16 planes the
    lanes past the radius leave ``alive``, and the block is abandoned when no lane is left.
    """
    width = max(radius.bit_length(), len(left).bit_length())
    count = [np.zeros_like(alive) for _ in range(width)]
    waiting: list = [None] * width

    def add(plane: np.ndarray) -> None:
        for k in range(width):
            if waiting[k] is None:
                waiting[k] = plane
                return
            part = count[k] ^ waiting[k]
            count[k], plane, waiting[k] = part ^ plane, (count[k] & waiting[k]) | (part & plane), None

    def past() -> np.ndarray:
        over, equal = np.zeros_like(alive), ~np.zeros_like(alive)
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal = equal & count[k]
            else:
                over = over | (equal & count[k])
                equal = equal & ~count[k]
        return over

    for b in range(len(left)):
        add(left[b] ^ right[b])
        if b % 16 == 15 and b + 1 < len(left):  # what waits is not counted yet, so none is dropped too early
            alive = alive & ~past()
            if not alive.any():
                return alive
    for level, plane in enumerate(waiting):
        if plane is not None:
            carry = plane
            for k in range(level, width):
                count[k], carry = count[k] ^ carry, count[k] & carry
    return alive & ~past()


def near_in_block(values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of a bucket with the later members within the radius: 64 members at a time against all planes."""
    every, n = planes(values), len(values)
    bits = np.unpackbits(values.reshape(n, -1).view(np.uint8), axis=1, bitorder="little").astype(bool)
    for at in range(0, n, 64):
        own = np.where(bits[at : at + 64].T, ~np.uint64(0), np.uint64(0))[:, :, None]
        rest = every[:, None, at // 64 :]
        near = within(own, rest, np.full((own.shape[1], rest.shape[2]), ~np.uint64(0)), radius)
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            others = np.flatnonzero(lanes(near[q], n - at)) + at
            if (later := others[others > at + q]).size:
                yield at + q, later


def lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(mask.view(np.uint8), bitorder="little")[:n].astype(bool)


def pack(mask: np.ndarray) -> np.ndarray:
    return np.packbits(np.concatenate([mask, np.zeros(-len(mask) % BITS, bool)]), bitorder="little").view(np.uint64)


def bucket_links(bucket: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets (``bucket`` is sorted): members, and for each its tree's smallest row, where another."""
    n = len(values)
    label = np.arange(n)
    starts, sizes = np.unique(bucket, return_index=True, return_counts=True)[1:]
    for start, size in zip(starts[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist(), strict=True):
        pairs = [np.stack([np.full(len(js), i), js]) for i, js in near_in_block(values[start : start + size], radius)]
        own = np.arange(size)
        for at in range(0, len(pairs), 1024):
            own = _join(own, np.concatenate(pairs[at : at + 1024], axis=1))
        label[start : start + size] = own + start
    left_over = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # members after this one in its bucket
    rows, lag, found = np.flatnonzero(np.repeat(sizes, sizes) <= BLOCK), 1, []
    while len(rows := rows[left_over[rows] >= lag]):
        near = lanes(within(planes(values[rows]), planes(values[rows + lag]), pack(np.ones(len(rows), bool)), radius), len(rows))
        found.append(np.stack([rows[near], rows[near] + lag]))
        lag += 1
    if found:
        label = _join(label, np.concatenate(found, axis=1))
    other = np.flatnonzero(label != np.arange(n))
    return other, label[other]


def _join(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row over the pairs and the labels so far."""
    a, b = pairs
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(batches: Iterator[pd.DataFrame], radius: int, name: str = "fp", value: tuple[str, ...] = ("fp",), rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Links ``a``, ``b`` (of ``name``) within the buckets of a stream that is sorted by ``key``; a cut bucket is carried over."""
    rest = None

    def links(part: pd.DataFrame) -> pd.DataFrame:
        key, names = part["key"].to_numpy(), part[name].to_numpy()
        run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else key
        own, root = bucket_links(run, np.stack([part[v].to_numpy().view(np.uint64) for v in value], axis=1), radius)
        return pd.DataFrame({"a": names[own], "b": names[root]}, dtype="int64")

    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if len(rest) >= rows:
            cut = int((rest["key"].to_numpy() != rest["key"].iloc[-1]).sum())
            yield links(rest.iloc[:cut])
            rest = rest.iloc[cut:].reset_index(drop=True)
    if rest is not None:
        yield links(rest)


def in_buckets(members: DataFrame, size: Column, limit: int, name: str) -> DataFrame:
    """``members`` of buckets ``key`` of a known ``size``, those over ``limit`` split into pairs of chunks; sorted by ``key`` within tasks."""
    chunks = F.greatest(F.ceil(size / limit), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64(F.lit(7), name), F.col("_chunks"))
    other = F.explode(F.when(F.col("_chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1), F.array("_own"))))
    dealt = members.withColumn("_chunks", chunks).withColumn("_own", own).withColumn("_other", other)
    dealt = dealt.withColumn("key", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_chunks", "_own", "_other")
    return dealt.repartition("key").sortWithinPartitions("key", name)


def near_links(values: DataFrame, radius: int = 2, parts: int = 4, bucket_limit: int = 2048) -> DataFrame:
    """Links ``a``, ``b`` among the distinct fingerprints ``fp`` that connect all pairs within the radius."""
    if not 0 < radius < parts:
        raise ValueError("radius must be below parts")
    edges = [round(BITS * k / parts) for k in range(parts + 1)]
    mask = lambda ks: sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in ks)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(mask(ks))).cast("long")).alias("part")) for t, ks in enumerate(combinations(range(parts), parts - radius))]
    keyed = values.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", F.xxhash64("k.t", "k.part").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sizes, "key")  # few fingerprints share a bucket
    return in_buckets(members, F.col("n"), bucket_limit, "fp").select("key", "fp").mapInPandas(lambda batches: compare(batches, radius), "a long, b long").distinct()


def connected(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for every node of the links.

    Each round takes the smallest root among a node's neighbours and then its root's root;
    the rounds grow with the logarithm of the longest chain. A limit that is hit is an error.
    """
    both = materialize(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))), "simhash-links")
    roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "simhash-roots")
    for k in count():
        if k == rounds:
            raise RuntimeError(f"roots still move after {rounds} rounds")
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("low"))
        hooked = roots.join(near, roots["node"] == near["a"]).select("node", "root", F.least("root", "low").alias("low"))
        # A root that has a smaller neighbour anywhere in its tree hooks onto it.
        lower = hooked.groupBy("root").agg(F.min("low").alias("low")).select(F.col("root").alias("at"), F.col("low").alias("to"))
        jumped = hooked.join(lower, hooked["low"] == lower["at"], "left").join(lower.select(F.col("at").alias("at2"), F.col("to").alias("to2")), F.col("root") == F.col("at2"), "left")
        new = materialize(jumped.select("node", F.least("low", "to", "to2").alias("root"), (F.least("low", "to", "to2") != F.col("root")).alias("moved")), "simhash-roots")
        roots = new.select("node", "root")
        if not new.where("moved").head(1):
            break
    return roots


def classes_of(marked: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For rows of ``id`` and ``fp`` (a mark): ``root`` (its class's smallest mark) and ``component_id`` too; ``links`` joins distinct marks."""
    classes = materialize(marked.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    roots = connected(links(classes))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    lowest = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lowest")  # apart, so that a join on a large class can be split
    found = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(found, "fp").select("id", "fp", "root", "component_id")


def _rooted(docs: DataFrame, id: str, text: str, shingle: int, seed: int, radius: int, parts: int, bucket_limit: int) -> DataFrame:
    marked = materialize(docs.select(F.col(id).alias("id"), fingerprints(docs, text, shingle, seed).alias("fp")), "simhash")
    return classes_of(marked, lambda classes: near_links(classes.select("fp"), radius, parts, bucket_limit))


def simhash_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, seed: int = 42, radius: int = 2, parts: int = 4, bucket_limit: int = 2048) -> DataFrame:
    """One row per document: ``fingerprint`` as a bigint and ``component_id``, the smallest id it is linked to."""
    found = _rooted(docs, id, text, shingle, seed, radius, parts, bucket_limit)
    return found.select(F.col("id").alias(id), F.col("fp").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, seed: int = 42, radius: int = 2, parts: int = 4, bucket_limit: int = 2048) -> DataFrame:
    """``docs`` with one row left of each class, the one of the smallest id; its columns unchanged.

    Rows that share an id are told apart by their fingerprints; equal ones count as one row.
    """
    return first_of_class(docs, id, fingerprints(docs, text, shingle, seed), _rooted(docs, id, text, shingle, seed, radius, parts, bucket_limit))


def with_ids(docs: DataFrame, id: str, ids: DataFrame, how: str, most: int = 500_000) -> DataFrame:
    """``docs`` whose id is among the distinct ``ids`` (``left_semi``) or not (``left_anti``); up to ``most`` ids are sent to the texts, more meet them in a shuffle."""
    ids = ids.select(F.col("id").alias("_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, docs[id].eqNullSafe(ids["_id"]), how)


def first_of_class(docs: DataFrame, id: str, mark: Column, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their class in ``found``; rows that share an id are told apart by ``mark``."""
    found = materialize(found, "simhash-found")
    rows = found.groupBy("id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("id").eqNullSafe(F.col("component_id")), F.lit(False))).alias("first"))
    rows = materialize(rows.where("not first or n > 1"), "simhash-others")
    kept = with_ids(docs, id, rows.select("id"), "left_anti")

    several = rows.where("first and n > 1").select("id")
    if not several.head(1):  # no id is repeated, as is usual
        return kept
    chosen = found.join(several.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left_semi").where(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = chosen.groupBy("root").agg(F.min("fp").alias("_fp"), F.first("id").alias("_id")).drop("root")
    repeated = several.withColumnRenamed("id", "_id")
    again = docs.join(repeated, docs[id].eqNullSafe(repeated["_id"]), "left_semi")
    again = again.select(F.struct(*docs.columns).alias("_doc"), F.col(id).alias("_own"), mark.alias("_own_fp"))
    again = again.join(chosen, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_fp") == F.col("_fp")), "left_semi")
    return kept.unionByName(again.dropDuplicates(["_own", "_own_fp"]).select("_doc.*"))


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
