"""Near copies: SimHash candidates from a bit-sliced comparison, verified by exact shingle similarity.

Two documents link if the Jaccard similarity of their sets of word shingles is at least
``least``; linked documents share a class. Words and shingles are those of ``simhash``.

Candidates come from SimHash. Each distinct text has a fingerprint of 128 bits over its distinct
shingles, and ``BANDS`` bucket keys, each of ``ROWS`` least hashes of its shingles. Fingerprints
that share a key are compared bit-sliced; those within ``RADIUS`` bits are candidates. At a
similarity of 0.8 a pair differs in 19 bits on average with a deviation of 4, so about one in a
thousand is further apart than the radius, and fewer than one in five thousand shares no key;
both shares fall quickly above 0.8.

A candidate link is loose, and a bucket reports a spanning tree only. So the texts of each tree
meet once more, are compared bit-sliced again, and each pair within the radius that is not linked
yet is held against the exact similarity. Groups of more than ``GROUP_LIMIT`` texts or of very long ones are split
into pairs of chunks, as the buckets of ``simhash`` are.

Texts of the same words are one class from the start. Shingles and texts are told apart by 64-bit
hashes. A null or empty text has one shingle, the empty one. Rows with a null id take part like
others; rows that share an id are told apart by their words, equal ones count as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, ship
from .simhash import classes_of, compare, connected, first_of_class, in_buckets, near_in_block, with_ids

BANDS, ROWS, RADIUS = 12, 3, 32
BUCKET_LIMIT, GROUP_LIMIT, GROUP_SHINGLES = 512, 1024, 400_000
FACTORS = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_hash(text: str | None, seed: int = 42) -> int:
    """Hash of the lower-cased words, as a signed 64-bit number."""
    return int(np.array(xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()), seed), np.uint64).view(np.int64))


def shingle_hashes(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """128-bit hashes, as two words, of the distinct word shingles, sorted by the first word."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh128_digest
    if len(words) <= shingle:
        return np.frombuffer(digest(joined, seed), np.uint64).reshape(1, 2)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    parts = [digest(joined[a:b], seed) for a, b in zip((ends - sizes).tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=False)]
    hashes = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
    return hashes[np.unique(hashes[:, 0], return_index=True)[1]]


def sketch(hashes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The two words of the fingerprint and the bucket keys."""
    n, ones, least = len(hashes), np.zeros(128, np.int64), np.full(len(FACTORS), ~np.uint64(0))
    for at in range(0, n, 2048):
        part = np.ascontiguousarray(hashes[at : at + 2048])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
        least = np.minimum(least, (part[:, :1] * FACTORS).min(0))
    fp = np.packbits(2 * ones > n, bitorder="little").view(np.int64)
    low = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        keys = (keys ^ low[:, r]) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> np.uint64(29)
    return int(fp[0]), int(fp[1]), keys.view(np.int64)


def sketches(docs: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    """``id``, ``fp`` (the hash of the words), ``n`` shingles, ``p0``, ``p1`` (the fingerprint) and ``keys`` for each row."""
    ship(docs.sparkSession)

    @F.pandas_udf("struct<fp:long,n:long,p0:long,p1:long,keys:array<long>>")
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                h = shingle_hashes(t, shingle)
                rows.append((words_hash(t), len(h), *sketch(h)))
            yield pd.DataFrame(rows, columns=["fp", "n", "p0", "p1", "keys"])

    return docs.select(F.col(id).alias("id"), column(F.col(text)).alias("s")).select("id", "s.*")


def verified(batches: Iterator[pd.DataFrame], shingle: int, least: float) -> Iterator[pd.DataFrame]:
    """Links of enough similarity that span each group; rows are sorted by ``key``. A text that has another mark is not meant."""
    own: dict[int, np.ndarray] = {}
    prints: dict[int, tuple[int, int]] = {}
    now = None

    def links() -> pd.DataFrame:
        marks = list(own)
        if len(marks) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        size = np.array([len(own[m]) for m in marks])
        stop = np.cumsum(size)
        known, ids = np.unique(np.concatenate([own[m] for m in marks]), return_inverse=True)
        sets = np.split(ids, stop[:-1])
        label, flag, found = np.arange(len(marks)), np.zeros(len(known), bool), []
        for q, others in near_in_block(np.array([prints[m] for m in marks], np.int64).view(np.uint64), RADIUS):
            others = others[(label[others] != label[q]) & (np.minimum(size[others], size[q]) >= least * np.maximum(size[others], size[q]) - 1e-9)]
            if not len(others):
                continue
            flag[sets[q]] = True
            parts = size[others]
            common = np.add.reduceat(flag[np.concatenate([sets[k] for k in others.tolist()])], np.cumsum(parts) - parts, dtype=np.int64)
            flag[sets[q]] = False
            for k in others[common >= least * (parts + size[q] - common) - 1e-9].tolist():
                if label[k] != label[q]:
                    found.append((marks[k], marks[q]))
                    label[label == label[k]] = label[q]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    for batch in batches:
        for key, mark, p0, p1, text in zip(batch["key"].tolist(), batch["fp"].tolist(), batch["p0"].tolist(), batch["p1"].tolist(), batch["_text"], strict=True):
            if key != now:
                yield links()
                own, prints, now = {}, {}, key
            if mark not in own and words_hash(text) == mark:
                own[mark], prints[mark] = shingle_hashes(text, shingle)[:, 0], (p0, p1)
    yield links()


def similar_links(docs: DataFrame, heads: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Links ``a``, ``b`` (hashes of words) that connect all pairs of enough similarity; ``heads`` has the sketches of distinct texts with an id each."""
    keyed = heads.select("fp", "p0", "p1", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = in_buckets(keyed.join(sizes, "key"), F.col("m"), BUCKET_LIMIT, "fp").select("key", "fp", "p0", "p1")
    near = buckets.mapInPandas(lambda batches: compare(batches, RADIUS, "fp", ("p0", "p1")), "a long, b long").distinct()

    groups = connected(near).join(heads.select(F.col("fp").alias("node"), "n", "id", "p0", "p1"), "node")
    groups = materialize(groups.select(F.col("root").alias("key"), F.col("node").alias("fp"), "n", "p0", "p1", F.col("id").alias("_id")), "near-groups")
    sums = groups.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    parts = F.greatest(F.col("m") / GROUP_LIMIT, F.col("total") / GROUP_SHINGLES)
    wanted = groups.join(sums, "key").select("key", "fp", "p0", "p1", "_id", parts.alias("_parts"))
    some = with_ids(docs.select(F.col(id).alias("_own"), F.col(text).alias("_text")), "_own", groups.select(F.col("_id").alias("id")).distinct(), "left_semi")
    texts = some.join(wanted, F.col("_own").eqNullSafe(F.col("_id"))).drop("_own", "_id")
    met = in_buckets(texts, F.col("_parts"), 1, "fp").select("key", "fp", "p0", "p1", "_text")
    return met.mapInPandas(lambda batches: verified(batches, shingle, least), "a long, b long")


def keep_dissimilar(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row left of each class of near copies, the one of the smallest id; its columns unchanged."""
    known = materialize(sketches(docs, id, text, shingle), "near-sketches")
    heads = known.groupBy("fp").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "p0", "p1", "keys")])
    heads = materialize(heads, "near-heads")

    @F.pandas_udf("long")
    def marks(texts: pd.Series) -> pd.Series:
        return pd.Series([words_hash(t) for t in texts], dtype="int64")

    found = classes_of(known.select("id", "fp"), lambda _: similar_links(docs, heads, id, text, shingle, least))
    return first_of_class(docs, id, marks(F.col(text)), found)
