"""A Merkle manifest of a table: a tree of SHA-256 digests for each source, one over the sources, and a proof for every row.

Inner nodes join up to three digests. All leaves of a source lie equally deep: while several nodes remain, every run of
three (the last may be shorter) becomes one. A level is cut into aligned blocks of 3^``HEIGHT`` nodes. A task walks a block
in postorder: a call returns its subtree's digest, and on the way back the siblings of each child are appended to the leaves below it.
The block roots are the leaves of the next traversal, until each tree has one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, ship
from .places import placed

C = F.col
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 6  # levels of a block: at most 729 leaves, 32 bytes for each sibling
NONE = hashlib.sha256(b"").hexdigest()


def canonical(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[canonical(fields[f]) for f in FIELDS]).cast("binary"), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where the CRC-32 of the decimal id is even; a null id or text changes nothing."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def join_digests(parts: list[bytes]) -> bytes:
    """The digest of digests, as hex text, one after the other."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def levels(n: int) -> int:
    """Levels above ``n`` equally deep nodes until one remains."""
    high = 0
    while n > 1:
        n, high = -(-n // 3), high + 1
    return high


def walk(leaves: list[bytes], height: int, siblings: list[list[bytes]], start: int = 0) -> bytes:
    """Digest of the subtree of ``height`` levels over the leaves from ``start``; its nodes' siblings are appended to the leaves below, lowest level first."""
    if not height:
        return leaves[start]
    step = 3 ** (height - 1)
    spans = [(s, min(s + step, len(leaves))) for s in range(start, min(start + 3 * step, len(leaves)), step)]
    roots = [walk(leaves, height - 1, siblings, s) for s, _ in spans]
    for k, (a, b) in enumerate(spans):
        others = b"".join(roots[:k] + roots[k + 1 :])
        for leaf in range(a, b):
            siblings[leaf].append(others)
    return join_digests(roots)


def climb(digest: bytes, at: int, path: list[bytes]) -> bytes:
    """The root above a node with place ``at``, from the siblings of each level."""
    for others in path:
        run = [others[i : i + 32] for i in range(0, len(others), 32)]
        run.insert(at % 3, digest)
        digest, at = join_digests(run), at // 3
    return digest


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches sorted by ``keys``; the pieces of one group are joined once."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        new = np.zeros(len(batch), bool)
        for k in keys:
            c, null = batch[k], batch[k].isna()
            new |= ((c != c.shift()) & ~(null & null.shift(fill_value=False))).to_numpy()
        if held and len(batch):
            last, first = held[-1].iloc[-1], batch.iloc[0]
            new[0] = any(last[k] != first[k] and not (pd.isna(last[k]) and pd.isna(first[k])) for k in keys)
        cuts = np.flatnonzero(new)
        at = 0
        for cut in cuts.tolist():
            if cut > at:
                held.append(batch.iloc[at:cut])
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            at = cut
        if len(batch) > at:
            held.append(batch.iloc[at:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def traverse(nodes: DataFrame, group: str, carry: list[str], height: int = HEIGHT) -> DataFrame:
    """One traversal of ``group, at, group_n, digest`` and ``carry``: each node with ``path``, an array of its siblings by level, and ``block`` and ``root_of_block``."""
    ship(nodes.sparkSession)
    size = 3**height
    rows = nodes.select(group, "at", "group_n", "digest", *carry).withColumn("block", F.floor(C("at") / size).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _runs(batches, [group, "block"]):
            leaves, paths = block["digest"].tolist(), [[] for _ in range(len(block))]
            root = walk(leaves, min(height, levels(int(block["group_n"].iloc[0]))), paths)
            yield block.assign(path=paths, root_of_block=[root] * len(block))

    return rows.repartition(group, "block").sortWithinPartitions(group, "block", "at").mapInPandas(blocks, f"{kinds}, path array<binary>, root_of_block binary")


def ascend(nodes: DataFrame, group: str, carry: list[str], height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """Traversals of ``group, at, group_n, digest`` until every group has one node: the walked tables, lowest first, and ``group, digest``, the roots."""
    walked: list[DataFrame] = []
    while True:
        walked.append(materialize(traverse(nodes, group, [] if walked else carry, height), "merkle"))
        tops = walked[-1].where(C("at") % 3**height == 0).select(group, C("block").alias("at"), F.ceil(C("group_n") / 3**height).cast("long").alias("group_n"), C("root_of_block").alias("digest"))
        nodes = materialize(tops, "merkle-roots")
        if not nodes.where("group_n > 1").head(1):
            return walked, nodes.select(group, "digest")


def descend(walked: list[DataFrame], group: str, top: DataFrame) -> DataFrame:
    """The lowest nodes with ``path``, their siblings up to the root, and the columns of ``top``, one row for each group.

    Paths are put together from the top, so that each table is joined to one row for each of its blocks: no key has more rows than a block.
    """
    above = top.withColumns({"_block": F.lit(0).cast("long"), "_path": F.array().cast("array<binary>")}).withColumnRenamed(group, "_group")
    extra = [c for c in top.columns if c != group]
    for n, lower in enumerate(reversed(walked)):
        met = lower.join(above, lower[group].eqNullSafe(above["_group"]) & (lower["block"] == above["_block"]))
        met = met.withColumn("path", F.concat("path", "_path")).drop("_path", "_group", "_block", "block", "root_of_block")
        above = met.select(C(group).alias("_group"), C("at").alias("_block"), C("path").alias("_path"), *extra) if n + 1 < len(walked) else met
    return above


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    Leaves of a source ascend by ``doc_id``, nulls first; of equal ids by digest, so that only equal rows are
    interchangeable, and each repeated row is a leaf of its own. A null source is a source, ordered before the others;
    a null in any field is ``-`` in its leaf. A lone leaf is its source's subroot, and a lone source's subroot the root; a proof
    without siblings is the digest of no bytes. An empty table has an empty manifest. Texts go whole into
    their digest, on the JVM. Other columns take no part, whatever their names. A field that is missing is an error.
    """
    text = tampered_text(C("doc_id"), C("text"))
    fields = {f: C(f) for f in FIELDS}
    other = F.when(text != C("text"), F.unhex(leaf_digest(fields | {"text": text})))
    leaves = materialize(docs.select("doc_id", "source", F.unhex(leaf_digest(fields)).alias("digest"), other.alias("tampered"), F.monotonically_increasing_id().alias("no")), "leaves")
    nodes = placed(leaves, "source", [C("doc_id"), C("digest"), C("no")]).withColumn("id", C("doc_id").cast("string"))  # ids with nulls are no integers in pandas
    walked, roots = ascend(nodes, "source", ["id", "tampered"], height)
    sources = placed(roots.withColumn("all", F.lit(0)), "all", [C("source")])
    high, root = ascend(sources, "all", ["source"], height)
    over = descend(high, "all", root.select("all", C("digest").alias("root")))
    top = materialize(over.select("source", C("digest").alias("subroot"), "root", C("at").alias("source_at"), C("path").alias("over")), "merkle-sources")
    return proofs(descend(walked, "source", top)).withColumn("doc_id", C("doc_id").cast(docs.schema["doc_id"].dataType))


def proofs(rows: DataFrame) -> DataFrame:
    """Digests of the proofs, and the roots recomputed from the tampered leaves, else the leaves, by their siblings alone."""
    ship(rows.sparkSession)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            low, high = b["path"].map(list), b["over"].map(list)
            proof = [hashlib.sha256(b"".join(p + q).hex().encode()).hexdigest() for p, q in zip(low, high)]
            start = [d if t is None else t for d, t in zip(b["digest"], b["tampered"])]
            folded = [climb(climb(d, at, p), source_at, q).hex() for d, at, p, source_at, q in zip(start, b["at"], low, b["source_at"], high)]
            texts = {n: [v.hex() for v in b[c]] for n, c in (("leaf", "digest"), ("subroot", "subroot"), ("root", "root"))}
            yield pd.DataFrame({"doc_id": b["id"], **texts, "proof_sha256": proof, "folded_root": folded, "verified": [f == r for f, r in zip(folded, texts["root"])]})

    return rows.select("id", "digest", "tampered", "at", "path", "source_at", "over", "subroot", "root").mapInPandas(fold, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
