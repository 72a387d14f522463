"""SentencePiece encoding and decoding with the N best segmentations of a text.

A text is a path through the lattice of its pieces; a path's score is the sum of its pieces'
scores. A forward Viterbi pass gives every node the exact score of its best prefix. A
backward A* search from the end extends partial paths to the left and uses those scores as
its heuristic; being exact, complete paths leave the queue in order of their score.

No piece continues past a space or a line break, or from letters to other characters (pieces
that do so are looked for in each text), so the lattice falls apart into segments there. Each distinct segment is solved once and remembered (a bounded cache). The N best
paths of a text differ from the best one only in the N - 1 segments whose second path costs
least, so the search over whole texts runs over those.

Spaces become the piece mark, one space is put in front, and characters outside the
vocabulary become byte pieces, so decoding gives the text back exactly.

Defined results: a null text stays null with no pieces; an empty text has no pieces, the
score 0 and one segmentation. Equal scores are ordered by the pieces' ids from the right.
Repeated rows are encoded row by row, empty tables give empty results. Only the columns in
``keep`` and the text are read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Letters, digits or other characters after spaces; and, wider, all up to the next space.
SEGMENT = re.compile(r" *[^\W\d_]+| *\d+| +(?:[^\w\n ]|_)*|(?:[^\w\n ]|_)+|\n")
WIDE = re.compile(r" +[^ \n]*|[^ \n]+|\n")
CACHED_CHARS, CACHED_SEGMENTS = 48, 220_000

Vocabulary = tuple[dict[str, tuple[int, int]], dict[int, bytes], dict[int, int], int, str]


def vocabulary(model_file: str = MODEL) -> Vocabulary:
    """Pieces with id and cost (score below zero), bytes for each id, ids of the byte pieces, a byte's cost, a digest."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, text, of_byte = {}, {}, {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            of_byte[int(p[1:-1], 16)] = i
            text[i] = bytes([int(p[1:-1], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[p.replace("▁", " ")] = (i, -round(sp.get_score(i)))
            text[i] = p.replace("▁", " ").encode()
    worst = max(c for _, c in pieces.values() if c < 10**8)
    pieces = {p: (i, min(c, worst + 5)) for p, (i, c) in pieces.items()}  # runs of spaces carry a score of minus a billion
    return pieces, text, of_byte, worst + 10, hashlib.sha256(sp.serialized_model_proto()).hexdigest()


class Lattice:
    """Segmentations over one vocabulary; its pieces stand in a tree of characters."""

    def __init__(self, vocab: Vocabulary):
        self.pieces, self.text, self.of_byte, self.byte_cost, self.digest = vocab
        self.cost_of = np.full(max(self.text) + 1, self.byte_cost, np.int64)
        for i, cost in self.pieces.values():
            self.cost_of[i] = cost
        # No piece may reach across a cut. The few that do rule the narrow cuts out for texts that hold them.
        self.across = [p for p in self.pieces if len(SEGMENT.findall(p)) > 1]
        self.root: dict = {}  # character: [ids, cost or None, the next characters]
        for p, (i, cost) in self.pieces.items():
            node, kids = None, self.root
            for c in p:
                node = kids.setdefault(c, [None, None, {}])
                kids = node[2]
            node[:2] = (i,), cost
        self.recent: dict[str, tuple[bytes, float]] = {}
        self.older: dict[str, tuple[bytes, float]] = {}
        self.several: dict[tuple[str, int], list[tuple[int, tuple[int, ...]]]] = {}

    def segments(self, text: str) -> list[str]:
        """The parts of a text, after a space in front, that no piece reaches across."""
        cut = WIDE if any(p in text for p in self.across) else SEGMENT
        return cut.findall(" " + text) if text else []

    def edges(self, s: str) -> tuple[list[tuple[int, int, tuple[int, ...], int]], list[int]]:
        """The edges (start, end, ids, cost) by start, and the cost of the best prefix for each node."""
        n = len(s)
        best: list = [0] + [1 << 60] * n
        found = []
        for i in range(n):
            kids, j, so_far = self.root, i, best[i]
            while j < n:
                node = kids.get(s[j])
                if node is None:
                    break
                j += 1
                own, cost, kids = node
                if own is not None:
                    found.append((i, j, own, cost))
                    if so_far + cost < best[j]:
                        best[j] = so_far + cost
            if s[i] not in self.pieces:
                raw = s[i].encode()
                cost = len(raw) * self.byte_cost
                found.append((i, i + 1, tuple(self.of_byte[b] for b in raw), cost))
                best[i + 1] = min(best[i + 1], so_far + cost)
        return found, best

    def paths(self, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best segmentations by backward A*: cost and ids."""
        if (s, n) in self.several:
            return self.several[s, n]
        edges, best = self.edges(s)
        into: list[list] = [[] for _ in range(len(s) + 1)]
        for i, j, own, c in edges:
            into[j].append((i, own, c))
        steps: list[tuple[int, tuple[int, ...]]] = [(-1, ())]  # the step to the right and the piece, for each partial path
        queue = [(best[-1], len(s), 0)]  # total, node, step; of equal totals the one nearest to the start
        found: list[tuple[int, int]] = []
        while queue and len(found) < n:
            total, j, k = heapq.heappop(queue)
            if not j:
                found.append((total, k))
                continue
            cost = total - best[j]
            for i, own, c in into[j]:
                steps.append((k, own))
                heapq.heappush(queue, (cost + c + best[i], i, len(steps) - 1))
        first = tuple(np.frombuffer(self.solve(s)[0], np.int32).tolist())
        out = [(best[-1], first)]
        for total, k in found:
            own = []
            while k > 0:
                k, piece = steps[k]
                own.extend(piece)
            if tuple(own) != first:
                out.append((total, tuple(own)))
        out = out[:n]
        if len(s) <= CACHED_CHARS:
            if len(self.several) >= CACHED_SEGMENTS // 20:
                self.several.clear()
            self.several[s, n] = out
        return out

    def solve(self, s: str) -> tuple[bytes, float]:
        """The best segmentation (int32 ids) and what the second best costs more."""
        known = self.older.get(s)
        if known is None:
            n, root, far = len(s), self.root, 1 << 60
            first, second, back = [0] + [far] * n, [far] * (n + 1), [None] * (n + 1)
            for i, c in enumerate(s):  # the two best prefixes for each node; a shorter one is final before it is extended
                one, two, j = first[i], second[i], i + 1
                node = root.get(c)
                if node is None or node[0] is None:
                    raw = c.encode()
                    leaves = ((j, tuple(self.of_byte[b] for b in raw), len(raw) * self.byte_cost),)
                else:
                    leaves = ()
                while node is not None:
                    own, cost, kids = node
                    if own is not None:
                        total = one + cost
                        if total < first[j]:
                            second[j] = min(first[j], two + cost)
                            first[j], back[j] = total, (i, own)
                        elif total < second[j]:
                            second[j] = total
                            if total == first[j] and own < back[j][1][::-1]:
                                back[j] = (i, own)
                    if j == n:
                        break
                    node = kids.get(s[j])
                    j += 1
                for j, own, cost in leaves:
                    if one + cost < first[j]:
                        second[j] = min(first[j], two + cost)
                        first[j], back[j] = one + cost, (i, own)
                    elif one + cost < second[j]:
                        second[j] = one + cost
                        if one + cost == first[j] and own[::-1] < back[j][1][::-1]:
                            back[j] = (i, own)
            own, j = [], n
            while j:
                j, piece = back[j]
                own.append(piece)
            ids = array("i", chain.from_iterable(reversed(own))).tobytes()
            known = (ids, float(second[n] - first[n]) if second[n] < far // 2 else math.inf)
        if len(s) <= CACHED_CHARS:
            if len(self.recent) >= CACHED_SEGMENTS:
                self.older, self.recent = self.recent, {}
            self.recent[s] = known
        return known

    def encode(self, text: str, n: int) -> tuple[np.ndarray, list[int], list[tuple[list[int], list[tuple[int, ...]]]]]:
        """Ids of the best segmentation, the costs of the ``n`` best, and for each the segments that differ."""
        if not text:
            return np.empty(0, np.int32), [0], [([], [])]
        segments = self.segments(text)
        get = self.recent.get
        solved = [get(x) or self.solve(x) for x in segments]
        each, gaps_of = zip(*solved, strict=True)
        ids = np.frombuffer(b"".join(each), np.int32)
        total = int(self.cost_of[ids].sum())
        if n < 2:
            return ids, [total], [([], [])]
        gaps = np.array(gaps_of)
        chosen = [int(k) for k in np.argsort(gaps, kind="stable")[: n - 1] if np.isfinite(gaps[k])]
        lists = [self.paths(segments[k], n) for k in chosen]
        costs, changes = [], []
        start = (0,) * len(chosen)
        queue, seen = [(total, start)], {start}
        while queue and len(costs) < n:
            cost, at = heapq.heappop(queue)
            costs.append(cost)
            changes.append(([chosen[k] for k, a in enumerate(at) if a], [lists[k][a][1] for k, a in enumerate(at) if a]))
            for k, a in enumerate(at):
                if a + 1 < len(lists[k]):
                    new = at[:k] + (a + 1,) + at[k + 1 :]
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(queue, (cost - lists[k][a][0] + lists[k][a + 1][0], new))
        return ids, costs, changes

    def alternatives(self, text: str, n: int) -> list[tuple[int, list[int]]]:
        """Cost and ids of the ``n`` best segmentations of the whole text."""
        _, costs, changes = self.encode(text, n)
        solved = [np.frombuffer(self.solve(s)[0], np.int32).tolist() for s in self.segments(text)]
        out = []
        for cost, (places, new) in zip(costs, changes, strict=True):
            swap = dict(zip(places, new, strict=True))
            out.append((cost, [i for k, own in enumerate(solved) for i in swap.get(k, own)]))
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(map(self.text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")[1:]


_LATTICES: dict[str, Lattice] = {}


def _lattice(vocab) -> Lattice:
    """One lattice, with its cache, for each Python worker; kept while the vocabulary is the same."""
    digest = vocab.value[-1]
    if digest not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[digest] = Lattice(vocab.value)
    return _LATTICES[digest]


def shared_vocabulary(spark: SparkSession, model_file: str = MODEL):
    """The vocabulary, of fixed size, sent once to each executor."""
    ship(spark)
    return spark.sparkContext.broadcast(vocabulary(model_file))


def encode(docs: DataFrame, keep: list[str], text: str = "text", nbest: int = 4, model_file: str = MODEL, rows: int = 256) -> DataFrame:
    """``keep`` with ``ids``, the scores of the ``nbest`` best segmentations, ``alternatives`` and ``exact``: the ids decode to the text.

    An alternative to the best segmentation (``nth`` from 1) is told by the ids of the segments that
    differ: ``segment`` counts the parts that ``Lattice.segments`` gives.
    """
    vocab = shared_vocabulary(docs.sparkSession, model_file)
    kept = docs.select(*keep, docs[text].alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    kind = pa.list_(pa.struct([("nth", pa.int32()), ("segment", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocab)
        raw = lattice.text.__getitem__
        gc.disable()  # millions of small tuples, none of them in a cycle
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    ids, offsets, scores, others, exact = [], [0], [], [], []
                    for t in part.column(part.num_columns - 1).to_pylist():
                        own, costs, changes = lattice.encode(t or "", nbest)
                        exact.append(b"".join(map(raw, own.tolist())) == (b" " + t.encode() if t else b""))
                        ids.append(own)
                        offsets.append(offsets[-1] + len(own))
                        scores.append([float(-c) for c in costs] if t is not None else None)
                        others.append([{"nth": n, "segment": k, "ids": new} for n, change in enumerate(changes) for k, new in zip(*change, strict=True)])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids)))
                    columns = [*part.columns[:-1], lists, pa.array(scores, pa.list_(pa.float64())), pa.array(others, kind), pa.array(exact)]
                    yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "ids", "scores", "alternatives", "exact"])
        finally:
            gc.enable()

    return kept.mapInArrow(run, f"{types}, ids array<int>, scores array<double>, alternatives array<struct<nth:int,segment:int,ids:array<int>>>, exact boolean")


def decode(encoded: DataFrame, keep: list[str], ids: str = "ids", model_file: str = MODEL) -> DataFrame:
    """``keep`` with the decoded ``text``; null ids give a null text."""
    vocab = shared_vocabulary(encoded.sparkSession, model_file)
    kept = encoded.select(*keep, encoded[ids].alias("_ids"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocab)
        for batch in batches:
            texts = [None if x is None else lattice.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return kept.mapInArrow(run, f"{types}, text string")
