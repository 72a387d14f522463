"""Toxicity: support vector machines on subsequence string kernels with Nyström landmarks.

Two machines are trained on a bounded sample of labelled texts (``max_texts``).

The text machine (``text_kernel``) takes each labelled text as one string, so it learns words, their parts and
phrases alike from the texts' labels.

The close machine knows altered forms of single words, which may stand once in a long text. Its kernel of two strings sums, over their common three-letter subsequences with at most
``GAPS`` skipped letters between neighbours, a weight that decays with the letters spanned, and
is scaled to 1 for equal strings; it takes the power ``POWER`` of that. A word's ends count as letters.
So an insult with letters inserted or left out stays close to the plain one. Words are
lower-cased, with marks removed from within, and runs of single letters taken together.
It learns the words whose counts lean most to toxic texts (at least half as much as the first) and forms of theirs made by
rule (``variants``), against all clean words that come within ``NEAR`` of them. A word further away
has the margin ``FAR``; an upper bound on the closeness to all toxic landmarks at once is a
sum of lookups, so only few words meet the landmarks one by one.

A logistic curve for each machine turns a text's margin, or its largest word margin, into a probability. The text machine's is fitted on
margins of texts that it did not see, that of the close one on toxic texts with altered words too. Each label is weighted by its count in all
training labels. The score is the probability that at least one machine is right (noisy or). Triples share 2^``BITS`` slots by a hash; of the some thousand that carry a
weight, about one in a hundred shares its slot with another.

Defined results: a null or empty text has no words and gets the score of that. Texts with a
null label, or without one, are only scored. If the sample has one class only, the score is
that class's share, smoothed. Repeated rows are scored row by row, empty tables give empty
results. Equal leans are ordered by the word. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import ship
from .text_kernel import TextMachine, svm, trained

DECAY, GAPS, BITS = 0.6, 1, 18
POWER, NEAR, FAR = 2, 0.3, -2.0
STEPS = [(a, a + b) for a in range(1, GAPS + 2) for b in range(1, GAPS + 2)]  # offsets of the second and third letter
SPLIT = re.compile(rb"[\x00-\x20]+")
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][\s.\-_*]){2,}[^\W_](?![^\W_])")
MARKS = bytes(c for c in range(128) if not chr(c).isalpha() and c > 32)


def prepared(text: str | None) -> bytes:
    """Lower-cased words between single spaces, without ASCII marks and digits, spelled-out words joined."""
    t = (text or "").lower()
    if SPELLED.search(t):
        t = SPELLED.sub(lambda m: re.sub(r"[\s.\-_*]", "", m.group()), t)
    return b" " + b" ".join(t.encode().translate(None, MARKS).split()) + b" "


def triples(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each gap pattern: positions whose triple lies in one word, those where it may hold one of its ends, the triple's slot, its weight."""
    x = data.astype(np.uint32)
    space = np.concatenate([[0], np.cumsum(data == 32)])
    for a, b in STEPS:
        n = len(x) - b
        if n <= 0:
            continue
        key = (x[:n] * np.uint32(0x9E3779B1)) ^ (x[a : n + a] * np.uint32(0x85EBCA6B)) ^ (x[b:] * np.uint32(0xC2B2AE35))
        key ^= key >> np.uint32(15)
        spanned = space[b + 1 :] - space[:n]
        ends = (space[b : n + b] == space[1 : n + 1]) & (spanned <= 1)
        yield spanned == 0, ends, ((key * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int64), DECAY ** (b - 2)


def norms(square: np.ndarray, plain: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What a word's sums are divided by; the second term holds for words that repeat a few triples."""
    return np.maximum(np.maximum(np.sqrt(np.add.reduceat(square, starts)), np.add.reduceat(plain, starts) / 8), 1e-9)


def word_sums(data: np.ndarray, weight: np.ndarray, ends: bool, row_of: np.ndarray | None = None) -> np.ndarray:
    """For each word of prepared text: its triples' weights (by slot, or by the row of a slot) summed and divided by the word's norm."""
    starts = np.flatnonzero(data == 32)[:-1]
    total, square, plain = np.zeros((len(data), *weight.shape[1:])), np.zeros(len(data)), np.zeros(len(data))
    for inside, with_ends, key, w in triples(data):
        own = with_ends if ends else inside
        at = np.where(own, key, 1 << BITS)  # past the last slot there is no weight
        total[: len(key)] += weight[at if row_of is None else row_of[at]] * w
        square[: len(key)] += own * (w * w)
        plain[: len(key)] += own * w
    if not len(starts):
        return total[:0]
    return np.add.reduceat(total, starts) / norms(square, plain, starts).reshape(-1, *[1] * (weight.ndim - 1))


def joined(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)


def variants(word: bytes) -> list[bytes]:
    """The word with one letter put in, one left out, and two put in apart, after its first letter."""
    n, letters = len(word), b"xzaeiokq"
    put = [word[:k] + letters[j : j + 1] + word[k:] for k in range(1, n) for j in ((k + n) % 8, (3 * k + n + 4) % 8)]
    out = [word[:k] + word[k + 1 :] for k in range(1, n)] if n > 4 else []
    two = [word[:k] + letters[k % 8 : k % 8 + 1] + word[k:m] + letters[(k + m) % 8 : (k + m) % 8 + 1] + word[m:] for k in range(1, n - 1) for m in (min(n - 1, k + 2),) if m > k]
    return list(dict.fromkeys(put + out + two))


class Marks:
    """Landmarks of the kernel, with the words' ends or without: their triples by slot."""

    def __init__(self, words: list[bytes], ends: bool):
        self.words, self.ends = words, ends
        masked = [(with_ends if ends else inside, key, w, k) for k, word in enumerate(words) for inside, with_ends, key, w in triples(joined([word]))]
        found = [(key[own], np.full(int(own.sum()), w), k) for own, key, w, k in masked]
        slots, first = np.unique(np.concatenate([x for x, _, _ in found]), return_inverse=True)
        self.table = np.zeros((len(slots) + 1, len(words)))  # the last row is empty
        np.add.at(self.table, (first, np.repeat([k for _, _, k in found], [len(x) for x, _, _ in found])), np.concatenate([w for _, w, _ in found]))
        data = joined(words)
        square, plain = np.zeros(len(data)), np.zeros(len(data))
        for inside, with_ends, key, w in triples(data):
            own = with_ends if ends else inside
            square[: len(key)] += own * (w * w)
            plain[: len(key)] += own * w
        self.table /= norms(square, plain, np.flatnonzero(data == 32)[:-1])
        self.row_of = np.full((1 << BITS) + 1, len(slots), np.int32)
        self.row_of[slots] = np.arange(len(slots))

    def kernel(self, words: list[bytes], most: int = 5000) -> np.ndarray:
        """Scaled kernel of words with the landmarks."""
        parts = [word_sums(joined(words[at : at + most]), self.table, self.ends, self.row_of) for at in range(0, len(words), most)]
        return np.concatenate([np.empty((0, self.table.shape[1])), *parts])

    def root(self, power: int) -> np.ndarray:
        """Inverse root of the landmarks' kernel matrix: values against the landmarks times this are Nyström features."""
        value, vector = np.linalg.eigh(self.kernel(self.words) ** power)
        return vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T


def apart(words: list[bytes], close: float, most: int, ends: bool) -> list[bytes]:
    """The first words, at most ``most``, whose kernel with each before them is below ``close``."""
    found: list[bytes] = []
    for w in words:
        if len(found) == most:
            break
        if not found or Marks(found, ends).kernel([w]).max() < close:
            found.append(w)
    return found


@dataclass
class Model:
    """The text machine; the close machine and its bound by slot; the logistic curves of their margins."""

    texts: TextMachine | None = None
    bound: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    marks: Marks | None = None
    toxic: int = 0  # that many landmarks of the close machine are toxic words
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    near_bias: float = FAR
    curves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (-30.0, 0.0))
    seen: dict[bytes, float] = field(default_factory=dict)

    def near_margins(self, words: list[bytes]) -> np.ndarray:
        k = self.marks.kernel(words)
        return np.where(k[:, : self.toxic].max(axis=1, initial=0.0) >= NEAR, k**POWER @ self.weight + self.near_bias, FAR)

    def tops(self, texts: list[bytes]) -> np.ndarray:
        """The text margin and the largest margin of a word by the close machine, of each prepared text."""
        top, near = np.full((len(texts), 2), FAR), []
        for k, t in enumerate(texts):
            if self.texts is not None:
                top[k, 0] = self.texts.margin(t)
            may = np.flatnonzero(word_sums(np.frombuffer(t, np.uint8), self.bound, True) >= NEAR) if self.marks is not None else []
            words = t.split() if len(may) else []
            near.append({words[j] for j in may})
        if len(self.seen) > 200_000:
            self.seen.clear()
        if new := sorted(set().union(*near) - self.seen.keys()):
            self.seen.update(zip(new, self.near_margins(new).tolist(), strict=True))
        for k, words in enumerate(near):
            top[k, 1] = max([FAR, *map(self.seen.__getitem__, words)])
        return top

    def scores(self, texts: list[str | None]) -> np.ndarray:
        top = self.tops([prepared(t) for t in texts])
        clear = [1 / (1 + np.exp(np.clip(a + b * top[:, k], -30, 30))) for k, (a, b) in enumerate(self.curves)]
        return 1 - clear[0] * clear[1]

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Logistic curve of one margin, weighted, towards smoothed targets."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (target - p)) - ridge * w), -5, 5)
    return float(w[0]), float(w[1])


def train(texts: list[str], toxic: list[int], counts: dict[int, int] | None = None, landmarks: int = 128) -> Model:
    """The model of a bounded sample of labelled texts; ``counts``: how many texts have each label in all; ``landmarks``: those of the close machine."""
    y = np.array(toxic, int)
    counts = counts or {k: int((y == k).sum()) for k in (0, 1)}
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return Model(curves=((prior, 0.0), (-30.0, 0.0)))
    ready = [prepared(t) for t in texts]
    share = np.where(y == 1, counts.get(1, 0) / n1, counts.get(0, 0) / n0)
    machine, margins = trained(ready, toxic)
    model = Model(machine, curves=(_platt(margins, y, share), (-30.0, 0.0)))

    bags = [[w for w in dict.fromkeys(t.split()) if len(w) >= 3] for t in ready]
    has = (Counter(), Counter())
    for bag, t in zip(bags, toxic, strict=True):
        has[t].update(bag)
    lean = {w: np.sqrt(has[0][w] + has[1][w]) * np.log(((has[1][w] + 0.5) / (n1 + 1)) / ((has[0][w] + 0.5) / (n0 + 1))) for w in set(has[0]) | set(has[1]) if has[0][w] + has[1][w] >= 2}
    ranked = sorted(lean, key=lambda w: (-lean[w], w))
    if not ranked or lean[ranked[0]] <= 0:
        return model
    clean = sorted(has[0], key=lambda w: (-has[0][w], w))
    known = set(clean)
    evened = lambda pull, sign: 5000 * np.where(sign > 0, pull / pull[sign > 0].sum(), pull / max(pull[sign < 0].sum(), 1e-9))

    # The close machine: the words that lean most and altered forms of theirs, against all clean words that come near them.
    most = [w for w in ranked if lean[w] >= 0.5 * lean[ranked[0]]]
    own = apart(most, 0.8, landmarks // 2, True)
    closest = Marks(own, True).kernel(clean).max(axis=1, initial=0.0)
    near = [clean[k] for k in np.argsort(-closest, kind="stable").tolist() if closest[k] >= NEAR]
    model.marks, model.toxic = Marks(own + apart(near, 0.8, landmarks - len(own), True), True), len(own)
    model.bound = model.marks.table[:, : len(own)].max(axis=1, initial=0.0)[model.marks.row_of]
    root = model.marks.root(POWER)
    altered = {v: w for w in most for v in variants(w) if v not in known}
    words = most + list(altered) + near
    sign = np.where(np.arange(len(words)) < len(words) - len(near), 1.0, -1.0)
    pull = np.sqrt(np.array([has[1][w] for w in most] + [has[1][w] / 4 for w in altered.values()] + [has[0][w] for w in near], float) + 1)
    w = svm(model.marks.kernel(words) ** POWER @ root, sign, evened(pull, sign))
    model.weight, model.near_bias = root @ w[:-1], float(w[-1])

    # The close machine's curve, with one altered form in place of a text's toxic words once more.
    forms: dict[bytes, list[bytes]] = {}
    for v, w in altered.items():
        forms.setdefault(w, []).append(v)
    top = model.tops(ready)
    more, told = [], y == 0
    for k in np.flatnonzero(y).tolist():
        if here := [w for w in bags[k] if w in forms]:
            told[k] = True
            pick = forms[here[k % len(here)]]
            more.append(joined([*[w for w in ready[k].split() if w not in forms], pick[7 * k % len(pick)]]).tobytes())
    close = np.append(top[told, 1], model.tops(more)[:, 1])
    weight = np.append(share[told], np.full(len(more), counts.get(1, 0) / n1))
    model.curves = model.curves[0], _platt(close, np.append(y[told], np.ones(len(more))), weight)
    return model


def fold_of(id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, id: str, text: str, fold: Column, max_texts: int, max_chars: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``max_texts`` labelled training texts of at most ``max_chars``, by a hash of the id; all labels' counts."""
    known = labels.where(F.col(label).isNotNull()).groupBy(id).agg(F.max(label).alias("_label"))
    fits = docs.where(fold & (F.length(F.coalesce(text, F.lit(""))) <= max_chars)).select(id).distinct().join(known, id)
    half = lambda y: fits.where(F.col("_label") == y).orderBy(F.xxhash64(id, F.lit(17)), id).limit(max_texts // 2)
    chosen = half(1).unionByName(half(0))  # at most max_texts ids; only their texts move
    rows = docs.where(fold).select(id, F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(chosen), id)
    rows = rows.where(F.length("_text") <= max_chars).groupBy(id).agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))
    counts = {int(r["_label"]): r["count"] for r in known.where(fold).groupBy("_label").count().collect()}
    return sorted((r["_text"], int(r["_label"])) for r in rows.collect()), counts


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, max_texts: int = 3000, max_chars: int = 8000) -> DataFrame:
    """One row per document: ``held_out`` and ``score``; learns from labels outside the held fold only."""
    ship(docs.sparkSession)
    taken, counts = sample(docs, labels, label, id, text, fold_of(F.col(id), folds) != held, max_texts, max_chars)
    model = docs.sparkSession.sparkContext.broadcast(train([t for t, _ in taken], [y for _, y in taken], counts))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            scores = []
            for at in range(0, len(batch), 512):
                scores.append(model.value.scores(batch.iloc[at : at + 512].tolist()))
            yield pd.Series(np.concatenate(scores or [np.empty(0)]))

    return docs.select(F.col(id), (fold_of(F.col(id), folds) == held).alias("held_out"), score(F.col(text)).alias("score"))
