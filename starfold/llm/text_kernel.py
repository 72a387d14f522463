"""A support vector machine on a subsequence string kernel of whole texts, with Nyström landmarks.

A text is one string: its words between single spaces, which count as letters. The kernel of two texts
sums over their common four-letter subsequences, in which at most one letter is skipped, the product of
the roots of how often each text holds them (a skipped letter counts ``DECAY``), weighted by how rare they are, and
is scaled to 1 for equal texts. So a letter put in or left out changes few of a word's terms, and a phrase
counts by the letters around its spaces.

Subsequences share 2^``BITS`` slots by a hash. Of those the kernel takes the ``features`` that tell the labels
apart best, by the square of the difference of the labels' shares of texts over its variance, as far as that is
beyond chance (``CHANCE``, a chi-square; ``LEAST`` of them in any case). Landmarks are
labelled texts, evenly over the sample and half of each label. The machine is trained on the labelled texts in the
landmarks' space, and its weights fold back to one for each slot, so a margin is a sum of lookups.

Margins of texts that a machine was trained on are too sure: ``trained`` returns those of machines
that never saw the text's third of the sample (by its checksum), wherever each label has enough texts for that.

A text without a known subsequence has the margin of the bias. Texts are read in pieces of ``PIECE`` letters that overlap, so memory
follows neither a text's length nor its terms.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

DECAY, BITS, PIECE = 0.6, 18, 1 << 20
STEPS = [((1, 2, 3), 0), ((2, 3, 4), 1), ((1, 3, 4), 1), ((1, 2, 4), 1)]  # offsets of the other letters, letters skipped
CHANCE, LEAST, LEAST_TEXTS = 10.0, 64, 6
MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x165667B1, 0x27D4EB2F)


def slots(text: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """The slots of all subsequences of a text, and how many letters they skip, in arrays of bounded size."""
    m = [np.uint32(v) for v in MIX]
    for at in range(0, max(1, len(text)), PIECE):
        x = np.frombuffer(text[at : at + PIECE + 4], np.uint8).astype(np.uint32)
        for (a, b, c), skipped in STEPS:
            n = min(PIECE, len(x) - c)
            if n > 0:
                key = (x[:n] * m[0]) ^ (x[a : n + a] * m[1]) ^ (x[b : n + b] * m[2]) ^ (x[c : n + c] * m[3])
                key ^= key >> np.uint32(15)
                yield ((key * m[4]) >> np.uint32(32 - BITS)).astype(np.int64), skipped


@dataclass
class TextMachine:
    row: np.ndarray  # feature of each slot, their number for a slot without
    rare: np.ndarray  # weight of each feature in the kernel
    fold: np.ndarray  # the machine's weight of each feature
    bias: float = 0.0

    def features(self, text: bytes) -> np.ndarray:
        """The text in the kernel's space, of length 1 or 0."""
        size = len(self.rare) + 1
        count = np.zeros((2, size))
        for slot, skipped in slots(text):
            count[skipped] += np.bincount(self.row[slot], minlength=size)
        x = self.rare * np.sqrt(count[0] + DECAY * count[1])[:-1]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def margin(self, text: bytes) -> float:
        return float(self.features(text) @ self.fold) + self.bias


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 300) -> np.ndarray:
    """Linear SVM with squared hinge loss by accelerated gradient steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    rate = 1 / (1 + 2 * np.linalg.norm(x * np.sqrt(cost)[:, None], 2) ** 2)
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = np.append(v[:-1], 0.0) - 2 * (x.T @ (cost * y * slack))
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def machine(texts: list[bytes], y: np.ndarray, held: np.ndarray, features: int, landmarks: int, cost: float) -> TextMachine:
    """The machine of the labelled texts, each distinct slot of a text counted once; ``held[label]`` counts the texts that hold a slot."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    share = (held + 0.5) / (n + 1)[:, None]
    both = (held.sum(0) + 1) / (n.sum() + 2)
    lean = (share[1] - share[0]) ** 2 / (both * (1 - both))
    order = np.argsort(-np.where(held.sum(0) > 1, lean, -1), kind="stable")[:features]
    chosen = order[: max(LEAST, int((lean[order] * n.sum() >= CHANCE).sum()))]
    row = np.full(1 << BITS, len(chosen), np.int32)
    row[chosen] = np.arange(len(chosen))
    model = TextMachine(row, -np.log(both[chosen]), np.zeros(len(chosen)))
    x = np.stack([model.features(t) for t in texts]).astype(np.float32)
    spread = lambda at: at[np.unique(np.linspace(0, len(at) - 1, min(len(at), landmarks // 2)).astype(int))]
    marks = x[np.concatenate([spread(np.flatnonzero(y == k)) for k in (0, 1)])].astype(float)
    value, vector = np.linalg.eigh(marks @ marks.T)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    w = svm(x @ marks.T @ root, 2.0 * y - 1, np.full(len(y), cost))
    model.fold, model.bias = marks.T @ (root @ w[:-1]), float(w[-1])
    return model


def trained(texts: list[bytes], labels: list[int], features: int = 4096, landmarks: int = 512, cost: float = 10.0, parts: int = 3) -> tuple[TextMachine, np.ndarray]:
    """The machine of all labelled texts, which have both labels, and each text's margin by one that was not trained on it.

    Copies share a part. If a part leaves fewer than ``LEAST_TEXTS`` texts of a label, the margins are the machine's own.
    """
    y = np.array(labels, int)
    part = np.array([zlib.crc32(t) % parts for t in texts])  # copies share a part
    held = np.zeros((parts, 2, 1 << BITS), np.float32)
    for t, k, p in zip(texts, labels, part.tolist(), strict=True):
        own = np.zeros(1 << BITS, bool)
        for slot, _ in slots(t):
            own[slot] = True
        held[p, k] += own
    fit = lambda at, counts: machine([texts[k] for k in np.flatnonzero(at).tolist()], y[at], counts, features, landmarks, cost)
    model = fit(part >= 0, held.sum(0))
    left = [(y[part != p] == k).sum() for p in range(parts) for k in (0, 1)]
    if min(left) < LEAST_TEXTS:
        return model, np.array([model.margin(t) for t in texts])
    margins = np.zeros(len(y))
    for p in range(parts):
        other = fit(part != p, held.sum(0) - held[p])
        for k in np.flatnonzero(part == p).tolist():
            margins[k] = other.margin(texts[k])
    return model, margins
