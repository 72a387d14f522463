"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over the UTF-8 bytes of the whole text (a filter is one weight
for each offset and byte value). Activations are max-pooled in chunks of ``CHUNK`` bytes that
overlap by half; a logistic layer combines the largest and the mean pooled value of each filter
over all chunks into one probability. The filters and the layer are learned together by
gradient steps (Adam) through the pooling, on a bounded sample of labelled texts.

Defined results: a null or empty text is one chunk of zero bytes. Texts with a null label, or
without one, are only scored; if the sample has one class only, the score is that class's
share, smoothed. Repeated rows are scored row by row, empty tables give empty results. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship
from .toxicity import fold_of, sample

WIDTH, FILTERS, CHUNK = 5, 12, 256
PIECE = 1 << 16  # bytes convolved at once


class Network:
    """Filters, their bias, and the logistic layer."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w = (r.standard_normal((WIDTH, 256, FILTERS)) * 0.1).astype(np.float32)
        self.b = np.full(FILTERS, 0.1, np.float32)
        self.out = (r.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.offset = 0.0  # moves the log odds from the sample's to all labels' proportions

    def halves(self, data: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest activation before rectifying in each half chunk, and its position."""
        half = CHUNK // 2
        values, places = [], []
        for at in range(0, len(data) - WIDTH + 1, PIECE):
            part = data[at : at + PIECE + WIDTH - 1]
            n = len(part) - WIDTH + 1
            act = self.w[0][part[:n]]
            for k in range(1, WIDTH):
                act += self.w[k][part[k : n + k]]
            short = -n % half
            if short:
                act = np.concatenate([act, np.full((short, FILTERS), -1e9, np.float32)])
            act = act.reshape(-1, half, FILTERS)
            values.append(act.max(1))
            if where:
                places.append(act.argmax(1) + np.arange(at, at + len(act) * half, half)[:, None])
        return np.concatenate(values), np.concatenate(places) if where else None

    def pooled(self, text: str | None) -> np.ndarray:
        return self._pool(self._chunks(self.halves(self.bytes_of(text))[0]) + self.b)

    @staticmethod
    def bytes_of(text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        return np.frombuffer(raw + bytes(max(WIDTH - len(raw), 0)), np.uint8)

    @staticmethod
    def _chunks(half: np.ndarray) -> np.ndarray:
        return np.maximum(half[:-1], half[1:]) if len(half) > 1 else half

    @staticmethod
    def _pool(chunk: np.ndarray) -> np.ndarray:
        chunk = np.maximum(chunk, 0)
        return np.concatenate([chunk.max(0), chunk.mean(0)])

    def score(self, text: str | None) -> float:
        odds = float(self.pooled(text) @ self.out + self.bias[0]) + self.offset
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    def gradient(self, data: np.ndarray, y: int) -> tuple[float, list[np.ndarray]]:
        """Log loss of one text and its gradients."""
        half, places = self.halves(data, where=True)
        if len(half) > 1:
            right = half[1:] > half[:-1]
            chunk, at = np.where(right, half[1:], half[:-1]), np.where(right, places[1:], places[:-1])
        else:
            chunk, at = half, places
        raw = chunk + self.b
        act = np.maximum(raw, 0)
        top = act.argmax(0)
        x = np.concatenate([act.max(0), act.mean(0)])
        p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.bias[0], -30, 30)))
        d = np.float32(p - y)
        back = np.tile(d * self.out[FILTERS:] / len(act), (len(act), 1))
        back[top, np.arange(FILTERS)] += d * self.out[:FILTERS]
        back *= raw > 0
        gw = np.zeros_like(self.w)
        f = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            np.add.at(gw[k], (data[at + k], f), back)
        return float(-np.log(max(p if y else 1 - p, 1e-9))), [gw, back.sum(0), d * x, np.array([d], np.float32)]


def train(texts: list[str], good: list[int], counts: dict[int, int] | None = None, epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Network:
    """The network of a bounded sample of labelled texts; ``counts``: how many texts have each label in all."""
    net, y = Network(seed), np.array(good, int)
    counts = counts or {k: int((y == k).sum()) for k in (0, 1)}
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        net.out[:] = 0
        net.offset = prior
        return net
    data = [net.bytes_of(t) for t in texts]
    params = [net.w, net.b, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    r, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = r.permutation(len(data))
        for k in range(0, len(order), batch):
            total = [np.zeros_like(p) for p in params]
            for i in order[k : k + batch]:
                for t, g in zip(total, net.gradient(data[i], good[i])[1], strict=True):
                    t += g
            step += 1
            now = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
            for p, t, m, v in zip(params, total, first, second, strict=True):
                g = t / batch + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.offset = prior - float(np.log((n1 + 0.5) / (n0 + 0.5)))
    return net


def quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4, held: int = 2, max_texts: int = 1600, max_chars: int = 8000) -> DataFrame:
    """One row per document: ``held_out`` and ``score``; learns from labels outside the held fold only."""
    ship(docs.sparkSession)
    taken, counts = sample(docs, labels, label, id, text, fold_of(F.col(id), folds) != held, max_texts, max_chars)
    net = docs.sparkSession.sparkContext.broadcast(train([t for t, _ in taken], [y for _, y in taken], counts))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([net.value.score(t) for t in batch], dtype=float)

    return docs.select(F.col(id), (fold_of(F.col(id), folds) == held).alias("held_out"), score(F.col(text)).alias("score"))
