"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Words are maximal runs without ASCII white space. Rolling hashes of the word sequence, one
for each n-gram length, find the windows that repeat an earlier one; the rule measures the
share of word characters inside such windows, and inside lines equal to an earlier line.

Defined results: a null or empty text has no words, so all counts are 0 and the document
fails (fewer than ``min_words`` words). Repeated rows are judged row by row. A table without
rows gives a table without rows. Only the id and the text column are read, so further
columns, whatever their names, have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Largest allowed share of word characters in repeats, for each n-gram length and for lines."""

    min_words: int = 50
    repeat_words_pct: int = 50
    grams: tuple[tuple[int, float], ...] = ((5, 0.30), (7, 0.28), (10, 0.26))
    lines: float = 0.30
    symbols_per_word: float = 0.1


def word_ids(words: list[bytes]) -> np.ndarray:
    """The words as numbers in order of first appearance."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the windows that occur twice or more, and of those that repeat an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later = np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def spread(windows: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the words inside marked windows of ``length`` words."""
    edge = np.zeros(n + 1, np.int64)
    edge[: len(windows)] += windows
    edge[length : length + len(windows)] -= windows
    return np.cumsum(edge[:n]) > 0


def exact_trigrams(ids: np.ndarray) -> np.ndarray:
    """One number for each 3-word window, equal only for equal windows."""
    v = int(ids.max()) + 1
    first = ids[:-2] * v + ids[1:-1]
    if v >= 1 << 21:
        first = np.unique(first, return_inverse=True)[1]
    return first * v + ids[2:]


def rolling(ids: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length (ascending), the hash of every window of so many words."""
    digit = (ids.astype(np.uint64) + np.uint64(1)) * MIX
    digit ^= digit >> np.uint64(29)
    key = digit
    for k in range(2, max(lengths) + 1):
        if len(ids) < k:
            return
        key = key[:-1] * BASE + digit[k - 1 :]
        if k in lengths:
            yield k, key


def code_points(words: list[bytes]) -> np.ndarray:
    """Code points of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    joined = np.frombuffer(b"".join(words), np.uint8)
    if joined.size and joined.max() > 127:
        heads = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
        ends = np.cumsum(sizes)
        return heads[ends] - heads[ends - sizes]
    return sizes


def measure(text: str | None, limits: Limits) -> tuple:
    """Counts, shares and verdict of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n, n_symbols = len(words), sum(map(raw.count, SYMBOLS))
    word_chars = len(text) - sum(map(raw.count, BLANKS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup_lines, line_share = len(lines) - len(set(lines)), 0.0
    if n_dup_lines:
        seen: set[bytes] = set()
        later = [len(x) for x in lines if x in seen or seen.add(x)]
        line_share = sum(later) / sum(map(len, lines))
    n_repeat, shares = 0, dict.fromkeys((k for k, _ in limits.grams), 0.0)
    if n >= 3:
        ids = word_ids(words)
        n_repeat = int(spread(repeats(exact_trigrams(ids))[0], 3, n).sum())
        if n_repeat:  # a longer window can repeat only where its 3-word windows do
            chars = code_points(words)
            for k, keys in rolling(ids, tuple(shares)):
                later = repeats(keys)[1]
                if not later.any():
                    break
                shares[k] = float(chars[spread(later, k, n)].sum() / word_chars)
    failed = n < limits.min_words or 100 * n_repeat > limits.repeat_words_pct * n
    kept = not failed and line_share <= limits.lines and n_symbols <= limits.symbols_per_word * n and all(shares[k] <= most for k, most in limits.grams)
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, failed, kept, line_share, max(shares.values(), default=0.0)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_gram_share double"


def quality_rules(docs: DataFrame, text: str = "text", out: str = "rules", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with a struct column ``out`` of counts, shares and the verdict ``kept``; no shuffle."""
    ship(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([measure(x, limits) for x in batch], columns=names)

    return docs.withColumn(out, judge(F.col(text)))
