"""Language-model scores by a Brown class-based bigram model.

A word's probability after a class is P(class | class before) * P(word | class). Classes come
from exchange clustering: words move one at a time to the class that raises the likelihood
of the class bigrams most. It runs in two steps, since the first needs the bigrams of all its units:

* The ``frequent`` most frequent words, and for all other words the cells of a grid of their first
  letter's kind and their last two letters, are clustered over their bigram counts.
* The ``clustered`` most frequent words (all of them, where there are fewer) start in the class of
  their unit and move by what classes stand before and after them in all training texts.

Words beyond these bounds, which bound the size of the model in a task, and unseen ones have the
class of their cell. Emissions are smoothed counts within a class, with one place for an unseen word;
transitions are smoothed counts of all training texts with the final classes. Both are proper
distributions.

Texts are read twice: for the words' counts, and to write the codes of their tokens to the shared folder,
from which all further passes start. Word counts cover all training texts. The most frequent words' counts (``known_words``, a
bound) go to every task; the other tokens of all texts meet their counts in one join, which
has no hot key, as the hot words are gone by then.

Defined results: a null or empty text has one token, its end. Rows are scored one by one, ids
may repeat or be null. Without training texts every count is 0. Empty tables give empty
results. Equally frequent words are ordered by their bytes. Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, ship
from .toxicity import fold_of

END = b""  # the end of a text; no word is empty
CHUNK = 128  # texts whose units are looked up at once
CELLS = 509
BLOCK = 256  # units whose neighbour counts are one row


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, and the end."""
    return [*(text or "").encode().lower().split(), END]


def cell(word: bytes) -> int:
    """A cell for a word that is not frequent: by its ending and what kind of character starts it."""
    kind = 0 if word[:1].isalpha() else 1 if word[:1].isdigit() else 2 if word[:1] >= b"\x80" else 3
    tail = word.rstrip(b".,;:!?")[-2:] or word[-2:]
    value = 0
    for c in tail:
        value = value * 257 + c + 1
    return (value * 4 + kind + (word[-1:] in b".,;:!?") * 7919) % CELLS


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each unit by exchange clustering over unit bigram counts.

    Unit 0 (start) and 1 (end) keep classes of their own. The likelihood of the class bigrams is
    the sum of n log n over class pairs less that over the two margins.
    """
    n = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = [u for u in np.argsort(-weight, kind="stable") if u > 1]
    cls = np.zeros(n, np.int64)
    cls[1] = 1
    free = max(1, classes - 2)
    for k, u in enumerate(order):
        cls[u] = 2 + k % free
    plog = lambda x: x * np.log(np.maximum(x, 1e-300))
    one = np.eye(classes)[cls]
    for _ in range(sweeps):
        pair, moved = one.T @ bigrams @ one, 0
        for u in order:
            if not weight[u]:
                continue
            a, own = cls[u], bigrams[u, u]
            right, left = bigrams[u] @ one, bigrams[:, u] @ one  # counts from u to each class, and into u
            right[a] -= own
            left[a] -= own
            pair[a] -= right
            pair[:, a] -= left
            pair[a, a] -= own
            pair[abs(pair) < 1e-6] = 0
            row, col, diag = pair.sum(1), pair.sum(0), pair.diagonal()
            gain = (plog(pair + right) - plog(pair)).sum(1) + (plog(pair.T + left) - plog(pair.T)).sum(1)
            gain += plog(diag + right + left + own) + plog(diag) - plog(diag + right) - plog(diag + left)
            gain -= plog(row + left + right.sum() + own) - plog(row + left) + plog(col + right + left.sum() + own) - plog(col + right)
            gain[:2] = -np.inf
            c = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else int(a)
            pair[c] += right
            pair[:, c] += left
            pair[c, c] += own
            if c != a:
                cls[u] = c
                one[u] = np.eye(classes)[c]
                moved += 1
        if not moved:
            break
    return cls


def regroup(before: np.ndarray, after: np.ndarray, cls: np.ndarray, free: np.ndarray, classes: int, sweeps: int = 2) -> np.ndarray:
    """Classes after ``free`` units moved, the most frequent first, by the counts of the classes before and after each unit.

    The neighbours' classes stay as counted while units move, so the likelihood is that of the
    units' new classes among their neighbours' old ones.
    """
    cls = cls.copy()
    left, right = np.zeros((classes, classes)), np.zeros((classes, classes))  # counts of (class of a unit, class before or after it)
    np.add.at(left, cls, before)
    np.add.at(right, cls, after)
    plog = lambda x: x * np.log(np.maximum(x, 1e-300))
    own = before.sum(1) + after.sum(1)
    order = free[np.argsort(-own[free], kind="stable")]
    for _ in range(sweeps):
        moved = 0
        for u in order[own[order] > 0].tolist():
            a, x, y = cls[u], before[u], after[u]
            left[a] -= x
            right[a] -= y
            gain = (plog(left + x) - plog(left) + plog(right + y) - plog(right)).sum(1)
            ln, rn = left.sum(1), right.sum(1)
            gain -= plog(ln + x.sum()) - plog(ln) + plog(rn + y.sum()) - plog(rn)
            gain[:2] = -np.inf
            c = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else int(a)
            left[c] += x
            right[c] += y
            cls[u] = c
            moved += c != a
        if not moved:
            break
    return cls


@dataclass
class Model:
    """What a task needs to score texts, but for the counts of words that are not in ``index``."""

    index: dict[bytes, int]  # codes of the known words
    counts: np.ndarray  # of the known words
    cls: np.ndarray  # class by code
    step: np.ndarray  # log10 of the class transition, by class pair
    room: np.ndarray  # log10 of the smoothed size of each class

    def classes(self, words: list[bytes], at: list[int | None]) -> np.ndarray:
        return self.cls[[-1 - cell(w) if k is None else k for w, k in zip(words, at, strict=True)]]

    def path(self, k: np.ndarray) -> float:
        """Log10 of the class transitions less that of the classes' sizes."""
        return float(self.step[np.concatenate([[0], k[:-1]]), k].sum() - self.room[k].sum())


def by_code(known: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """A table by code: known words, the end, the start from 0 on; cell c at -1 - c."""
    return np.concatenate([known, [1, 0], cells[::-1]]).astype(np.int64)


def counted(docs: DataFrame, text: str, train: Column) -> DataFrame:
    """Words (as binary) of the training texts with their counts; the end of a text is left out."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")
    return docs.where(train).select(F.explode(words).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("c"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words reach; larger counts are told apart to a 64th of a doubling."""
    c = F.col("c")
    step = F.when(c < 256, c).otherwise(F.floor(F.log2(c) * 64) - 256).cast("long")
    bins = counts.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()
    least, total = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["low"]):
        total += r["n"]
        if total > most:
            break
        least = r["low"]
    return least


def encoded(docs: DataFrame, id: str, text: str, train: Column, index) -> DataFrame:
    """Each text once: ``codes`` of its tokens (int32), and the words that are not known; ``train`` tells the training texts."""
    kept = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), train.alias("train"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, cells = index.value.get, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes, tails = [], []
                for t in part.column(3).to_pylist():
                    words = tokens(t)
                    own, tail = [get(w) for w in words], []
                    if None in own:
                        if len(cells) > 300_000:
                            cells.clear()
                        for k, c in enumerate(own):
                            if c is None:
                                w = words[k]
                                tail.append(w)
                                c = cells.get(w)
                                if c is None:
                                    c = cells[w] = -1 - cell(w)
                                own[k] = c
                    codes.append(np.array(own, np.int32).tobytes())
                    tails.append(tail)
                tail = pa.array(tails, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(codes, pa.binary()), tail], ["row", "id", "train", "codes", "tail"])

    return materialize(kept.mapInArrow(run, f"row long, id {docs.schema[id].dataType.simpleString()}, train boolean, codes binary, tail array<string>"), "lm-encoded")


def chunks(batches: Iterator[pd.DataFrame], start: int) -> Iterator[np.ndarray]:
    """The codes of some texts at a time, each after a start."""
    first = np.array([start], np.int32)
    for batch in batches:
        raw = batch["codes"].tolist()
        for at in range(0, len(raw), CHUNK):
            yield np.concatenate([x for c in raw[at : at + CHUNK] for x in (first, np.frombuffer(c, np.int32))])


def pair_counts(texts: DataFrame, label, start: int, size: int) -> np.ndarray:
    """The square table of the neighbouring labels in all training texts; at most size * size rows come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(size * size, np.int64)
        for codes in chunks(batches, start):
            u = label.value[codes]
            np.add.at(own, (u[:-1] * size + u[1:])[u[1:] != 0], 1)  # nothing leads to a start
        at = np.flatnonzero(own)
        yield pd.DataFrame({"at": at, "c": own[at]})

    sums = texts.where("train").select("codes").mapInPandas(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size * size)
    out[sums["at"].to_numpy()] = sums["c"].to_numpy()
    return out.reshape(size, size)


def neighbour_counts(texts: DataFrame, unit, label, start: int, size: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit the counts of the classes before and after it in all training texts.

    Tasks send blocks of units as packed counts, and tasks that own a block add them up one by one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = -(-size // BLOCK) * BLOCK
        before, after = (np.zeros(rows * classes, np.int32) for _ in range(2))
        for codes in chunks(batches, start):
            u, c = unit.value[codes], label.value[codes]
            real = u[1:] != 0  # nothing leads to a start
            np.add.at(before, (u[1:] * classes + c[:-1])[real], 1)
            np.add.at(after, (u[:-1] * classes + c[1:])[real], 1)
        both = np.stack([before.reshape(-1, BLOCK * classes), after.reshape(-1, BLOCK * classes)], axis=1)
        for k in np.flatnonzero(both.any(axis=(1, 2))).tolist():
            yield pd.DataFrame({"block": [k], "counts": [both[k].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["block"].tolist(), batch["counts"], strict=True):
                x = np.frombuffer(raw, np.int32).astype(np.int64)
                own[k] = own[k] + x if k in own else x
        yield pd.DataFrame({"block": list(own), "counts": [x.tobytes() for x in own.values()]})

    sums = texts.where("train").select("codes").mapInPandas(run, "block long, counts binary").repartition("block").mapInPandas(add, "block long, counts binary").toArrow()  # one row a block
    both = np.zeros((-(-size // BLOCK), 2, BLOCK * classes))
    for k, raw in zip(sums["block"].to_pylist(), sums["counts"].to_pylist(), strict=True):
        both[k] = np.frombuffer(raw, np.int64).reshape(2, -1)
    before, after = (both[:, k].reshape(-1, classes)[:size] for k in (0, 1))
    return before, after


def fit(docs: DataFrame, id: str, text: str, train: Column, classes: int = 48, frequent: int = 300, clustered: int = 30_000, known_words: int = 200_000) -> tuple[DataFrame, DataFrame, Model, int, int]:
    """The table of training words with counts, the encoded texts, the model, and the numbers of training tokens and of distinct ones."""
    spark = docs.sparkSession
    ship(spark)
    share = spark.sparkContext.broadcast
    counts = materialize(counted(docs, text, train), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = docs.where(train).count()
    n, v = int(total["n"] or 0) + ends, int(total["v"]) + (1 if ends else 0)
    top = counts.where(F.col("c") >= least_count(counts, known_words)).toArrow()  # at most known_words rows
    known = {w.encode(): c for w, c in zip(top["w"].to_pylist(), top["c"].to_pylist(), strict=True)}
    ranked = sorted(known, key=lambda w: (-known[w], w))
    index = {w: k for k, w in enumerate([*ranked, END])}
    codes, start = share(index), len(ranked) + 1
    texts = encoded(docs, id, text, train, codes)

    def units(most: int) -> np.ndarray:
        """Unit by code: the start, the end, the ``most`` most frequent words, the cells."""
        n = min(most, len(ranked))
        return by_code(np.array([2 + k if k < n else 2 + n + cell(w) for k, w in enumerate(ranked)], np.int64), 2 + n + np.arange(CELLS))

    # Frequent words and cells over their bigrams.
    first = units(frequent)
    size = int(first.max()) + 1
    cls = exchange(pair_counts(texts, share(first), start, size), classes)[first]  # by code

    # All clustered words by the classes around them.
    unit = units(clustered)
    size, free = int(unit.max()) + 1, np.arange(2, 2 + min(clustered, len(ranked)))
    own = np.zeros(size, np.int64)
    own[unit] = cls
    before, after = neighbour_counts(texts, share(unit), share(cls), start, size, classes)
    cls = regroup(before, after, own, free, classes)[unit]
    jump = pair_counts(texts, share(cls), start, classes) + 0.5
    jump[:, 0] = 0  # nothing leads to the start
    step = np.log10(np.maximum(jump, 1e-300) / jump.sum(1, keepdims=True))

    # Distinct words of each class, for its room.
    shared = share(cls)

    @F.pandas_udf("int")
    def class_of(ws: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = codes.value.get
        for batch in ws:
            at = [get(w) for w in map(str.encode, batch)]
            yield pd.Series(shared.value[[-1 - cell(w.encode()) if k is None else k for w, k in zip(batch, at, strict=True)]], dtype="int32")

    mass, kinds = np.zeros(classes), np.zeros(classes)
    for r in counts.select(class_of("w").alias("k"), "c").groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row a class
        mass[r["k"]], kinds[r["k"]] = r["n"], r["v"]
    mass[1], kinds[1] = ends, 1 if ends else 0
    tally = np.array([*[known[w] for w in ranked], ends], float)
    return counts, texts, Model(index, tally, cls, step, np.log10(mass + 0.5 * (kinds + 1))), n, v


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1, **size: int) -> DataFrame:
    """One row per document: token counts, the unigram base score, the class model's score and its perplexity; ``size`` goes to ``fit``."""
    spark = docs.sparkSession
    counts, texts, fitted, n, v = fit(docs, id, text, fold_of(F.col(id), folds) != held, **size)
    model = spark.sparkContext.broadcast((fitted.counts, fitted.cls, fitted.step, fitted.room))

    @F.pandas_udf("struct<n_tokens:long,n_known:long,logs:double,path:double>")
    def head(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model({}, *model.value)
        logs = np.log10(m.counts + 0.5)
        for batch in batches:
            rows = []
            for raw in batch:
                codes = np.frombuffer(raw, np.int32)
                own = codes[codes >= 0]
                rows.append((len(codes), int((m.counts[own] > 0).sum()), float(logs[own].sum()), m.path(m.cls[codes])))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_known", "logs", "path"])

    heads = texts.select("row", "id", "tail", head("codes").alias("h")).select("row", "id", "tail", "h.*")
    rare = texts.select("row", F.explode("tail").alias("w"))
    found = rare.join(counts, "w", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    tail = found.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("tail_logs"), F.count(F.when(F.col("c") > 0, 1)).alias("tail_known"))
    logs = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0))
    return heads.drop("tail").join(tail, "row", "left").select(
        F.col("id").alias(id),
        (fold_of(F.col("id"), folds) == held).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (logs + F.col("path")).alias("score"),
        F.pow(F.lit(10.0), -(logs + F.col("path")) / F.col("n_tokens")).alias("perplexity"),
    )
