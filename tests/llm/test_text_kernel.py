"""The kernel of whole texts against all subsequences one by one, and the machine on phrases of harmless words."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from starfold.llm import text_kernel, toxicity


def subsequences(text: bytes) -> Counter:
    """Four letters in order with at most one skipped in all, and how often, a skipped one at 0.6."""
    out: Counter = Counter()
    for i in range(len(text)):
        for rest in combinations(range(i + 1, min(i + 5, len(text))), 3):
            skipped = rest[-1] - i - 3
            out[bytes(text[k] for k in (i, *rest))] += 1.0 if not skipped else text_kernel.DECAY
    return out


def slot(letters: bytes) -> int:
    a, b, c, d, last = text_kernel.MIX
    key = 0
    for x, m in zip(letters, (a, b, c, d), strict=True):
        key ^= x * m & 0xFFFFFFFF
    key ^= key >> 15
    return (key * last & 0xFFFFFFFF) >> (32 - text_kernel.BITS)


def sentences(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    words = ["".join(r.choice("abdeiklmnorst") for _ in range(r.randint(2, 8))) for _ in range(80)]
    return [" ".join(r.choice(words) for _ in range(30)) for _ in range(n)]


def phrased(n: int, seed: int) -> tuple[list[str], list[int]]:
    """Texts that all hold the words "tamed", "olive" and "crows" apart; toxic ones hold them as a phrase."""
    texts, labels = [], []
    for k, t in enumerate(sentences(n, seed)):
        w = t.split()
        texts.append(" ".join([*w[:10], "tamed olive crows", *w[10:], "then"] if k % 2 else [*w[:5], "olive", *w[5:15], "crows", *w[15:22], "tamed", *w[22:]]))
        labels.append(k % 2)
    return texts, labels


def test_margins_match_subsequences_one_by_one():
    texts, labels = phrased(60, 1)
    model, _ = text_kernel.trained([toxicity.prepared(t) for t in texts], labels, features=700, landmarks=40)
    for text in (*texts[:6], "", "a", "abc", "unseen zzzz zzzz", texts[3] * 40):
        ready = toxicity.prepared(text)
        count = Counter()
        for letters, n in subsequences(ready).items():
            count[int(model.row[slot(letters)])] += n
        count.pop(len(model.rare), None)
        x = {k: model.rare[k] * n**0.5 for k, n in count.items()}
        norm = max(sum(v * v for v in x.values()) ** 0.5, 1e-12)
        assert model.margin(ready) == pytest.approx(sum(v * model.fold[k] for k, v in x.items()) / norm + model.bias, abs=1e-9)


def test_pieces_of_a_long_text_add_up(monkeypatch):
    texts, labels = phrased(40, 2)
    model, _ = text_kernel.trained([toxicity.prepared(t) for t in texts], labels, features=500, landmarks=20)
    long = toxicity.prepared(" ".join(texts))
    whole = model.features(long)
    for piece in (5, 64, 1000, len(long) - 1):
        monkeypatch.setattr(text_kernel, "PIECE", piece)
        assert np.array_equal(model.features(long), whole)


def test_a_phrase_of_harmless_words_is_toxic():
    texts, labels = phrased(500, 3)
    model = toxicity.train(texts[:300], labels[:300])
    got = [model.score(t) >= 0.5 for t in texts[300:]]
    assert np.mean([a == bool(b) for a, b in zip(got, labels[300:], strict=True)]) > 0.95
    for word in ("tamed", "olive", "crows"):
        assert np.mean([model.score(f"{t} {word}") >= 0.5 for t in sentences(60, 4)]) < 0.05
    altered = [t.replace("tamed olive crows", "tamxed olive croews") for t in texts[301::2]]
    assert np.mean([model.score(t) >= 0.5 for t in altered]) > 0.7


def test_held_margins_are_those_of_unseen_texts():
    ready = [toxicity.prepared(t) for t in sentences(120, 5)]
    labels = [random.Random(k).randrange(2) for k in range(120)]  # nothing to learn
    model, margins = text_kernel.trained(ready, labels, features=1000, landmarks=60)
    own = np.array([model.margin(t) > 0 for t in ready])
    assert np.mean(own == np.array(labels)) > 0.9 and 0.25 < np.mean((margins > 0) == np.array(labels)) < 0.75
    few, margins = text_kernel.trained(ready[:6], [0, 1, 0, 1, 0, 1])
    assert margins.tolist() == [few.margin(t) for t in ready[:6]]


def test_same_rows_give_the_same_machine():
    texts, labels = phrased(50, 6)
    ready = [toxicity.prepared(t) for t in texts]
    a, b = (text_kernel.trained(ready * 2, labels * 2, 400, 30)[0] for _ in range(2))
    assert np.array_equal(a.fold, b.fold) and a.bias == b.bias
