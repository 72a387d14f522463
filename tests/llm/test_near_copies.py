"""The near-copy stage against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from starfold.llm import near_copies


def shingles(text: str) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def firsts(rows: list[tuple[int, str]]) -> set[int]:
    """Smallest id of each class of pairs of similarity 0.8 or more."""
    own, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(own[a] & own[b])
            if 5 * common >= 4 * len(own[a] | own[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {rows[k][0] for k in range(len(rows)) if top(k) == k}


@pytest.mark.parametrize("limit", [1024, 6])
def test_stage_matches_brute_force_jaccard(spark, monkeypatch, limit):
    monkeypatch.setattr(near_copies, "BUCKET_LIMIT", limit)
    monkeypatch.setattr(near_copies, "GROUP_LIMIT", limit)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts, common = [], " ".join(word() for _ in range(30))
    for _ in range(25):
        base = [word() for _ in range(r.choice([6, 40, 120, 300]))]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 7, 12, 20):
            copy = list(base)
            for _ in range(max(1, edits * len(base) // 300)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if edits == 2 else " ".join(copy))
        texts.append(" ".join(base) + " " + common)
    rows = list(enumerate([*texts, "", "one", "One ", common]))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    assert kept == firsts(rows)
