"""The filters of the license join: what they prune, and that they lose nothing."""

import numpy as np
from pyspark.sql import functions as F

from starfold.llm import license_scan


def test_filters_prune_pairs_and_lose_none(spark):
    rng = np.random.default_rng(8)
    notices = {f"n{k}": sorted(rng.choice(60, size=int(rng.integers(5, 14)), replace=False).tolist()) for k in range(12)}
    need = {n: -(-4 * len(ws) // 5) for n, ws in notices.items()}
    least = min(need.values())
    sets = [sorted(set(rng.choice(60, size=int(rng.integers(3, 40))).tolist())) for _ in range(400)]
    for k in range(0, 400, 4):  # some that hold most of a notice
        sets[k] = sorted(set(sets[k][:4]) | set(notices[f"n{k // 4 % 12}"][:-1]))
    index = spark.createDataFrame([(ws[i], i, n, n, ws, need[n], 20) for n, ws in notices.items() for i in range(len(ws) - need[n] + 1)], "rank int, i int, notice string, label string, ranks array<int>, need int, length int")
    blocks = spark.createDataFrame([(r, 0, [], s, len(s)) for r, s in enumerate(sets) if len(s) >= least], "_row long, block long, _spots array<struct<i:int,rank:int>>, _set array<int>, m int")
    pairs = lambda **how: {(r["_row"], r["notice"]) for r in license_scan.candidates(blocks, index, least, **how).collect()}
    true = {(r, n) for r, s in enumerate(sets) for n, ws in notices.items() if len(set(s) & set(ws)) >= need[n]}
    plain, positional = pairs(positional=False), pairs()
    every = blocks.count() * len(notices)
    assert true <= positional < plain and len(plain) < every
    assert len(positional) < 0.97 * len(plain), (len(true), len(positional), len(plain), every)


def test_a_wrapped_notice_far_into_a_long_text(spark):
    notice = license_scan.NOTICES["isc"][1].split()
    lines = "\n * ".join(" ".join(notice[i : i + 9]) for i in range(0, len(notice), 9))
    texts = [("filler words of no account " * 3_000) + lines + " tail" * 500, lines.replace("fee", "charge").replace("damages", "harm"), "permission to use copy modify"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1, texts[1])], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("rank", "block", "_row", "i")})
    got = license_scan.license_scan(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 4 and "isc" in by[0]["labels"] and "isc" in by[1]["labels"] and by[2]["labels"] == ""
    assert by[0]["score"] == 1.0 and 0.8 <= by[1]["score"] < 1.0


def test_equal_notices_of_two_labels_both_count(spark):
    df = spark.createDataFrame([(None, "alpha beta gamma delta epsilon"), (2, None), (3, "")], "doc_id long, text string")
    got = license_scan.license_scan(df, notices={"a": ["alpha beta gamma delta epsilon"], "b": ["alpha beta gamma delta epsilon"]}).collect()
    assert sorted((r["labels"], r["score"]) for r in got) == [("", 0.0), ("", 0.0), ("a,b", 1.0)]
