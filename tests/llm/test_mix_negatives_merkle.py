"""Mixing, hard negatives and the Merkle manifest against brute force, with nulls, repeats, ties and clashing names."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.llm import merkle, mixing, negatives

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def awkward(spark, n=160):
    """A source with half of all rows, nulls in every column, empty and long texts, repeated rows, columns of clashing names."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(n):
        source = "hot" if k % 2 else [None, "a", "B", "é"][k // 2 % 4]
        text = [None, "", "x\ny " * int(rng.integers(1, 30)), "ein wort " * 3][k % 4] if k != 40 else "lang " * 30_000
        rows.append((None if k % 23 == 5 else k, source, None if k % 7 else "de", None if k % 5 == 0 else k, text))
    rows += rows[:6]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    return rows, df.withColumns({c: F.lit(1) for c in ("at", "digest", "row", "size", "block", "_row", "label")})


# -- mixing ----------------------------------------------------------------------------------------------------------------


def fill(sizes: dict, m: mixing.Mix) -> dict:
    """Targets by handing the excess on until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: m.weights[k % len(m.weights)] for k, s in enumerate(names)}
    whole, capped = m.share * sum(sizes.values()), set()
    while True:
        rest = whole - sum(m.most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if level * weight[s] > m.most * sizes[s]}
        if not over:
            return {s: float(m.most * sizes[s]) if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mix_meets_targets_and_shards(spark):
    rows, docs = awkward(spark)
    m = mixing.Mix(block_words=300, least_blocks=4, shard_words=4_000)
    got = mixing.mix(docs, m).toPandas()
    count = lambda t: len((t or "").split())
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[1]] += count(r[4])
    want = fill(sizes, m)
    taken = got[got["shard"].notna()]
    longest = {s: max(count(r[4]) for r in rows if r[1] == s) for s in sizes}
    for s, target in want.items():
        mine = got[got["source"].isna() if s is None else got["source"] == s]
        assert np.allclose(mine["target"], target) and (mine["source_size"] == sizes[s]).all()
        assert abs(mine[mine["shard"].notna()]["size"].sum() - target) <= longest[s] / 2 + 1e-6
    assert got["row"].nunique() == len(rows)
    assert taken.groupby("row").size().max() <= 2 and not taken.duplicated(["row", "copy"]).any()
    for _, shard in taken.groupby("shard"):  # a local shuffle numbers the copies of a shard
        assert sorted(shard["place"]) == list(range(1, len(shard) + 1))
    assert taken["shard"].nunique() > 3
    again = mixing.mix(docs.repartition(3), m).select("doc_id", "size", "copy", "shard").toPandas()
    key = lambda d: sorted(map(str, d[["doc_id", "size", "copy", "shard"]].values.tolist()))
    assert key(again) == key(got)


def test_mix_of_nothing(spark):
    _, docs = awkward(spark)
    assert mixing.taken(mixing.mix(docs.limit(0))).count() == 0
    none = mixing.taken(mixing.mix(docs.withColumn("text", F.lit(None).cast("string")))).toPandas()
    assert (none["taken"] == 0).all() and (none["target"] == 0).all()
    with pytest.raises(ValueError):
        mixing.mix(docs, keep=("doc_id", "Size"))


def test_hypergeometric_draws_follow_the_law(spark):
    n, q, k, draws = 30, 12, 9, 20_000
    df = spark.range(draws).select(mixing.hypergeometric(F.lit(n), F.lit(q), F.lit(k), mixing.uniform(F.lit(7), F.col("id"))).alias("x"))
    got = Counter(r["x"] for r in df.collect())
    chi = 0.0
    for x in range(max(0, k + q - n), min(q, k) + 1):
        p = math.comb(q, x) * math.comb(n - q, k - x) / math.comb(n, k)
        chi += (got[x] - draws * p) ** 2 / (draws * p) if draws * p > 5 else 0
    assert chi < 30 and set(got) <= set(range(0, 10))  # 9 degrees of freedom
    edge = spark.createDataFrame([(5, 0, 3), (5, 5, 3), (5, 2, 5), (5, 2, 0), (1, 1, 1), (10**9, 5 * 10**8, 10**6)], "n long, q long, k long")
    x = [r["x"] for r in edge.select(mixing.hypergeometric(F.col("n"), F.col("q"), F.col("k"), F.lit(0.5)).alias("x")).collect()]
    assert x[:5] == [0, 3, 2, 0, 1] and abs(x[5] - 5 * 10**5) < 6_000  # twelve deviations


def test_the_tree_deals_every_block_once(spark):
    quotas = {0: 37, 1: 5, 2: 0, 3: 120, 4: 1}
    dealt = mixing.deal(spark.createDataFrame(list(quotas.items()), "sid long, blocks long"), 11, 3).toPandas()
    for sid, n in quotas.items():
        mine = dealt[dealt["sid"] == sid]
        assert sorted(itertools.chain.from_iterable(range(f, f + k) for f, k in zip(mine["first"], mine["n"]))) == list(range(n))
    sizes = dealt.groupby("shard")["n"].sum()
    assert len(sizes) == 11 and sizes.max() - sizes.min() <= 1


def test_multipliers_are_prime():
    assert all(p % d for p in mixing.PRIMES for d in range(2, math.isqrt(p) + 1))


# -- hard negatives --------------------------------------------------------------------------------------------------------


def brute_negatives(rows, every=50, positives=5, wanted=3):
    good = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, al, av in good:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(av, v)), i, label) for i, label, v in good if i != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == al)[:positives]:
            near = sorted(s for s in scored if s[2] != al and 50 * -p <= 100 * -s[0] <= 95 * -p)[:wanted]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(near)]
    return sorted(out)


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in np.round(rng.normal(0.3, 0.4, 6), 1)]) for i in range(260)]
    rows += [(i, 1, [0.5] * 6) for i in range(260, 300)]  # ties
    rows += [rows[5], rows[262], rows[50]]  # repeated rows, one an anchor
    rows += [(None, 1, [0.1] * 6), (350, None, [0.1] * 6), (400, 1, None), (450, 1, [0.1, None, 0.2]), (500, 1, [math.nan] * 6), (550, 1, [math.inf] * 6), (600, 1, []), (650, 2, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5).withColumns({"no": F.lit(1), "score": F.lit(2), "rank": F.lit(3)})
    rows = [(i, lb, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lb, v in rows]
    want = brute_negatives(rows)
    assert len(want) > 40
    for most in (2, 10_000):
        got = sorted(tuple(r) for r in negatives.hard_negatives(df, most=most).collect())
        assert got == want
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.where("vec_id % 50 <> 0")).count() == 0


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**20, 2.0]])
    got = negatives.product(a, b)
    assert got.dtype == np.int64 and got.tolist() == [[2**60 + 1, 2**60 + 2]]
    with pytest.raises(OverflowError):
        negatives.product(np.array([[2.0**60]]), np.array([[2.0**60]]))


# -- manifest --------------------------------------------------------------------------------------------------------------


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, source, lang, n_chars, text = row
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def fold(nodes):
    """Root and each node's siblings by level, one level after the other."""
    place, proof = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p // 3 * 3 : p // 3 * 3 + 3]
            proof[k].append((p % 3, run[: p % 3], run[p % 3 + 1 :]))
            place[k] = p // 3
        nodes = [h(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proof


def brute_manifest(rows):
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: fold([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, high = fold([low[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, _, leaf, r), proof in zip(sorted(trees[s], key=lambda x: x[:3]), low[s][1]):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at = leaf_of((*r[:4], text))
            for _, before, after in proof + high[k]:
                at = h([*before, at, *after])
            out.append((r[0], leaf, low[s][0], root, h(x for _, b, a in proof + high[k] for x in b + a), at, at == root))
    return out


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_brute_force(spark, height):
    rows, docs = awkward(spark, 160 if height == 2 else 70)
    got = sorted(map(str, (tuple(r) for r in merkle.manifest(docs, height).collect())))
    want = sorted(map(str, brute_manifest(rows)))
    assert got == want and 0 < sum("False" in g for g in got) < len(got)


def test_small_manifests(spark):
    one = [(3, None, None, None, None)]
    got = merkle.manifest(spark.createDataFrame(one, DOCS)).first()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] == leaf_of(one[0]) and got["proof_sha256"] == merkle.NONE and got["verified"]
    big = [(2**60 + k, "s", "l", k, "t\n") for k in range(5)] + [(None, "s", "l", 0, "t")]  # ids beyond doubles beside a null
    got = sorted(map(str, (tuple(r) for r in merkle.manifest(spark.createDataFrame(big, DOCS)).collect())))
    assert got == sorted(map(str, brute_manifest(big)))
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
