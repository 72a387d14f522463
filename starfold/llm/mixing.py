"""Mixing sources to target weights: exact block quotas, dealt to output shards by a multivariate-hypergeometric splitting tree.

A source's documents stand in an order fixed by a digest and are cut into blocks of nearly equal words. Its target is met by a
whole number of blocks, counted through as many epochs as it takes. The tree starts with all quotas in one node; each
node gives its left shards as many blocks of every source as a random deal of all its blocks would, by one hypergeometric draw
after the other, and the rest goes right. A keyed permutation of each source's blocks makes the draws disjoint, and a
digest orders the documents within a shard. Draws depend on the seed, the node and the source alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize
from .places import placed

C = F.col
WORD = r"[^\x20\x09-\x0D]+"
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)  # the largest below 2^31


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources by code point, null last; ``share`` of all words is taken, of a source at most ``most`` times its words."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_words: int = 16_384
    least_blocks: int = 64  # of a source that has a target, so that small ones are spread too
    shard_words: int = 4_194_304
    seed: int = 1


def targets(sources: DataFrame, m: Mix) -> DataFrame:
    """``source, source_size`` with ``sid`` (its place), ``weight`` and ``target``: the level times the weight, at most ``most`` times the size.

    The level at which targets sum to the share is the root of a concave, piecewise linear function; each of Newton's
    steps, an aggregate over the sources, caps at least one source more or is the last.
    """
    at = placed(sources.withColumn("all", F.lit(0)), "all", [C("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, m.weights)), (C("at") % len(m.weights) + 1).cast("int"))
    s = at.select("source", "source_size", C("at").alias("sid"), weight.cast("long").alias("weight"), (m.most * C("source_size")).alias("cap"))
    whole, level, capped = m.share * (s.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        above = C("cap") < level * C("weight")
        row = s.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, C("cap"))), F.lit(0)).alias("caps"), F.sum(F.when(~above, C("weight"))).alias("weights")).first()
        if row["n"] == capped or not row["weights"]:
            break
        capped, level = row["n"], (whole - row["caps"]) / row["weights"]
    return s.withColumn("target", F.least(C("cap").cast("double"), level * C("weight")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a 64-bit hash of ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(2**53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many marked of ``total`` are among ``drawn`` without replacement, from a uniform number.

    Inversion over the support in the order mode, upwards, downwards: a term follows from its neighbour by a ratio of integers. Terms more
    than 12 deviations and 40 away from the mode are below the resolution of a double and left out.
    """
    given = F.struct(*[c.cast("double").alias(a) for c, a in ((total, "n"), (marked, "q"), (drawn, "k"))], u.alias("u"))

    def centre(v: Column) -> Column:
        n, q, k = v["n"], v["q"], v["k"]
        least, most = F.greatest(F.lit(0.0), k + q - n), F.least(q, k)
        mode = F.greatest(least, F.least(most, F.floor((q + 1) * (k + 1) / (n + 2)).cast("double")))
        wide = 40 + F.ceil(12 * F.sqrt(k * (q / n) * (1 - q / n) * (n - k) / (n - 1)))
        return F.struct(n.alias("n"), q.alias("q"), k.alias("k"), v["u"].alias("u"), mode.alias("mode"), F.least(most - mode, wide).cast("int").alias("up"), F.least(mode - least, wide).cast("int").alias("down"))

    def draw(v: Column) -> Column:
        n, q, k, mode = v["n"], v["q"], v["k"], v["mode"]

        def next_term(x: Column, before: Column, sign: int) -> Column:
            return before * ((q - x + 1) * (k - x + 1) / (x * (n - q - k + x)) if sign > 0 else (x + 1) * (n - q - k + x + 1) / ((q - x) * (k - x)))

        def run(steps: Column, sign: int, goal: Column) -> Column:
            """``sum`` of the terms, and ``hit``, how many of them leave the sum below ``goal``."""
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).alias("hit"))
            add = lambda a, w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), (a["hit"] + (a["sum"] + w < goal).cast("int")).alias("hit"))
            step = lambda a, i: let(next_term(mode + sign * i, a["w"], sign), lambda w: add(a, w))
            return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, step)

        def place(z: Column) -> Column:
            goal = v["u"] * (1 + z["above"] + z["below"])
            up, down = run(v["up"], 1, goal - 1)["hit"] + 1, run(v["down"], -1, goal - 1 - z["above"])["hit"] + 1
            return F.when(goal <= 1, mode).when(goal <= 1 + z["above"], mode + F.least(v["up"], up)).otherwise(mode - F.least(v["down"], down))

        never = F.lit(-1.0)
        return let(F.struct(run(v["up"], 1, never)["sum"].alias("above"), run(v["down"], -1, never)["sum"].alias("below")), place)

    sure = F.when((marked <= 0) | (drawn <= 0), F.lit(0)).when(drawn >= total, marked).when(marked >= total, drawn)
    return F.coalesce(sure, let(given, lambda v: let(centre(v), draw))).cast("long")


def deal(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``sid, shard, first, n`` of ``quotas`` (``sid, blocks``): places ``first`` to ``first + n - 1`` of the source's permuted blocks go to the shard.

    A node of the tree is a row: its shards, and each source's remaining blocks and where they start. A level is a projection; nodes
    are dealt out to tasks once there are many. A node holds three numbers for each source that it has blocks of.
    """
    node = quotas.where("blocks > 0").agg(F.sort_array(F.collect_list(F.struct("sid", F.lit(0).cast("long").alias("first"), C("blocks").alias("n")))).alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    nodes = node.where(F.size("parts") > 0).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.lit(0).cast("long").alias("seen"), total.alias("total"), "parts")
    whole = nodes.first()
    if whole is None:
        return quotas.sparkSession.createDataFrame([], "sid long, shard long, first long, n long")
    whole, level = whole["total"], 0
    while 2**level < shards:
        mid = F.expr("(lo + hi + 1) div 2")
        nodes = nodes.withColumn("mid", F.when(C("hi") - C("lo") > 1, mid).otherwise(C("hi")))
        # blocks of the left shards: those below its share of all blocks, so that shards differ by one block at most
        nodes = nodes.withColumn("left", F.expr(f"mid * {whole} div {shards}") - C("seen"))
        start = F.struct(C("total").alias("total"), C("left").alias("left"), F.array().cast("array<bigint>").alias("got"))

        def draw(a: Column, p: Column) -> Column:
            got = hypergeometric(a["total"], p["n"], a["left"], uniform(F.lit(seed), C("lo"), C("hi"), p["sid"]))
            return let(got, lambda g: F.struct((a["total"] - p["n"]).alias("total"), (a["left"] - g).alias("left"), F.concat(a["got"], F.array(g)).alias("got")))

        nodes = nodes.withColumn("got", F.when(C("mid") == C("hi"), F.transform("parts", lambda p: p["n"])).otherwise(F.aggregate("parts", start, draw)["got"]))
        give = lambda p, g: F.struct(p["sid"].alias("sid"), p["first"].alias("first"), g.alias("n"))
        keep = lambda p, g: F.struct(p["sid"].alias("sid"), (p["first"] + g).alias("first"), (p["n"] - g).alias("n"))
        some = lambda parts: F.filter(parts, lambda p: p["n"] > 0)
        left = F.struct("lo", C("mid").alias("hi"), "seen", C("left").alias("total"), some(F.zip_with("parts", "got", give)).alias("parts"))
        right = F.struct(C("mid").alias("lo"), "hi", (C("seen") + C("left")).alias("seen"), (C("total") - C("left")).alias("total"), some(F.zip_with("parts", "got", keep)).alias("parts"))
        nodes = materialize(nodes.select(F.inline(F.array(left, right))).where("lo < hi AND total > 0"), "tree")
        level += 1
        if level % 4 == 0:
            nodes = nodes.repartition("lo")
    return nodes.select(C("lo").alias("shard"), F.inline("parts"))


def mix(docs: DataFrame, m: Mix = Mix(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each copy of a document in the mix: ``keep``, ``size, source_size, target``, ``shard``, ``place`` in the shard, ``copy`` and ``row``; documents that are not taken have one row with nulls there.

    ``size`` is the text's number of words, 0 for a null or empty text. Sources are ordered by code point, null, a source of its
    own, last. A copy is taken if the middle of the document, in its source's order and epoch, lies below the target; so a source's
    words differ from its target by at most half a document. The order follows the MD5 of id and text, so that only equal
    rows tie; each repeated row is a document of its own. Sources without words have target 0. An empty table gives no rows.
    Names in ``keep`` that the result has itself are an error; other columns take no part.
    """
    own = {"size", "source_size", "target", "shard", "place", "copy", "row", "source"}
    if clash := own & {k.lower() for k in keep}:
        raise ValueError(f"columns of the mix itself: {sorted(clash)}")
    order = F.md5(F.concat_ws("/", F.coalesce(C("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(*keep, "source", size.alias("size"), order.alias("order"), F.monotonically_increasing_id().alias("row")), "sized")
    sources = materialize(targets(materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), m), "targets")
    blocks = F.when(C("target") > 0, F.greatest(F.lit(m.least_blocks), F.ceil(C("target") / m.block_words))).otherwise(0).cast("long")
    sources = sources.withColumn("blocks", blocks)
    words = sources.agg(F.sum("target")).first()[0] or 0.0
    dealt = deal(sources.select("sid", "blocks"), max(1, round(words / m.shard_words)), m.seed)
    where = dealt.select("sid", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("at_block"))

    lines = placed(sized, "source", [C("order"), C("row")], "size").drop("at", "group_n", "group_sum")
    of = sources.select(C("source").alias("_source"), "sid", "source_size", "target", "blocks")
    lines = lines.join(of, lines["source"].eqNullSafe(of["_source"])).drop("_source")
    middle = C("before") + C("size") / 2
    copies = F.filter(F.array(*[F.when(epoch * C("source_size") + middle < C("target"), F.struct(F.lit(epoch).alias("copy"), (epoch * C("source_size") + middle).alias("middle"))) for epoch in range(m.most)]), lambda c: c.isNotNull())
    copied = lines.select(*keep, "source", "size", "source_size", "target", "row", "sid", "blocks", "order", F.inline_outer(copies))
    block = F.least(F.floor(C("middle") / C("target") * C("blocks")), C("blocks") - 1)
    # a prime above the number of blocks divides none, so multiplying by it permutes the blocks
    prime = F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), (F.pmod(F.xxhash64(F.lit(m.seed), "sid"), F.lit(len(PRIMES))) + 1).cast("int"))
    turned = (prime % C("blocks") * block + F.pmod(F.xxhash64("sid", F.lit(m.seed)), C("blocks"))) % C("blocks")
    none = -1 - C("row")  # a key of its own for each document that is not taken, which meets nothing
    met = copied.withColumn("at_block", F.when(C("middle").isNotNull(), turned).otherwise(none)).join(where, ["sid", "at_block"], "left")
    local = Window.partitionBy(F.coalesce("shard", none)).orderBy(F.xxhash64(F.lit(m.seed), "order", "copy"), "order", "copy", "row")
    return met.withColumn("place", F.when(C("shard").isNotNull(), F.row_number().over(local))).select(*keep, "source", "size", "source_size", "target", "row", "copy", "shard", "place")


def taken(copies: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each document: the words that its copies in the shards hold."""
    held = copies.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.count("shard").alias("times"))
    return held.select("doc_id", "size", "source_size", "target", (C("times") * C("size")).alias("taken"))
