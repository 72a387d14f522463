"""License scan: exact set-similarity join of stretches of text with license notices.

Words are lower-cased runs of letters, digits and non-ASCII characters. A stretch starts at a
word of a notice and is ``stretch`` times as long as the notice, whatever lines or marks stand
in between. It fits the notice if it holds at least ``threshold`` of the notice's distinct words. At a
place where several notices fit, those of the highest containment (then of the largest
overlap) count.

The join finds every such pair. A text is cut into blocks of twice the longest stretch, one stretch apart, so that every stretch
lies in the block where it starts. Tokens are ordered by the number of documents that hold them, rarest first, on both sides. To
share o tokens, a notice of n and a block of m distinct tokens must have a common one among the notice's n - o + 1 first and the block's
m - l + 1 first, l being the least o of all notices (prefix filter); m must reach o (length filter); and with k common tokens among
those, the last at places i and j (from 0), all others come after both, so that k + min(n - i - 1, m - j - 1) must reach o
(positional filter). Only for pairs that remain are the distinct words of each
stretch counted.

Everything runs as DataFrame operations. The notices and phrases are parameters of fixed
size, so the index built from them may be broadcast.

Defined results: a null or empty text has no words, no places and the score 0. Equal best
notices all count. Repeated rows are scanned row by row. Empty tables give empty results.
Only the id and the text column are read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license, and public license notices: opening words, and two whole ones.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
NOTICES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "apache-2": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "gpl-3": ["licensed under the gnu general public license version 3"],
    "gpl-2": ["licensed under the gnu general public license version 2"],
    "lgpl-3": ["licensed under the gnu lesser general public license version 3"],
    "agpl-3": ["licensed under the gnu affero general public license version 3"],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "cc-by": ["licensed under cc by 4 0"],
}


def words_of(text: Column) -> Column:
    """The words joined by single spaces."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(low, GAP, " "))


def count_words(joined: Column) -> Column:
    return F.when(joined == "", F.lit(0)).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "))) + 1).cast("long")


def places(joined: Column, phrase: str) -> list[Column]:
    """Number of places of ``phrase`` in space-joined words, and the smallest and largest start."""
    around = F.concat(F.lit(" "), joined, F.lit(" "))
    parts = F.split(around, f"(?<= ){phrase}(?= )")
    n = F.size(parts) - 1
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" ")))
    first = spaces(F.element_at(parts, 1)) - 1
    last = count_words(joined) - len(phrase.split()) - (spaces(F.element_at(parts, -1)) - 1)
    here = joined.contains(phrase)
    return [F.when(here, n).otherwise(0).cast("long"), F.when(here & (n > 0), first.cast("long")), F.when(here & (n > 0), last.cast("long"))]


def candidates(blocks: DataFrame, index: DataFrame, least: int, positional: bool = True) -> DataFrame:
    """Pairs of blocks (``_row, block, _spots, _set, m``) and notices that pass the prefix, length and positional filters.

    ``index`` has a row for each token of each notice's prefix and is of the notices' fixed size. Without ``positional``
    that filter is left out, for tests of what it prunes.
    """
    prefix = blocks.select("_row", "block", "_spots", "m", F.posexplode(F.slice("_set", F.lit(1), F.col("m") - least + 1)).alias("j", "rank"))
    met = prefix.join(F.broadcast(index), "rank").where(F.col("m") >= F.col("need"))
    pairs = met.groupBy("_row", "block", "notice").agg(*[F.first(c).alias(c) for c in ("label", "ranks", "need", "length", "_spots", "m")], F.count("*").alias("k"), F.max("i").alias("i"), F.max("j").alias("j"))
    rest = F.col("k") + F.least(F.size("ranks") - F.col("i") - 1, F.col("m") - F.col("j") - 1)
    return pairs.where(rest >= F.col("need")) if positional else pairs


def license_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, stretch: float = 1.5, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """One row per document: places of the phrases, labels of phrases and fitting notices, best containment."""
    flat = [(f"{label}/{k}", label, t.split()) for label, ts in sorted(notices.items()) for k, t in enumerate(ts)]
    sized = [(n, label, sorted(set(ws)), math.ceil(threshold * len(set(ws)) - 1e-9), math.ceil(stretch * len(ws))) for n, label, ws in flat]
    tokens = sorted({w for _, _, ws, _, _ in sized for w in ws})
    words = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")

    least = min((need for *_, need, _ in sized), default=1)
    reach = max((length for *_, length in sized), default=1)

    # One pass over the texts. Places of tokens stay where the length filter leaves a notice at all.
    found = {label: places(F.col("_joined"), p) for label, p in phrases.items()}
    kinds = [F.struct(F.lit(label).alias("label"), n.alias("n"), a.alias("a"), z.alias("z")) for label, (n, a, z) in found.items()]
    seen = docs.select(F.col(id).alias("_id"), words_of(F.col(text)).alias("_joined"))
    at = F.filter(F.transform(F.split("_joined", " "), lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(tokens))
    own = F.array_intersect(F.split("_joined", " "), words(tokens))
    facts = seen.select(F.monotonically_increasing_id().alias("_row"), "_id", count_words(F.col("_joined")).alias("n_words"), F.array(*kinds).alias("_kinds"), own.alias("_own"), F.when(F.size(own) >= least, at).alias("_at"))
    facts = materialize(facts, "license-facts")

    # The global order, rarest first, and the index: each notice under the tokens of its prefix.
    freq = {r["w"]: r["count"] for r in facts.select(F.explode("_own").alias("w")).groupBy("w").count().collect()}  # at most one row per word of the notices
    order = {w: k for k, w in enumerate(sorted(tokens, key=lambda w: (freq.get(w, 0), w)))}
    spark = docs.sparkSession
    ranked = [(n, label, sorted(order[w] for w in ws), need, length) for n, label, ws, need, length in sized]
    index = spark.createDataFrame([(rs[i], i, n, label, rs, need, length) for n, label, rs, need, length in ranked for i in range(len(rs) - need + 1)], "rank int, i int, notice string, label string, ranks array<int>, need int, length int")
    ranks = spark.createDataFrame(list(order.items()), "w string, rank int")

    # Blocks with their tokens' places, and the distinct tokens in the global order.
    spot = facts.where(F.col("_at").isNotNull()).select("_row", F.inline("_at")).join(F.broadcast(ranks), "w")
    here = F.expr(f"i div {reach}")
    spread = spot.select("_row", "i", "rank", F.explode(F.array(here, here - 1)).alias("block")).where("block >= 0")
    blocks = spread.groupBy("_row", "block").agg(F.collect_list(F.struct("i", "rank")).alias("_spots"))
    blocks = blocks.withColumn("_set", F.array_sort(F.array_distinct(F.transform("_spots", lambda x: x["rank"])))).withColumn("m", F.size("_set")).where(F.col("m") >= least)
    pairs = candidates(blocks, index, least)

    # Each place of a notice's word with the distinct words of the stretch from there on; places count in lengths of the stretch, times 2^20.
    unit = 1 << 20
    each = pairs.select("_row", "block", "notice", "label", "need", "length", F.size("ranks").alias("size"), F.explode(F.filter("_spots", lambda x: F.array_contains("ranks", x["rank"]))).alias("x"))
    each = each.select("_row", "block", "notice", "label", "need", "size", F.col("x.i").alias("i"), F.col("x.rank").alias("w"), F.expr(f"x.i * {unit}L div length").alias("u"))
    near = Window.partitionBy("_row", "block", "notice").orderBy("u").rangeBetween(0, unit - unit // (2 * max([m for *_, m in sized], default=1)))
    fits = each.withColumn("overlap", F.size(F.collect_set("w").over(near))).where((F.col("overlap") >= F.col("need")) & (here == F.col("block")))
    fits = fits.select("_row", "i", "label", F.struct((F.col("overlap") / F.col("size")).alias("share"), "overlap").alias("rank"))
    best = fits.groupBy("_row", "i").agg(F.max("rank").alias("top"), F.collect_list(F.struct("rank", "label")).alias("all"))
    best = best.select("_row", F.col("top.share").alias("share"), F.transform(F.filter("all", lambda x: x["rank"] == F.col("top")), lambda x: x["label"]).alias("found"))
    method = best.groupBy("_row").agg(F.max("share").alias("_share"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("_found"), F.count("*").alias("n_places"))

    base = F.transform(F.filter("_kinds", lambda k: k["n"] > 0), lambda k: k["label"])
    joined_list = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    n_base = F.aggregate("_kinds", F.lit(0).cast("long"), lambda s, k: s + k["n"])
    return facts.drop("_own", "_at").join(method, "_row", "left").select(
        F.col("_id").alias(id),
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform("_kinds", lambda k: k["a"])).alias("first_word"),
        F.array_max(F.transform("_kinds", lambda k: k["z"])).alias("last_word"),
        joined_list(base).alias("base_labels"),
        joined_list(F.concat(base, F.coalesce("_found", F.array().cast("array<string>")))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
        F.coalesce("n_places", F.lit(0)).cast("long").alias("n_places"),
    )
