"""URL filter: fixed host and path rules first, mined association rules for the rest.

Each URL becomes a set of at most nine tokens, one for each slot (top-level domain, domain,
site below it, the site's last hyphenated part, the labels before the site, two path segments, file ending, query names). FP-growth mines the
token combinations that occur with the label "block" among labelled pages; rules are pruned
by support, confidence and by rules of fewer tokens that are as sure. An inverted index from
a rule's rarest token to the rules under that token matches them against every URL.

A URL has one token in each slot, so at most 2^9 / support combinations are frequent, however
large the table is: that bounds the mined rules and the broadcast index.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and
the method's verdict on an empty token set, which is allow. Repeated rows are judged row by
row; of two labels for one page the one for blocking counts. Without labels no rule is mined
and the verdict is allow. Only the named columns are read.
"""

from __future__ import annotations

import string
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ("tld", "domain", "site", "part", "sub", "seg1", "seg2", "ending", "query")
BLOCK = "label=block"

# Verdict, host and path of each rule.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


#: Words in a host that mark a labelled page as one to block.
SEEDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """At most one token per slot."""
    labels, segs = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)))), "&")
    value = {
        "tld": F.element_at(labels, -1),
        "domain": F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")),
        "site": F.when(F.size(labels) >= 3, F.element_at(labels, -3)),
        "part": F.when(F.size(labels) >= 3, F.regexp_extract(F.element_at(labels, -3), r"-([^-]+)$", 1)),
        "sub": F.when(F.size(labels) >= 4, F.array_join(F.slice(labels, 1, F.size(labels) - 3), ".")),
        "seg1": F.try_element_at(segs, F.lit(1)),
        "seg2": F.regexp_replace(F.try_element_at(segs, F.lit(2)), r"[0-9]+", "0"),
        "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1),
        "query": names,
    }
    return F.filter(F.array(*[F.when(F.coalesce(value[s], F.lit("")) != "", F.concat(F.lit(f"{s}="), value[s])) for s in SLOTS]), lambda x: x.isNotNull())


def slot_token(slot: str) -> Column:
    return F.get(F.filter("_tokens", lambda x: x.startswith(f"{slot}=")), F.lit(0))


def mined_rules(tokens: DataFrame, support: float, confidence: float, min_pages: int) -> list[tuple[list[str], float, int]]:
    """Token sets that imply blocking, their confidence and count; ``tokens`` has ``items`` with the label item."""
    n = tokens.count()
    if not n:
        return []
    model = FPGrowth(itemsCol="items", minSupport=max(support, min_pages / n), minConfidence=confidence).fit(tokens)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    with_block = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("hits"))
    sure = with_block.join(sets, "items").where(F.col("hits") >= confidence * F.col("freq"))
    rows = sorted(((r["items"], r["hits"] / r["freq"], r["freq"]) for r in sure.collect()), key=lambda r: (len(r[0]), r[0]))
    kept: dict[tuple[str, ...], tuple[float, int]] = {}
    for items, conf, freq in rows:  # a longer rule stays only if it is surer than each rule within it
        within = (x for n in range(1, len(items)) for x in combinations(items, n))
        if not any(x in kept and kept[x][0] >= conf for x in within):
            kept[tuple(items)] = conf, freq
    return [(list(items), conf, freq) for items, (conf, freq) in kept.items()]


def url_verdicts(pages: DataFrame, labels: DataFrame | None = None, id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, support: float = 0.002, confidence: float = 0.9, min_pages: int = 3) -> DataFrame:
    """One row per page: host, path, the longest fitting rule or null, and the verdict.

    ``labels`` has ``id`` and a boolean ``bad``.
    """
    seen = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url")).select("_id", "_url", *[c.alias(a) for c, a in zip(host_and_path(F.col("_url")), ("host", "path"), strict=True)])
    seen = seen.withColumn("_tokens", url_tokens(F.col("_url"), F.col("host"), F.col("path"))).drop("_url")

    mined = []
    if labels is not None:
        known = labels.select(F.col(id).alias("_id"), F.col("bad").alias("_bad")).where(F.col("_bad").isNotNull()).groupBy("_id").agg(F.max("_bad").alias("_bad"))
        items = seen.join(known, "_id").select(F.when(F.col("_bad"), F.array_append("_tokens", F.lit(BLOCK))).otherwise(F.col("_tokens")).alias("items"))
        mined = mined_rules(items.where(F.size("items") > 0), support, confidence, min_pages)

    out = seen
    if mined:
        count = {}
        for items_, _, freq in mined:
            for t in items_:
                count[t] = max(count.get(t, 0), freq)
        under: dict[str, list] = {}
        for items_, conf, _ in mined:
            under.setdefault(min(items_, key=lambda t: (count[t], t)), []).append((items_, conf))
        spark = pages.sparkSession
        struct = lambda r: F.struct(F.array(*map(F.lit, r[0])).alias("items"), F.lit(float(r[1])).alias("conf"))
        index = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(t).alias("_key"), F.array(*map(struct, rs)).alias("_rules")) for t, rs in sorted(under.items())])))
        for s in SLOTS:  # one lookup for each slot: no row is multiplied, nothing is shuffled
            if any(t.startswith(f"{s}=") for t in under):
                mine = F.broadcast(index.where(F.col("_key").startswith(f"{s}=")).select(F.col("_key").alias(f"_key_{s}"), F.col("_rules").alias(f"_rules_{s}")))
                out = out.join(mine, slot_token(s) == F.col(f"_key_{s}"), "left")
        cols = [c for c in out.columns if c.startswith("_rules_")]
        none = F.array().cast("array<struct<items:array<string>,conf:double>>")
        fitting = F.filter(F.flatten(F.array(*[F.coalesce(c, none) for c in cols])), lambda r: F.size(F.array_except(r["items"], F.col("_tokens"))) == 0)
        out = out.withColumn("_conf", F.array_max(F.transform(fitting, lambda r: r["conf"])))
    else:
        out = out.withColumn("_conf", F.lit(None).cast("double"))

    fits = [F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    best = F.array_max(F.array(*fits))
    return out.withColumn("_best", best).select(
        F.col("_id").alias(id),
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.when(F.col("_conf").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("_conf").alias("mined_confidence"),
    )
