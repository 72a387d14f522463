"""Personal data: exact base patterns, and boosted trees over overlapping candidates.

Base spans are leftmost non-overlapping matches of a pattern for each kind, checked for
validity. Generators of high recall then propose further candidate spans (keys, assigned
secrets, spelled-out addresses, numbers the base patterns swallow or miss). Boosted trees score
each candidate by its format and the text around it, and a threshold for each generator,
calibrated on held-out labelled snippets, selects the spans to add and redact.

The trees learn from labelled snippets made by rule (``snippets``, 40 for each template), so
the model is the same for every table and is fitted once in a process. The thresholds are
calibrated on snippets of other templates than those the trees learn from. Feature extraction,
scoring and redaction are DataFrame expressions; there is no shuffle.

Generators look at the text with its base spans blanked, so an added span never overlaps one.
Arrays of spans are folded in blocks (``running``), so the work grows in proportion to the
number of spans in a text.

Patterns use possessive forms of the plain ones: they match the same spans in linear time
and without recursion, however long a run of digits or name characters is.

Defined results: a null or empty text has no spans. Repeated rows are judged row by row,
empty tables give empty results, only the named columns are read. Spans are in code points,
end exclusive.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

SPAN = "array<struct<start:int,end:int>>"
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"  # of digits, at least one
BLOCK = 64  # elements of an array that are folded by themselves

#: Candidate generators: name, pattern and the kind of the spans they add.
GENERATORS = [
    ("key", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+(?![A-Za-z0-9_/+-])", "secret"),
    ("assigned", r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\x22']?[^\s\x22']{4,}+", "secret"),
    ("spelled", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}+\s{0,2}(?:\(at\)|\[at\])\s{0,2}[a-z0-9-]{2,63}+\s{0,2}(?:\.|\(dot\)|\[dot\])\s{0,2}[a-z]{2,12}+", "contact"),
    ("number", r"\+?(?<![0-9])[0-9]{1,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])|\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,19}+(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{2,3}[.-][0-9]{4}(?![0-9-])", "number"),
]
SECRET_WORDS = r"(?i)(?:key|secret|token|password|passwd|pwd|credential|auth)"
PERSON_WORDS = r"(?i)(?:phone|tel|call|fax|mobile|contact|mail|ssn|card|visa|account|reach)"
OTHER_WORDS = r"(?i)(?:isbn|version|order|page|chapter|http|file|figure|serial|population|sha|commit|build)"
KEEP = 24  # characters of context on the left
N_FEATURES = 18


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(values: Column, body) -> Column:
    """``body`` of each run of ``BLOCK`` elements, as an array."""
    starts = lambda v: F.filter(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda k: k * BLOCK < F.size(v))
    return let(values, lambda v: F.transform(F.transform(starts(v), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK))), body))


def running(values: Column, step) -> Column:
    """The states of a fold over integers from 0, one after each element."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    far = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    grow = lambda s, new: F.struct(new["at"].alias("at"), F.array_append(s["out"], new["out"]).alias("out"))
    one = lambda s, x: let(step(s["at"], x), lambda v: F.struct(v.alias("at"), F.array_append(s["out"], v).alias("out")))
    inner = lambda s, b: F.aggregate(b, begin.withField("at", s["at"]), one)
    return F.aggregate(blocks(values, lambda b: b), far, lambda s, b: let(inner(s, b), lambda new: grow(s, new)), lambda s: F.flatten(s["out"]))


def pieces(text: Column, pattern: str, gate: Column, valid, around: bool = False) -> Column:
    """Spans of the matches that are ``valid``, by the lengths of what lies between matches.

    ``around`` adds the match, the text before it and the character after it.
    """
    names = ["hit", "left", "next"] if around else []
    kind = SPAN[:-2] + "".join(f",{c}:string" for c in names) + ">>"

    def fields(between: Column):
        def of(h: Column, i: Column) -> Column:
            extra = [h.alias("hit"), F.right(F.get(between, i), F.lit(KEEP)).alias("left"), F.left(F.get(between, i + 1), F.lit(1)).alias("next")] if around else []
            return F.struct(F.length(F.get(between, i)).alias("gap"), F.length(h).alias("n"), valid(h).alias("ok"), *extra)

        return of

    def placed(ends: Column):
        return lambda x, i: F.struct((F.get(ends, i) - x["n"]).alias("start"), F.get(ends, i).alias("end"), *[x[c].alias(c) for c in names], x["ok"].alias("ok"))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(F.split(text, pattern, -1), lambda between: F.transform(hits, fields(between)))
    spans = let(found, lambda xs: let(running(F.transform(xs, lambda x: x["gap"] + x["n"]), lambda at, x: at + x), lambda ends: F.transform(xs, placed(ends))))
    kept = F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), *[x[c].alias(c) for c in names]))
    return F.when(gate, kept).otherwise(F.array().cast(kind))


def replaced(text: Column, spans: Column, fill) -> Column:
    """The text with every span, overlapping ones as one, replaced by ``fill`` of the span; spans are sorted by start.

    A span has ``from``, where the spans before it end, beside its own fields.
    """
    before = lambda ends: lambda s, i: s.withField("from", F.coalesce(F.get(ends, i - 1), F.lit(0)))
    known = let(spans, lambda xs: let(running(F.transform(xs, lambda s: s["end"]), lambda at, x: F.greatest(at, x)), lambda ends: F.transform(xs, before(ends))))
    first = lambda b: F.get(b, F.lit(0))["from"]
    part = lambda b: F.substr(text, first(b) + 1, F.greatest(F.element_at(b, -1)["start"] - first(b), F.lit(0)))
    piece = lambda b, chunk: lambda s: F.concat(F.substr(chunk, s["from"] - first(b) + 1, F.greatest(s["start"] - s["from"], F.lit(0))), fill(s))
    block = lambda b: let(part(b), lambda chunk: F.concat_ws("", F.transform(b, piece(b, chunk))))
    tail = F.substr(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.concat_ws("", blocks(known, block)), tail)).otherwise(text)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True if the digits pass the Luhn check."""
    value = lambda i: F.ascii(F.substr(d, F.length(d) - i + 1, F.lit(1))) - 48
    doubled = lambda i: F.when(i % 2 == 1, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), doubled), F.lit(0), lambda s, x: s + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the valid spans, in order."""
    some = text.rlike("[0-9]")
    n = lambda h: F.length(digits(h))
    return {
        "email": pieces(text, BASE["email"], text.contains("@"), lambda h: F.lit(True)),
        "ip": pieces(text, BASE["ip"], some & text.rlike(r"[0-9]\.[0-9]"), lambda h: h.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": pieces(text, BASE["card"], some & text.rlike(r"(?:[0-9][\x20-]?){12}[0-9]"), lambda h: n(h).between(13, 19) & luhn(digits(h))),
        "phone": pieces(text, BASE["phone"], text.rlike(r"\+[0-9]"), lambda h: n(h).between(9, 15)),
    }


def candidates(text: Column) -> Column:
    """The candidate spans of all generators with their text, what stands around and the generator's number."""
    gate = {"key": text.rlike(r"[0-9]"), "assigned": text.rlike(r"[=:]"), "spelled": text.rlike(r"(?i)[(\[]at[)\]]"), "number": text.rlike(r"[0-9]{3}")}
    tagged = lambda g: lambda c: c.withField("gen", F.lit(g))
    return F.concat(*[F.transform(pieces(text, pattern, gate[name], lambda h: F.lit(True), around=True), tagged(g)) for g, (name, pattern, _) in enumerate(GENERATORS)])


def features(c: Column) -> Column:
    """Binned features of one candidate, as an array of ``N_FEATURES``: generator, format, context."""
    hit, left = c["hit"], c["left"]
    share = lambda cls: F.length(F.regexp_replace(hit, f"[^{cls}]", "")) / F.greatest(F.length(hit), F.lit(1))
    bins = lambda v, cuts: reduce(lambda a, k: a + F.when(v > k, 1).otherwise(0), cuts, F.lit(0))
    turns = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "0"), "[^0]+", "a"), "a", ""))
    flag = lambda v: F.when(v, 1).otherwise(0)
    found = [
        c["gen"],
        bins(F.length(hit), (11, 15, 17, 19, 24, 39)),
        bins(share("0-9"), (0.0, 0.15, 0.3, 0.6, 0.99)),
        bins(share("A-Z"), (0.0, 0.1, 0.5)),
        bins(share("a-z"), (0.0, 0.5, 0.9)),
        bins(turns, (0, 1, 2, 4)),
        flag(hit.rlike("^[A-Z0-9]+$")),
        flag(hit.rlike("^[0-9a-f]+$")),
        flag(hit.rlike(r"[/_]")),
        bins(F.length(F.regexp_replace(hit, "[^-]", "")), (0, 2)),
        flag(hit.rlike(r"^[0-9]+$") & luhn(digits(hit))),
        flag(hit.rlike(r"^\+|\(")),
        flag(hit.rlike(r"[=:]\s*[\x22']?\S*[0-9]")),
        flag(hit.rlike(r"(?i)[(\[]dot[)\]]|\S\.\S")),
        flag(left.rlike(SECRET_WORDS)),
        flag(left.rlike(PERSON_WORDS)),
        flag(left.rlike(OTHER_WORDS)),
        flag(left.rlike(r"[/.@#\w-]$") | c["next"].rlike(r"^[/@\w-]")),
    ]
    return F.array(*[x.cast("int") for x in found])


def snippets(per_template: int = 40, seed: int = 7) -> list[tuple[str, int, int]]:
    """Labelled texts made by rule: text, label, fold (1: of the templates that only calibrate)."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: pick(low, r.randint(2, 9))
    mixed = lambda n: pick(low + up + dig, n - 2) + pick(dig, 2)

    def card(off: int = 0) -> str:
        d = r.choice("456") + pick(dig, 14)
        s = sum(sum(divmod(int(x) * (2 if i % 2 == 0 else 1), 10)) for i, x in enumerate(d))
        return d + str((off - s) % 10)

    learn = [
        lambda: "AKIA" + pick(up + "23456789", 14) + pick("234567", 2),
        lambda: f"password={pick(hexa, r.randint(8, 20))}1",
        lambda: f'token = "{pick(hexa, r.choice([32, 40]))}"',
        lambda: f"api_key: {mixed(r.randint(20, 40))}",
        lambda: f"secret={mixed(r.randint(12, 30))}",
        lambda: f"key {mixed(r.randint(24, 44))}",
        lambda: f"{word()}.{word()} (at) {word()} (dot) com",
        lambda: f"{word()}[at]{word()}.org",
        lambda: f"+{r.randint(1, 99)} ({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)} {card()}",
        lambda: f"({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}",
        lambda: f"phone {pick(dig, 3)}-{pick(dig, 3)}-{pick(dig, 4)}",
        lambda: f"ssn {pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}",
        lambda: f"card {card()}",
        lambda: f"{word()} {card()} {card()}",
    ]
    other = [
        lambda: f"{word()}-{word()}-{word()}-{word()}{r.randint(1, 9)}",
        lambda: f"version {r.randint(1, 9)}.{r.randint(0, 99)}.{pick(dig, 4)}",
        lambda: f"isbn 978{pick(dig, 10)}",
        lambda: f"http://www.{word()}.com/{word()}/{word()}{pick(dig, 3)}_{word()}",
        lambda: f"file {word()}_{word()}_{pick(dig, 4)}_{word()}_final",
        lambda: f"commit {pick(hexa, 40)}",
        lambda: f"sha {pick(hexa, 32)}7",
        lambda: f"population {pick('123456789', 1)}{pick(dig, 13)}",
        lambda: f"order 2{pick(dig, 13)}",
        lambda: card(r.randint(1, 9)),
        lambda: card(r.randint(1, 9)),
        lambda: f"build 2024-{pick(dig, 2)}-{pick(dig, 4)}",
        lambda: f"{word()}: {word()} the token: {word()} and",
        lambda: f"the password: {word()} {word()}",
        lambda: f"meet [at] {word()}. {word()}",
        lambda: f"serial {pick(dig, 3)}-{pick(dig, 3)}-{pick(dig, 4)}",
        lambda: f"{word()}{word()}{word()}{word()}{pick(dig, 1)}",
    ]
    # Templates that only calibrate.
    yes = [
        lambda: f"ghp_{mixed(36)}",
        lambda: f"passwd: {mixed(r.randint(8, 16))}",
        lambda: f"auth {mixed(r.randint(30, 60))}",
        lambda: f"secret: '{pick(hexa, 24)}9'",
        lambda: f"{word()}_{word()} [at] {word()} [dot] net",
        lambda: f"call ({pick(dig, 3)}) {pick(dig, 3)} {pick(dig, 4)}",
        lambda: f"fax {pick(dig, 3)}.{pick(dig, 3)}.{pick(dig, 4)}",
        lambda: f"visa {card()}",
    ]
    no = [
        lambda: f"{word()}/{word()}/{word()}/{word()}_{pick(dig, 2)}",
        lambda: f"page {pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}",
        lambda: f"figure {word()}-{word()}-{word()}-{pick(dig, 4)}",
        lambda: f"build {pick(hexa, 39)}3",
        lambda: f"serial {card(r.randint(1, 9))}",
        lambda: f"a secret: {word()} {word()}",
        lambda: f"pwd: {word()}, {word()}",
        lambda: f"{word()} [at] {word()} . {word()}",
    ]
    out = []
    for label, fold, makers in ((1, 0, learn), (0, 0, other), (1, 1, yes), (0, 1, no)):
        for make in makers:
            for _ in range(per_template):
                out.append((" ".join([word(), word(), make(), word() + r.choice([".", ",", ""]), word()]), label, fold))
    return out


_LEARNED: dict[tuple[float, int], tuple[list[boosting.Tree], list[float]]] = {}


def learned(spark: SparkSession, precision: float = 0.95, per_template: int = 40) -> tuple[list[boosting.Tree], list[float]]:
    """Trees and one threshold for each generator, from the labelled snippets; fitted once in a process."""
    if (precision, per_template) in _LEARNED:
        return _LEARNED[precision, per_template]
    rows = ",".join("('" + t.replace("\\", "\\\\").replace("'", "\\'") + f"',{y},{k})" for t, y, k in snippets(per_template))
    texts = spark.sql(f"SELECT * FROM VALUES {rows} AS t(text, y, fold)")
    table = texts.select("y", "fold", F.explode(candidates(F.col("text"))).alias("c")).select("y", "fold", features(F.col("c")).alias("x"))
    counted = table.groupBy("y", "fold", "x").count().orderBy("y", "fold", "x").collect()  # at most one row a snippet candidate
    x = np.array([r["x"] for r in counted], np.int64)
    y, w, fold = (np.array([r[c] for r in counted], float) for c in ("y", "count", "fold"))
    held = fold == 1
    trees = boosting.fit(x[~held], y[~held], w[~held])
    odds = boosting.log_odds(trees, x)
    cuts = [max(0.0, boosting.calibrated(odds[m], y[m], w[m], precision)) if (m := held & (x[:, 0] == g)).any() else 0.0 for g in range(len(GENERATORS))]
    _LEARNED[precision, per_template] = trees, cuts
    return trees, cuts


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a struct column: the base spans for each kind and ``added`` (kind, start, end), sorted."""
    trees, cuts = learned(docs.sparkSession)
    mark = f"_{out}"
    while any(c.lower().startswith(mark.lower()) for c in docs.columns):
        mark = f"_{mark}"
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn(f"{mark}_base", F.struct(*[c.alias(k) for k, c in base_spans(whole).items()]))
    base = lambda k: F.col(f"{mark}_base")[k]
    bare = replaced(whole, F.sort_array(F.concat(*map(base, BASE))), lambda s: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], s["from"]), F.lit(0))))
    found = found.withColumn(f"{mark}_bare", bare).withColumn(f"{mark}_gen", candidates(F.col(f"{mark}_bare")))
    odds = lambda c: let(features(c), lambda x: boosting.log_odds_column(trees, [F.get(x, F.lit(k)) for k in range(N_FEATURES)]))
    enough = lambda c: odds(c) >= F.get(F.array(*map(F.lit, cuts)), c["gen"])
    kind = lambda c: F.get(F.array(*[F.lit(k) for _, _, k in GENERATORS]), c["gen"])
    chosen = F.transform(F.filter(f"{mark}_gen", enough), lambda c: F.struct(kind(c).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    added = let(F.sort_array(chosen), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1))))
    return found.select(*docs.columns, F.struct(*[base(k).alias(k) for k in BASE], added.alias("added")).alias(out))


def _span(kind: str):
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))


def span_text(kinds: list[tuple[str, Column]]) -> Column:
    """``kind:start:end`` for all spans, comma-joined."""
    lines = [F.transform(c, _line(k)) for k, c in kinds]
    return F.array_join(F.concat(*lines), ",")


def _line(kind: str | None):
    return lambda s: F.concat_ws(":", F.lit(kind) if kind else s["kind"], s["start"], s["end"])


def redact(text: Column, pii: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by the kind of its first in brackets; a null text stays null."""
    typed = [F.transform(pii[k], _span(k)) for k in BASE]
    spans = F.sort_array(F.transform(F.concat(*typed, pii["added"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return replaced(text, spans, lambda s: F.when(s["start"] >= s["from"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
