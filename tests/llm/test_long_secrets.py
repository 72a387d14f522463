"""Secrets of any length are found and redacted whole."""

import random
import re

from pyspark.sql import functions as F

from starfold.llm.pii import find_pii, redact


def test_long_secrets_are_redacted_whole(spark):
    r = random.Random(5)
    chars = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    late = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(60)) + chars(138) + "42"
    secrets = ["key " + chars(199) + "7", "token=" + chars(182), "api_key: " + chars(5000) + "1", "key " + late]
    docs = spark.createDataFrame([(k, f"some words {s} and more") for k, s in enumerate(secrets)], "doc_id long, text string")
    out = find_pii(docs).select("doc_id", redact(F.col("text"), F.col("pii")).alias("text")).collect()
    for row in out:
        secret = secrets[row["doc_id"]].replace("=", " ").split()[-1]
        assert "[secret]" in row["text"] and not any(secret[at : at + 8] in row["text"] for at in range(len(secret) - 7)), row


def test_a_thousand_characters_and_many_spans(spark):
    r = random.Random(6)
    secret = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(1000)) + "5"
    many = " ".join(f"u{k}@h{k}.example.org 10.0.{k % 256}.7" for k in range(50_000))
    docs = spark.createDataFrame([(0, f"token = {secret} end", "x"), (1, many, "x")], "doc_id long, text string, _pii_base string")
    out = {row["doc_id"]: row for row in find_pii(docs).select("doc_id", "_pii_base", "pii", redact(F.col("text"), F.col("pii")).alias("text")).collect()}
    assert out[0]["text"] == "[secret] end" and out[0]["_pii_base"] == "x"
    assert out[1]["text"] == " ".join(["[email] [ip]"] * 50_000)
    starts = [s["start"] for s in out[1]["pii"]["ip"]]
    assert starts == [m.start() for m in re.finditer(r"10\.0\.", many)]


def test_redaction_merges_overlapping_spans_and_keeps_all_other_characters(spark):
    r = random.Random(7)
    parts = ["é", "token=abcd1234efgh5678", " ", "+49 30 1234567", "1.2.3.4", "a@b.cd", "(555) 123-4567", "\U0001f600", "key ab12cd34ef56gh78ij90", "\n", "x"]
    texts = ["".join(r.choices(parts, k=k)) for k in (3, 12, 70, 400) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in find_pii(docs).select("*", redact(F.col("text"), F.col("pii")).alias("safe")).collect():
        spans = sorted([(s["start"], s["end"], k) for k in ("email", "ip", "card", "phone") for s in row["pii"][k]] + [(s["start"], s["end"], s["kind"]) for s in row["pii"]["added"]])
        want, at = "", 0
        for a, z, kind in spans:
            if a >= at:
                want += row["text"][at:a] + f"[{kind}]"
            at = max(at, z)
        assert row["safe"] == want + row["text"][at:]
        for s in row["pii"]["added"]:
            assert all(z <= s["start"] or s["end"] <= a for k in ("email", "ip", "card", "phone") for a, z in row["pii"][k])
