"""The corpus pipeline against a brute-force version of its stages, on the smallest tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starfold.llm import decontam, pii, quality_rules, sentencepiece_nbest
from tests.llm.test_near_copies import firsts
from tests.llm.test_text_operators import PLAIN, valid

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    limits = quality_rules.Limits()
    rows = [r for r in rows if quality_rules.measure(r[1], limits)[6]]
    first = firsts([(d, t or "") for d, t in rows])
    rows = [r for r in rows if r[0] in first]
    items = [decontam.reduced(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in decontam.reduced(r[1]) for i in items)]
    encoded = corpus_pipeline.run(spark, SF)
    out = {r["doc_id"]: r for r in encoded.collect()}
    assert set(out) == {d for d, _ in rows} and all(r["exact"] for r in out.values())

    # The last stage's pieces are those of the texts with every span replaced.
    added = {r["doc_id"]: r["pii"]["added"] for r in pii.find_pii(docs).select("doc_id", "pii").collect()}
    text = {r["doc_id"]: r["text"] for r in sentencepiece_nbest.decode(encoded, ["doc_id"]).collect()}
    changed = 0
    for d, t in rows:
        spans = [(m.start(), m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, t) if valid(k, m.group())]
        want, at = "", 0
        for a, z, kind in sorted(spans + [(s["start"], s["end"], s["kind"]) for s in added[d]]):
            want, at = (want + t[at:a] + f"[{kind}]" if a >= at else want), max(at, z)
        assert text[d] == want + t[at:]
        changed += want != ""
    assert changed > 5


def test_stages_keep_columns_and_survive_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rules string, pii string, fp string, id string"
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300))
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "r", "p", "f", "i") for k, t in enumerate([long, long, None, "", long + " write to a.b@c.de"])], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "stage")
        assert docs.schema.simpleString() == f"struct<{schema.replace(' long', ':bigint').replace(' string', ':string').replace(', ', ',')}>"
    kept = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert kept in ({0: long}, {0: long, 4: long + " write to [email]"})
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where(~F.col("exact")).count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false") if os.path.isdir(SF) else spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
