"""Corpus preparation: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), with ``docs`` in the columns of ``documents``, and works
on all rows of its predecessor; all but the last return the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.decontam import without_benchmark
from starfold.llm.near_copies import keep_dissimilar
from starfold.llm.pii import find_pii, redact
from starfold.llm.quality_rules import quality_rules
from starfold.llm.sentencepiece_nbest import encode
from starfold.shared import materialize


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rules = free_name(docs, "rules")
    return quality_rules(docs, out=rules).where(F.col(f"{rules}.kept")).drop(rules)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies: a five-word Jaccard similarity of 0.8 and more."""
    return keep_dissimilar(docs, shingle=5, least=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    pii = free_name(docs, "pii")
    safe = find_pii(docs, out=pii).withColumn("text", redact(F.col("text"), F.col(pii))).drop(pii)
    return safe.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, the scores of its best segmentations, and whether decoding gave the text back."""
    return encode(docs, ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", encoding_stage),
]
#: The hashing, the alignment and the lattice search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
