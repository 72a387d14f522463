"""Queries of the text operators over the tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_cnn import quality
from .class_lm import score_texts
from .decontam import contaminated
from .license_scan import license_scan
from .merkle import manifest
from .mixing import mix, taken
from .negatives import hard_negatives
from .oracles import ORACLES  # noqa: F401
from .pii import BASE, find_pii, span_text
from .quality_rules import quality_rules
from .sentencepiece_nbest import encode
from .simhash import hex_fingerprint, simhash_classes
from .toxicity import toxicity
from .url_rules import SEEDS, host_and_path, url_verdicts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [(k, F.col(f"pii.{k}")) for k in BASE]
    return found.select("doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base], F.sha2(span_text(base), 256).alias("base_sha256"), span_text([*base, (None, F.col("pii.added"))]).alias("spans"), F.size("pii.added").cast("long").alias("n_added"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), ["doc_id"])
    scores = F.array_join(F.transform("scores", lambda x: x.cast("decimal(20,0)").cast("string")), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.get("scores", F.lit(0)).alias("score"), scores.alias("nbest_scores"), F.xxhash64("ids").alias("ids_hash"), F.xxhash64("alternatives").alias("alternatives_hash"), "exact")


def page_labels(pages: DataFrame) -> DataFrame:
    """Labels of three quarters of the pages, by seed words between the dots and hyphens of a host; ``labels`` has document ids, not page ids.

    The other pages (by the first digit of the id's MD5) have no label: only mined rules can block them.
    """
    host, _ = host_and_path(F.col("url"))
    known = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 1) >= "4"
    return pages.where(known).select("page_id", F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, SEEDS))).alias("bad"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(pages, page_labels(pages))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"), shingle=3)
    return found.withColumn("fingerprint", hex_fingerprint(F.col("fingerprint")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "rules.*").withColumns({c: F.round(c, 9) for c in ("dup_line_share", "dup_gram_share")})


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 9))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_class_lm": op6_class_lm,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_simhash": op10_simhash,
    "op11_mixing": op11_mixing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle": op13_merkle,
}
