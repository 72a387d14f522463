"""Pixel tables and source catalogs derived from the tables of a scale-factor folder.

``pixels``: the embedding vectors as the rows of an image. ``cells``: prices by supplier, as
groups without geometry. ``stars`` and ``references``: catalogs with positions from quadratic
hashes of the key, in fields of 128 x 128 pixels stacked along y so that the density does
not depend on the table's size. Positions are (y, x), 1-based pixel centres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 128


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y, x, v, band``: one row per pixel; the label of a row is its band."""
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("y"), F.col("label").cast("long").alias("band"), F.posexplode("embedding").alias("pos", "value"))
    return rows.select("y", (F.col("pos") + 1).cast("long").alias("x"), F.col("value").cast("double").alias("v"), "band")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell, v``: values in groups."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_extendedprice").alias("v"))


def hashed(k: Column, a: int, b: int, m: int) -> Column:
    """A position within a field from a quadratic hash of the key; residues first, so that no key overflows."""
    r = k % m
    return 1 + ((r * r % m * (a % m) + r * (b % m)) % m).cast("double") / F.lit(float(m)) * SIDE


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, field, y, x, flux``: 2,000 stars in each field."""
    k = F.col("p_partkey")
    field = F.expr("p_partkey div 2000")
    return read(spark, sf_dir, "part").select(k.alias("id"), field.alias("field"), (hashed(k, 7919, 104729, 20011) + field * SIDE).alias("y"), hashed(k, 15485863, 32452843, 30011).alias("x"), F.col("p_retailprice").alias("flux"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, field, y, x, flux``: 100 bright sources in each field."""
    k = F.col("s_suppkey")
    field = F.expr("s_suppkey div 100")
    return read(spark, sf_dir, "supplier").select(k.alias("id"), field.alias("field"), (hashed(k, 6007, 70001, 10007) + field * SIDE).alias("y"), hashed(k, 9973, 50021, 8009).alias("x"), (F.abs("s_acctbal") + 500).alias("flux"))


# The same bindings as SQL, for the reference statements.
PIXELS = """px AS (SELECT vec_id + 1 AS y, i AS x, CAST(embedding[i] AS DOUBLE) AS v, CAST(label AS BIGINT) AS band
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
CELLS = "cells AS (SELECT l_suppkey AS cell, l_extendedprice AS v FROM lineitem)"
STARS = """stars AS (SELECT p_partkey AS id, p_partkey // 2000 AS field,
  1 + CAST(((p_partkey % 20011) * (p_partkey % 20011) % 20011 * 7919 + (p_partkey % 20011) * 4674) % 20011 AS DOUBLE) / CAST(20011 AS DOUBLE) * 128 + (p_partkey // 2000) * 128 AS y,
  1 + CAST(((p_partkey % 30011) * (p_partkey % 30011) % 30011 * 187 + (p_partkey % 30011) * 10952) % 30011 AS DOUBLE) / CAST(30011 AS DOUBLE) * 128 AS x, p_retailprice AS flux FROM part)"""
REFERENCES = """refs AS (SELECT s_suppkey AS id, s_suppkey // 100 AS field,
  1 + CAST(((s_suppkey % 10007) * (s_suppkey % 10007) % 10007 * 6007 + (s_suppkey % 10007) * 9959) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * 128 + (s_suppkey // 100) * 128 AS y,
  1 + CAST(((s_suppkey % 8009) * (s_suppkey % 8009) % 8009 * 1964 + (s_suppkey % 8009) * 1967) % 8009 AS DOUBLE) / CAST(8009 AS DOUBLE) * 128 AS x, abs(s_acctbal) + 500 AS flux FROM supplier)"""
