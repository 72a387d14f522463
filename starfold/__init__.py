"""Spark-native analytics for pixel tables, source catalogs and text corpora."""
