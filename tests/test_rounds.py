"""Loops end when their work is done, never silently at a limit."""

import pytest

from starfold.operators.spatial import greedy_suppress


def test_suppression_does_not_end_with_open_pairs(spark):
    points = spark.createDataFrame([(k, 0.0, float(k), float(-k)) for k in range(12)], "id long, y double, x double, rank double")
    with pytest.raises(RuntimeError):
        greedy_suppress(points, 1.0, rounds=2)
    assert {r["id"] for r in greedy_suppress(points, 1.0).collect()} == set(range(0, 12, 2))
