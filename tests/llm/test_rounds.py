"""Classes are complete when their loop ends."""

import pytest

from starfold.llm.simhash import connected


def test_classes_do_not_end_unfinished(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected(links, rounds=1)
    assert {r["root"] for r in connected(links).collect()} == {0}
