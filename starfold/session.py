"""Session defaults shared by tests, the benchmark and applications."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "starfold", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and one shuffle partition a core."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
