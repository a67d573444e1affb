"""Session factory for tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "cadenza", cpus: int | str | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the operators assume (UTC, AQE)."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
