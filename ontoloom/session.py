"""Session settings that the package relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(cores: int | str = "*", name: str = "ontoloom", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session to the operators."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    local = {
        "spark.sql.shuffle.partitions": str(os.cpu_count() or 8),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (SETTINGS | local | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
