"""A Spark session with the settings that the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lodestone", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session unless the environment or conf names another master."""
    cpus = cpus or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in settings and "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
