"""SparkSession factory and the settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Defaults for a session of our own. On a cluster the deployer's settings win: they are passed as `conf`.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, app: str = "gridloom", conf: dict[str, str] | None = None) -> SparkSession:
    """A single-JVM session for tests and the bench; shuffle partitions follow the cores."""
    cpus = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g"} | (conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str):
    """The table `name` of a data folder (one file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
