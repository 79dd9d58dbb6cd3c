"""Session defaults: adaptive execution, UTC, Arrow transfer."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "proxigraph") -> SparkSession:
    """A single-JVM session for tests and benches; on a cluster use the session that spark-submit gives."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the parquet tables of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
