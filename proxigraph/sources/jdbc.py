"""Tables of a database: the contact log, devices and access points of the original schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 8, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table by JDBC. With a numeric ``key`` it is read in ``parts`` ranges of that column, in as many
    tasks; rows whose key is null come with the first range. Filters and columns reach the database.

    Without ``bounds`` of the key one task looks for them, reading that column alone. Without a key, or
    in an empty table, one task reads it all. ``options`` go to Spark's source (driver, user,
    password, fetchsize); the driver's jar has to be on the class path.
    """
    source = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return source.option("dbtable", name).load()
    lo, hi = bounds or source.option("dbtable", name).load().agg(F.min(key), F.max(key)).first()
    if lo is None:
        return source.option("dbtable", name).load()
    ranges = {"partitionColumn": key, "lowerBound": str(lo), "upperBound": str(int(hi) + 1), "numPartitions": str(parts)}
    return source.option("dbtable", name).options(**ranges).load()


def write(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Rows into a table, a connection for each partition."""
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()
