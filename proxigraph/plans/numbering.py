"""Positions in a total order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxigraph.plans.shared import materialize


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: places 1, 2, ... by ``order``, which has to be total.

    Rows are sorted in ranges; a range's offset is the sum of the counts before it, a table with
    a row per range. The sorted rows are written once, so that ranges stay what they are.
    """
    part, local, before = f"{name}__part", f"{name}__local", f"{name}__before"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.select("*", F.spark_partition_id().alias(part)), "numbered")
    counts = rows.groupBy(part).agg(F.count("*").alias(before))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = counts.select(part, F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    out = rows.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(*order))).join(F.broadcast(counts), part)
    return out.withColumn(name, (F.col(before) + F.col(local)).cast("long")).drop(part, local, before)
