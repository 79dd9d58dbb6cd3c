"""Functions on columns and small tables that queries and sinks share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_field(c: Column) -> Column:
    """A field of a CSV line: quoted, with quotes doubled, where it holds a comma, quote or line end."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\\r\\n]'), quoted).otherwise(F.coalesce(c, F.lit("")))


def half_up(c: Column, digits: int) -> Column:
    """Rounding with halves upwards, also below zero."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def softmax(rows: DataFrame, value: str, key: str) -> DataFrame:
    """(key, share): exp(value) over the sum of all, values less their largest."""
    top = rows.agg(F.max(value).alias("top"))
    x = rows.join(F.broadcast(top)).select(key, F.exp(F.col(value) - F.col("top")).alias("x"))  # one row
    return x.join(F.broadcast(x.agg(F.sum("x").alias("t")))).select(key, F.round(F.col("x") / F.col("t"), 9).alias("share"))


def histogram_map(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, counts): how often each value occurs, as 'value=count' in order of value, merged over tasks."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(value, "n"))), lambda x: F.concat_ws("=", x[value].cast("string"), x["n"].cast("string")))
    return n.groupBy(by).agg(F.array_join(pairs, ",").alias("counts"))
