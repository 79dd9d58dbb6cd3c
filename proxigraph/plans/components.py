"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation (a minimum per node, combined before the shuffle) and one
equi-join that adaptive execution can split, so a hub with very many links never has to
sit in a single task. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.plans.shared import drop, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with u > v, distinct. Links every node to the least of its neighbours."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:  # neighbours above u point to the least of all
        return met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = met.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node that has a link to another; component is its least id.

    Null ends, loops and repeated links are ignored; an empty table gives an empty result.
    Nodes without links are not listed: their component is themselves.
    """
    now = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v")))
        .distinct(),
        "cc",
    )
    sign = None
    for _ in range(max_rounds):
        nxt = materialize(_star(_star(now, True).distinct(), False).distinct(), "cc")
        row = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = nxt
        if sign == tuple(row):
            break
        sign = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
