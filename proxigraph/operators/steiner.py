"""Steiner trees by weighted Voronoi cells of the terminals.

Every vertex learns its nearest terminal by rounds of relaxation. The shortest way between two neighbouring cells
crosses one edge; the minimum spanning tree over these ways, expanded along the cells' shortest paths, is a tree
of at most twice the least weight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.operators.iterative import spanning_forest
from proxigraph.plans.graph import Graph, user_seq, user_sql
from proxigraph.plans.shared import drop, materialize


def cells(g: Graph, terminals: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(id, total, seed, parent): the nearest row (id) of ``terminals`` by weight, of equals the least, then by the
    least parent; vertices out of reach are not listed. Negative weights are an error."""
    s = materialize(g.both("weight").filter("v <> u"), "cells-links")
    if not s.filter("weight < 0").isEmpty():
        raise ValueError("negative weight")
    start = terminals.join(g.vertices, "id", "left_semi").distinct().select("id", F.lit(0.0).alias("total"), F.col("id").alias("seed"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("new"))
    now = materialize(start, "cells")
    for _ in range(rounds):
        moved = now.filter("new")
        offer = moved.join(s, F.col("id") == F.col("v")).groupBy(F.col("u").alias("id")).agg(F.min(F.struct((F.col("total") + F.col("weight")).alias("total"), "seed", F.col("v").alias("parent"))).alias("x"))
        both = now.join(offer, "id", "full")
        mine = F.struct("total", "seed", F.coalesce("parent", F.lit("")).alias("parent"))
        better = F.col("x").isNotNull() & (F.col("seed").isNull() | (F.struct("x.total", "x.seed", "x.parent") < mine)) & (F.coalesce("seed", F.lit("")) != F.col("id"))
        pick = lambda c: F.when(better, F.col(f"x.{c}")).otherwise(F.col(c)).alias(c)
        nxt = materialize(both.select("id", pick("total"), pick("seed"), pick("parent"), F.coalesce(better, F.lit(False)).alias("new")), "cells")
        drop(now)
        now = nxt
        if now.filter("new").isEmpty():
            return now.select("id", "total", "seed", "parent")
    raise RuntimeError(f"the cells did not settle in {rounds} rounds")


def steiner_tree(g: Graph, terminals: DataFrame, forest: bool = False) -> DataFrame:
    """(src, dst, weight): a tree that connects all ``terminals`` (id), of at most twice the least weight.

    Of parallel edges the lightest counts. One terminal, or none, gives no edges; an unknown terminal and
    terminals that are not connected are errors. With ``forest`` the latter get a tree in each component."""
    terminals = materialize(terminals.select("id").distinct(), "steiner-terminals")
    k = terminals.count()
    if terminals.join(g.vertices, "id", "left_semi").count() < k:
        raise ValueError("a terminal is not in the graph")
    e = g.edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    g = Graph(g.vertices.distinct(), materialize(e, "steiner-edges"))
    cell = materialize(cells(g, terminals), "steiner-cells")
    end = lambda c: cell.select(F.col("id").alias(c), F.col("total").alias(f"{c}_total"), F.col("seed").alias(f"{c}_seed"))
    way = g.edges.join(end("src"), "src").join(end("dst"), "dst").filter("src_seed <> dst_seed")
    x = way.select(F.least("src_seed", "dst_seed").alias("a"), F.greatest("src_seed", "dst_seed").alias("b"), (F.col("weight") + F.col("src_total") + F.col("dst_total")).alias("w"), "src", "dst", "weight")
    bridge = materialize(x.groupBy("a", "b").agg(F.min(F.struct("w", "src", "dst", "weight")).alias("m")).select("a", "b", "m.*"), "steiner-bridges")
    tree = spanning_forest(Graph(terminals, bridge.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"))))
    chosen = materialize(bridge.join(tree.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_semi").select("src", "dst", "weight"), "steiner-chosen")
    if not forest and k > 1 and chosen.count() < k - 1:
        raise ValueError("the terminals are not connected")
    at, parts = materialize(chosen.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "steiner-climb"), [chosen]
    seen = at
    while True:  # from the crossings up to the terminals, each vertex once
        step = at.join(cell.filter("parent is not null").select("id", "parent"), "id").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"), "parent")
        step = materialize(step, "steiner-climb")
        if step.isEmpty():
            break
        parts.append(step.join(g.edges, ["src", "dst"]).select("src", "dst", "weight"))
        at = materialize(step.select(F.col("parent").alias("id")).distinct().join(seen, "id", "left_anti"), "steiner-climb")
        seen = seen.unionByName(at)
    return reduce(DataFrame.unionByName, parts).distinct()


def _users(s, d: str) -> DataFrame:
    g = user_seq(s, d)
    return steiner_tree(g, g.vertices.filter(F.col("id").isin("u1", "u3", "u5", "u7", "u9")), forest=True)


QUERIES = {
    "steiner_tree": _users,
    "voronoi_weighted": lambda s, d: (lambda g: cells(g, g.vertices.filter(F.col("id").isin("u1", "u2", "u3"))).select("id", "total", "seed"))(user_seq(s, d)),
}
_RELAX = ", ".join(["f0 AS MATERIALIZED (SELECT id, 0.0::DOUBLE AS total, id AS seed FROM v WHERE id IN ('u1', 'u2', 'u3'))"] + [f"f{i + 1} AS MATERIALIZED (SELECT id, min(total) AS total, arg_min(seed, (total, seed)) AS seed FROM (SELECT * FROM f{i} UNION ALL SELECT s.u, total + weight, seed FROM f{i} JOIN s ON s.v = f{i}.id) GROUP BY id)" for i in range(30)])
SQL = {"voronoi_weighted": user_sql("SELECT id, total, seed FROM f30", _RELAX)}
