"""Maximal cliques.

Vertices are put in an order in which every vertex has few neighbours after it: those of at most
twice the average degree go first, again and again, so there are some log n rounds and a vertex has at most
SLACK times twice the core number of neighbours after it, its *later* ones. A clique is found from its first
vertex: the later neighbours of each vertex and the edges between them are one small row, in which a
search with pivots lists the cliques that are maximal there. Those that an earlier vertex extends are
removed by joins through the member with the fewest earlier neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.plans.graph import Graph, co_part, rounded, sql, user_seq, user_sql
from proxigraph.plans.shared import drop, materialize

SLACK = 1.2


def peeling(g: Graph) -> DataFrame:
    """(id, round): the round in which a vertex goes; in each, those go whose remaining degree is at most
    SLACK times the average. What is left without links goes last."""
    links = materialize(g.both().filter("v <> u").distinct(), "peel-links")
    linked = links.select(F.col("v").alias("id")).distinct()
    parts, r = [materialize(g.vertices.distinct().join(linked, "id", "left_anti").select("id", F.lit(0).alias("round")), "peel")], 0
    while True:
        degree = materialize(links.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("d")), "peel-degrees")
        mean = degree.agg(F.avg("d")).first()[0]
        if mean is None:
            gone = reduce(DataFrame.unionByName, parts)
            return gone.unionByName(g.vertices.distinct().join(gone, "id", "left_anti").select("id", F.lit(r + 1).alias("round")))
        r += 1
        new = materialize(degree.filter(F.col("d") <= mean * SLACK).select("id", F.lit(r).alias("round")), "peel")
        parts.append(new)
        gone = new.select("id")
        left = materialize(links.join(gone.toDF("v"), "v", "left_anti").join(gone.toDF("u"), "u", "left_anti").select("v", "u"), "peel-links")
        drop(links)
        drop(degree)
        links = left


def _search(n: int, near: list[int]) -> Iterator[list[int]]:
    """Maximal cliques of a small graph: ``near`` has a bit for each neighbour."""
    stack = [([], (1 << n) - 1, 0)]
    while stack:
        clique, cand, done = stack.pop()
        if not cand:
            if not done:
                yield clique
            continue
        bits = cand | done
        best, pivot = -1, 0
        while bits:  # the vertex with the most candidates around it
            b = bits & -bits
            bits ^= b
            k = (cand & near[b.bit_length() - 1]).bit_count()
            if k > best:
                best, pivot = k, b.bit_length() - 1
        todo = cand & ~near[pivot]
        while todo:
            b = todo & -todo
            todo ^= b
            v = b.bit_length() - 1
            stack.append(([*clique, v], cand & near[v], done & near[v]))
            cand ^= b
            done |= b


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first, out = [], []
        for v, later, between in zip(b["v"].to_pylist(), b["later"].to_pylist(), b["between"].to_pylist(), strict=True):
            at = {u: i for i, u in enumerate(later)}
            near = [0] * len(later)
            for e in between or ():
                i, j = at[e["a"]], at[e["b"]]
                near[i] |= 1 << j
                near[j] |= 1 << i
            for c in _search(len(later), near):
                first.append(v)
                out.append(sorted([v, *(later[i] for i in c)]))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["v", "clique"])
                    first, out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["v", "clique"])


def maximal_cliques(g: Graph) -> DataFrame:
    """(clique, size): every maximal clique, its vertices in order; an isolated vertex is one of size 1.

    Parallel edges count once and loops do not. There is no limit: their number can grow exponentially with the
    core number, that of the rows that tasks hold at once cannot."""
    place = F.struct("round", "id")
    order = materialize(peeling(g), "clique-order")
    key = lambda end, name: order.select(F.col("id").alias(end), place.alias(name))
    e = g.edges.filter("src <> dst").select("src", "dst").distinct().join(key("src", "p"), "src").join(key("dst", "q"), "dst")
    ahead = F.col("p") < F.col("q")
    up = materialize(e.select(F.when(ahead, F.col("src")).otherwise(F.col("dst")).alias("v"), F.when(ahead, F.col("dst")).otherwise(F.col("src")).alias("u")).distinct(), "clique-later")
    wedge = up.join(up.withColumnRenamed("u", "w"), "v").filter(F.col("u") != F.col("w"))
    between = wedge.join(up.select(F.col("v").alias("u"), F.col("u").alias("w")), ["u", "w"]).groupBy("v").agg(F.collect_list(F.struct(F.col("u").alias("a"), F.col("w").alias("b"))).alias("between"))
    later = materialize(up.groupBy("v").agg(F.sort_array(F.collect_list("u")).alias("later")), "clique-rows")  # bounded by the order
    none = F.array().cast("array<string>")
    rows = order.select(F.col("id").alias("v")).join(later, "v", "left").join(between, "v", "left").select("v", F.coalesce("later", none).alias("later"), "between")
    found = materialize(rows.mapInArrow(_rows, "v string, clique array<string>").withColumn("n", F.monotonically_increasing_id()), "cliques")
    # A larger clique has an earlier vertex next to all members: look among those before the member with the fewest.
    before = up.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k"))
    member = found.select("n", F.explode("clique").alias("id")).join(before, "id", "left")
    least = member.groupBy("n").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "id")).alias("m")).filter("m.k > 0").select("n", F.col("m.id").alias("u"))
    asked = least.join(up.select("u", F.col("v").alias("w")), "u").join(found.select("n", "clique"), "n").join(later.select(F.col("v").alias("w"), F.col("later").alias("near")), "w")
    inside = F.size(F.array_except("clique", "near")) == 0
    wider = asked.filter(inside).select("n").distinct()
    return found.join(wider, "n", "left_anti").select("clique", F.size("clique").alias("size"))


def clique_summary(cliques: DataFrame) -> DataFrame:
    """One row: how many there are, the clique number, the average size, and how many are of the largest size."""
    n = cliques.groupBy("size").agg(F.count("*").alias("n"))
    top = n.agg(F.max(F.struct("size", "n")).alias("m"), F.sum("n").alias("cliques"), F.sum(F.col("n") * F.col("size")).alias("s"))
    return top.select("cliques", F.col("m.size").alias("clique_number"), rounded(F.col("s") / F.col("cliques"), "avg_size"), F.col("m.n").alias("maximum_cliques"))


def clique_membership(cliques: DataFrame) -> DataFrame:
    """(id, cliques, largest) of every vertex."""
    return cliques.select(F.explode("clique").alias("id"), "size").groupBy("id").agg(F.count("*").alias("cliques"), F.max("size").alias("largest"))


def clique_overlap(cliques: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, shared): pairs of cliques of three or more, by their text, with at least ``least`` vertices in common;
    each pair meets at its shared vertices only."""
    name = F.array_join("clique", ",")
    at = cliques.filter("size >= 3").select(name.alias("a"), F.explode("clique").alias("id"))
    both = at.join(at.withColumnRenamed("a", "b"), "id").filter("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


#: Cliques grow by a vertex above their last one; maximal are those that no vertex is next to as a whole.
_CLIQUES = """nb AS MATERIALIZED (SELECT v, list(DISTINCT u ORDER BY u) AS near FROM s GROUP BY v),
cl(c, cand, around) AS (
  SELECT [v.id], coalesce(list_filter(near, lambda x: x > v.id), []::VARCHAR[]), coalesce(near, []::VARCHAR[]) FROM v LEFT JOIN nb ON nb.v = v.id
  UNION ALL SELECT list_append(c, x), list_filter(list_intersect(cand, near), lambda y: y > x), list_intersect(around, near) FROM (SELECT c, cand, around, unnest(cand) AS x FROM cl) JOIN nb ON nb.v = x),
mc AS MATERIALIZED (SELECT c AS clique, len(c)::INT AS size FROM cl WHERE len(around) = 0)"""

QUERIES = {
    "maximal_cliques": lambda s, d: maximal_cliques(co_part(s, d)).select(F.array_join("clique", ",").alias("clique"), "size"),
    "clique_summary": lambda s, d: clique_summary(maximal_cliques(user_seq(s, d))),
    "clique_membership": lambda s, d: clique_membership(maximal_cliques(user_seq(s, d))),
    "clique_overlap": lambda s, d: clique_overlap(maximal_cliques(co_part(s, d))),
}
SQL = {
    "maximal_cliques": sql("SELECT array_to_string(clique, ',') AS clique, size FROM mc", _CLIQUES),
    "clique_summary": user_sql("SELECT count(*) AS cliques, max(size) AS clique_number, round(sum(size) / count(*), 6) AS avg_size, (SELECT count(*) FROM mc WHERE size = (SELECT max(size) FROM mc)) AS maximum_cliques FROM mc", _CLIQUES),
    "clique_membership": user_sql("SELECT id, count(*) AS cliques, max(size) AS largest FROM (SELECT unnest(clique) AS id, size FROM mc) GROUP BY id", _CLIQUES),
    "clique_overlap": sql("SELECT a, b, count(*) AS shared FROM held x JOIN (SELECT a AS b, id FROM held) y USING (id) WHERE a < b GROUP BY a, b", _CLIQUES + ", held AS MATERIALIZED (SELECT array_to_string(clique, ',') AS a, unnest(clique) AS id FROM mc WHERE size >= 3)"),
}
