"""Samples and sparsifiers. Chance comes from the md5 of ids and a seed, so a sample is the same on
every run, at every partitioning and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.operators.iterative import _SEARCH, connected, levels, spanning_forest
from proxigraph.operators.paths import _BRANDES, _EDGE_DEP, brandes, bridges
from proxigraph.operators.subgraph import sparsify_threshold
from proxigraph.plans.graph import Graph, rounded, user_seq, user_sql
from proxigraph.plans.numbering import numbered
from proxigraph.plans.shared import materialize


def draw(seed: int, *ids: str) -> Column:
    """A number in [0, 1) for each row: the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *ids, F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def random_nodes(g: Graph, fraction: float, seed: int) -> Graph:
    """ceil(n * fraction) vertices and the edges among them."""
    n = math.ceil(g.vertices.count() * fraction)
    v = materialize(numbered(g.vertices.select("id", draw(seed, "id").alias("x")), [F.col("x"), F.col("id")], "i").filter(F.col("i") <= n).select("id"), "sample")
    e = g.edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(v, e)


def random_edges(g: Graph, fraction: float, seed: int) -> Graph:
    """ceil(m * fraction) edges and their ends."""
    m = math.ceil(g.edges.count() * fraction)
    e = numbered(g.edges.withColumn("x", draw(seed, "src", "dst")), [F.col("x"), F.col("src"), F.col("dst")], "i").filter(F.col("i") <= m).drop("x", "i")
    return Graph(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e)


def snowball(g: Graph, fraction: float, seeds: list[str]) -> Graph:
    """The ceil(n * fraction) vertices nearest to the seeds by hops, ties by id, and their edges."""
    n = math.ceil(g.vertices.count() * fraction)
    near = levels(g, g.vertices.filter(F.col("id").isin(seeds)).select("id", F.lit("").alias("source"))).select("id", "hops")
    v = materialize(numbered(near, [F.col("hops"), F.col("id")], "i").filter(F.col("i") <= n).select("id"), "snowball")
    return Graph(v, g.edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi"))


def sparsify_random(g: Graph, keep: float, seed: int) -> Graph:
    return Graph(g.vertices, g.edges.filter(draw(seed, "src", "dst") < keep))


def sparsify_tree(g: Graph) -> Graph:
    """The edges of the minimum spanning forest."""
    return Graph(g.vertices, g.edges.join(spanning_forest(g).select("src", "dst"), ["src", "dst"], "left_semi"))


def edge_importance(g: Graph) -> DataFrame:
    """(src, dst, importance): half for a bridge, three tenths by betweenness, a fifth by low degrees."""
    b = materialize(brandes(g)[1], "importance")
    top = b.agg(F.max("betweenness").alias("top_b"))
    d = materialize(g.degrees(), "importance-degrees")
    top_d = d.agg(F.max("degree").alias("top_d"))
    of = lambda c: d.select(F.col("id").alias(c), F.col("degree").alias(f"{c}_d"))
    x = b.join(bridges(g).withColumn("bridge", F.lit(1)), ["src", "dst"], "left").join(of("src"), "src").join(of("dst"), "dst").join(F.broadcast(top)).join(F.broadcast(top_d))
    share = F.when(F.col("top_b") > 0, F.col("betweenness") / F.col("top_b")).otherwise(0.0)
    low = 1 - (F.col("src_d") + F.col("dst_d")) / 2 / F.greatest("top_d", F.lit(1))
    return x.select("src", "dst", rounded(F.least(F.lit(1.0), 0.5 * F.coalesce("bridge", F.lit(0)) + 0.3 * share + 0.2 * low), "importance"))


def sparsify_importance(g: Graph, keep: float) -> DataFrame:
    """(src, dst): the ceil(m * keep) edges of greatest importance, ties by ends."""
    m = math.ceil(g.edges.count() * keep)
    return numbered(edge_importance(g), [F.desc("importance"), F.col("src"), F.col("dst")], "i").filter(F.col("i") <= m).select("src", "dst")


def quality(g: Graph, sparse: Graph) -> DataFrame:
    """One row: share of edges gone, components before and after, densities, correlation of degrees."""
    a = g.edges.agg(F.count("*").alias("m")).join(sparse.edges.agg(F.count("*").alias("k"))).join(g.vertices.agg(F.count("*").alias("n")))
    c = lambda x, name: connected(x).agg(F.count_distinct("component").alias(name))
    d = g.degrees().join(sparse.degrees().withColumnRenamed("degree", "left"), "id").agg(F.corr(F.col("degree").cast("double"), F.col("left").cast("double")).alias("r"))
    x = a.join(c(g, "components")).join(c(sparse, "components_left")).join(d)  # one row each
    dense = lambda k: F.when(F.col("n") > 1, 2.0 * F.col(k) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return x.select(rounded(F.when(F.col("m") > 0, 1 - F.col("k") / F.col("m")).otherwise(0.0), "edge_reduction"), "components", "components_left", rounded(dense("m"), "density"), rounded(dense("k"), "density_left"), rounded(F.coalesce("r", F.lit(0.0)), "degree_correlation"))


def _named(f):
    def run(s: SparkSession, d: str) -> DataFrame:
        return f(user_seq(s, d)).edges.select("src", "dst", "weight")

    return run


_X = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_PICK = "pick AS (SELECT id FROM v ORDER BY " + _X.format("id || '|7'") + ", id LIMIT ceil((SELECT count(*) FROM v) * 0.4)::INT)"
_NEAR = _SEARCH.format("'u1', 'u4'") + ", pick AS (SELECT id FROM (SELECT id, min(hops) AS h FROM b GROUP BY id) ORDER BY h, id LIMIT ceil((SELECT count(*) FROM v) * 0.3)::INT)"
_CUT = "cut(a, b, id) AS (SELECT src, dst, src FROM e UNION SELECT cut.a, cut.b, s.u FROM cut JOIN e ON e.src = cut.a AND e.dst = cut.b JOIN s ON s.v = cut.id AND (s.weight, least(s.v, s.u), greatest(s.v, s.u)) < (e.weight, e.src, e.dst)), tree AS (SELECT src, dst, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM cut WHERE a = src AND b = dst AND id = dst))"
_IMPORTANCE = _BRANDES + ", " + _EDGE_DEP + """, cuts(a, b, id) AS (SELECT src, dst, src FROM e UNION SELECT cuts.a, cuts.b, s.u FROM cuts JOIN s ON s.v = cuts.id AND NOT (s.v = cuts.a AND s.u = cuts.b) AND NOT (s.v = cuts.b AND s.u = cuts.a)),
eb AS MATERIALIZED (SELECT e.src, e.dst, coalesce(b, 0) AS b, (NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.a = e.src AND cuts.b = e.dst AND cuts.id = e.dst))::INT AS bridge FROM e LEFT JOIN eflow q ON q.src = e.src AND q.dst = e.dst),
dg AS (SELECT v AS id, count(*) AS d FROM s GROUP BY v),
imp AS (SELECT src, dst, round(least(1.0, 0.5 * bridge + 0.3 * CASE WHEN (SELECT max(b) FROM eb) > 0 THEN b / (SELECT max(b) FROM eb) ELSE 0 END + 0.2 * (1 - (x.d + y.d) / 2 / (SELECT max(d) FROM dg))), 6) AS importance FROM eb JOIN dg x ON x.id = src JOIN dg y ON y.id = dst)"""
_INSIDE = "SELECT src, dst, weight FROM e WHERE src IN (SELECT id FROM pick) AND dst IN (SELECT id FROM pick)"
QUERIES = {
    "sample_nodes": _named(lambda g: random_nodes(g, 0.4, 7)),
    "sample_edges": _named(lambda g: random_edges(g, 0.3, 5)),
    "sample_snowball": _named(lambda g: snowball(g, 0.3, ["u1", "u4"])),
    "sparsify_random": _named(lambda g: sparsify_random(g, 0.5, 3)),
    "sparsify_spanning_tree": _named(sparsify_tree),
    "mst_users": lambda s, d: spanning_forest(user_seq(s, d)),
    "edge_importance": lambda s, d: edge_importance(user_seq(s, d)),
    "sparsify_importance": lambda s, d: sparsify_importance(user_seq(s, d), 0.4),
    "sparsifier_quality": lambda s, d: (lambda g: quality(g, Graph(g.vertices, sparsify_threshold(g, 3))))(user_seq(s, d)),
}
SQL = {
    "sample_nodes": user_sql(_INSIDE, _PICK),
    "sample_edges": user_sql("SELECT src, dst, weight FROM e ORDER BY " + _X.format("src || '|' || dst || '|5'") + ", src, dst LIMIT ceil((SELECT count(*) FROM e) * 0.3)::INT"),
    "sample_snowball": user_sql(_INSIDE, _NEAR),
    "sparsify_random": user_sql("SELECT src, dst, weight FROM e WHERE " + _X.format("src || '|' || dst || '|3'") + " < 0.5"),
    "sparsify_spanning_tree": user_sql("SELECT * FROM tree", _CUT),
    "mst_users": user_sql("SELECT * FROM tree", _CUT),
    "edge_importance": user_sql("SELECT src, dst, importance FROM imp", _IMPORTANCE),
    "sparsify_importance": user_sql("SELECT src, dst FROM imp ORDER BY importance DESC, src, dst LIMIT ceil((SELECT count(*) FROM e) * 0.4)::INT", _IMPORTANCE),
    "sparsifier_quality": user_sql(
        "SELECT round(1 - (SELECT count(*) FROM k) / (SELECT count(*) FROM e), 6) AS edge_reduction, (SELECT count(DISTINCT c) FROM (SELECT id, min(c) AS c FROM ra GROUP BY id)) AS components, (SELECT count(DISTINCT c) FROM (SELECT id, min(c) AS c FROM rb GROUP BY id)) AS components_left,"
        " round(2 * (SELECT count(*) FROM e) / (n * (n - 1)), 6) AS density, round(2 * (SELECT count(*) FROM k) / (n * (n - 1)), 6) AS density_left, (SELECT round(coalesce(corr(a, b), 0), 6) FROM (SELECT (SELECT count(*) FROM s WHERE s.v = v.id)::DOUBLE AS a, (SELECT count(*) FROM sk WHERE sk.v = v.id)::DOUBLE AS b FROM v)) AS degree_correlation FROM (SELECT count(*) AS n FROM v)",
        "k AS (SELECT * FROM e WHERE weight >= 3), sk AS (SELECT src AS v, dst AS u FROM k UNION ALL SELECT dst, src FROM k), ra(id, c) AS (SELECT id, id FROM v UNION SELECT s.u, ra.c FROM ra JOIN s ON s.v = ra.id), rb(id, c) AS (SELECT id, id FROM v UNION SELECT sk.u, rb.c FROM rb JOIN sk ON sk.v = rb.id)",
    ),
}
