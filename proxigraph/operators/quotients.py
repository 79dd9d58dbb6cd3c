"""Compressed graphs: vertices become members of groups, groups the vertices of a smaller graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.operators.iterative import levels
from proxigraph.operators.rounds import independent_set
from proxigraph.operators.signs import brands, similar_above
from proxigraph.plans.graph import Graph, co_part, rounded, sql
from proxigraph.plans.shared import drop, materialize

UNASSIGNED = "__unassigned__"  # fixed value: the group of vertices without a label


def by_attribute(g: Graph, labels: DataFrame) -> DataFrame:
    """(id, grp): vertices with the same label; those with none, or a null one, are one group."""
    l = labels.groupBy("id").agg(F.min("label").alias("label"))  # noqa: E741
    return g.vertices.join(l, "id", "left").select("id", F.coalesce("label", F.lit(UNASSIGNED)).alias("grp"))


def by_similarity(g: Graph, threshold: float) -> DataFrame:
    """(id, grp): in order of degree, then id, each vertex that no group has yet opens one and takes
    all later ones whose neighbourhoods have a Jaccard of ``threshold`` or more; grp is the first vertex.

    First vertices are the greedy independent set of the graph of similar pairs, and every other
    joins the first of those next to it, so nothing passes through one task. Vertices without
    neighbours are alike. ``threshold`` has to be above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    d = materialize(g.degrees(), "alike-degrees")
    pairs = materialize(similar_above(g, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst")), "alike")
    some = Graph(d.filter("degree > 0").select("id"), pairs)
    place = lambda x: d.select(F.col("id").alias(x), F.struct("degree", F.col("id").alias("i")).alias(f"k_{x}"))
    first = materialize(independent_set(some, d.select("id", "degree")), "alike-first")
    near = some.both().join(first.withColumnRenamed("id", "u"), "u").join(place("u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("k_u").getField("i").alias("grp"))
    lone = d.filter("degree = 0").select("id")
    all_lone = lone.join(F.broadcast(lone.agg(F.min("id").alias("grp"))))  # a row
    rest = d.filter("degree > 0").select("id").join(first.select("id", F.col("id").alias("mine")), "id", "left").join(near, "id", "left")
    return rest.select("id", F.coalesce("mine", "grp").alias("grp")).unionByName(all_lone)


def by_hops(g: Graph, seeds: DataFrame, k: int) -> DataFrame:
    """(id, grp): in the order of ``seeds`` (id, place), each seed that no one has taken yet takes what lies
    within ``k`` hops, over vertices not taken; the rest are groups of their own. Unknown seeds are left out.

    Balls of all open seeds grow at once. A seed that is the first in every vertex of its ball takes
    it, as no earlier seed can reach there any more; the others try again without these vertices.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    open_ = materialize(g.vertices.join(seeds.groupBy("id").agg(F.min("place").alias("place")), "id").select("id", "place"), "seeds")
    vertices, edges, taken = g.vertices.select("id"), g.edges.select("src", "dst"), []
    while not open_.isEmpty():
        at = open_.select(F.col("id").alias("source"), F.struct("place", F.col("id").alias("i")).alias("key"))
        ball = materialize(levels(Graph(vertices, edges), open_.select("id", F.col("id").alias("source")), most=k).join(at, "source").select("id", "source", "key"), "balls")
        best = ball.groupBy("id").agg(F.min("key").alias("best"))
        late = ball.join(best, "id").filter("key > best").select("source").distinct()
        now = materialize(ball.join(late, "source", "left_anti").select("id", F.col("source").alias("grp")), "ball-taken")
        taken.append(now)
        gone = now.select("id")
        vertices = materialize(vertices.join(gone, "id", "left_anti"), "untaken")
        edges = materialize(edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "untaken-edges")
        rest = materialize(open_.join(gone, "id", "left_anti"), "seeds")
        drop(open_)
        open_ = rest
    return reduce(DataFrame.unionByName, taken, vertices.select("id", F.col("id").alias("grp")))


def super_edges(g: Graph, groups: DataFrame) -> DataFrame:
    """(a, b, edges, weight) with a < b: edges between two groups, how many they are and their weight."""
    of = lambda x, y: groups.select(F.col("id").alias(x), F.col("grp").alias(y))
    e = g.edges.select("src", "dst", "weight").join(of("src", "x"), "src").join(of("dst", "y"), "dst").filter("x <> y")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def reduction(g: Graph, groups: DataFrame) -> DataFrame:
    """One row: vertices and edges before and after, and by how many percent there are less."""
    n = groups.agg(F.count("*").alias("vertices"), F.count_distinct("grp").alias("groups"))
    m, k = g.edges.agg(F.count("*").alias("edges")), super_edges(g, groups).agg(F.count("*").alias("super_edges"))
    less = lambda a, b: F.when(F.col(a) > 0, 100.0 * (F.col(a) - F.col(b)) / F.col(a)).otherwise(0.0)
    x = n.join(F.broadcast(m)).join(F.broadcast(k))  # a row each
    return x.select("vertices", "groups", "edges", "super_edges", rounded(less("vertices", "groups"), "vertices_less", 4), rounded(less("edges", "super_edges"), "edges_less", 4))


_T, _HOPS = 0.5, 2
_SEEDS = ("p3", "p1", "p20", "p7")


def _groups(f):
    def run(s, d, then):
        g = co_part(s, d)
        return then(g, materialize(f(s, d, g), "groups"))

    return run


def _seeds(s):
    return s.createDataFrame(list(enumerate(_SEEDS)), "place int, id string")


_ATTRIBUTE = _groups(lambda s, d, g: by_attribute(g, brands(s, d).filter("label <> 'Brand#11'")))
_ALIKE = _groups(lambda s, d, g: by_similarity(g, _T))
_NEAR = _groups(lambda s, d, g: by_hops(g, _seeds(s), _HOPS))
QUERIES = {
    "quotient_attribute": lambda s, d: _ATTRIBUTE(s, d, super_edges),
    "quotient_attribute_reduction": lambda s, d: _ATTRIBUTE(s, d, reduction),
    "quotient_similarity": lambda s, d: _ALIKE(s, d, lambda g, x: x),
    "quotient_similarity_edges": lambda s, d: _ALIKE(s, d, super_edges),
    "quotient_khop": lambda s, d: _NEAR(s, d, lambda g, x: x),
    "quotient_khop_edges": lambda s, d: _NEAR(s, d, super_edges),
}
_EDGES = "SELECT least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, count(*) AS edges, sum(weight) AS weight FROM e JOIN gp x ON x.id = src JOIN gp y ON y.id = dst WHERE x.grp <> y.grp GROUP BY 1, 2"
_AT = f"gp AS MATERIALIZED (SELECT 'p' || p_partkey AS id, CASE WHEN p_brand <> 'Brand#11' THEN p_brand ELSE '{UNASSIGNED}' END AS grp FROM part)"


def _khop_sql() -> str:
    """Seeds one after the other, each a search over what those before have left."""
    out = ["t0 AS (SELECT '' AS id, '' AS grp WHERE false)"]
    for i, seed in enumerate(_SEEDS):
        out.append(f"k{i}(id, h) AS (SELECT id, 0 FROM v WHERE id = '{seed}' AND id NOT IN (SELECT id FROM t{i}) UNION SELECT s.u, h + 1 FROM k{i} JOIN s ON s.v = k{i}.id WHERE h < {_HOPS} AND s.u NOT IN (SELECT id FROM t{i}))")
        out.append(f"t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} UNION ALL SELECT DISTINCT id, '{seed}' FROM k{i})")
    n = len(_SEEDS)
    return ", ".join(out) + f", gp AS MATERIALIZED (SELECT v.id, coalesce(grp, v.id) AS grp FROM v LEFT JOIN t{n} ON t{n}.id = v.id)"


SQL = {
    "quotient_attribute": sql(_EDGES, _AT),
    "quotient_attribute_reduction": sql(f"SELECT *, round(100.0 * (vertices - groups) / vertices, 4) AS vertices_less, round(100.0 * (edges - super_edges) / edges, 4) AS edges_less FROM (SELECT count(*) AS vertices, count(DISTINCT grp) AS groups FROM gp), (SELECT count(*) AS edges FROM e), (SELECT count(*) AS super_edges FROM ({_EDGES}))", _AT),
    "quotient_khop": sql("SELECT id, grp FROM gp", _khop_sql()),
    "quotient_khop_edges": sql(_EDGES, _khop_sql()),
}
