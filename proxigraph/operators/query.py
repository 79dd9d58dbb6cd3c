"""Chainable node and edge queries: predicates gather on a lazy plan, nothing runs before an action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxigraph.plans.graph import Graph, co_part, sql

MAX_PATTERN = 500  # characters of a regular expression


def full_match(c: Column, pattern: str) -> Column:
    """The whole value matches; longer patterns than MAX_PATTERN are refused."""
    if pattern is None or len(pattern) > MAX_PATTERN:
        raise ValueError(f"a pattern of at most {MAX_PATTERN} characters is needed")
    return c.rlike(f"^(?:{pattern})$")


def active_at(t: int) -> Column:
    """Untimed edges always are; one without an end is a point; ends are included."""
    return F.col("ts").isNull() | (F.col("end_ts").isNull() & (F.col("ts") == t)) | (F.col("ts") <= t) & (F.col("end_ts") >= t)


def active_during(start: int, end: int) -> Column:
    return F.col("ts").isNull() | ((F.col("ts") <= end) & (F.coalesce("end_ts", "ts") >= start))


class NodeQuery:
    def __init__(self, g: Graph, df: DataFrame | None = None):
        self.g, self.df = g, df if df is not None else g.degrees()

    def _with(self, condition: Column) -> NodeQuery:
        return NodeQuery(self.g, self.df.filter(condition))

    def with_min_degree(self, n: int) -> NodeQuery:
        return self._with(F.col("degree") >= n)

    def with_max_degree(self, n: int) -> NodeQuery:
        return self._with(F.col("degree") <= n)

    def with_degree(self, n: int) -> NodeQuery:
        return self._with(F.col("degree") == n)

    def matching(self, pattern: str) -> NodeQuery:
        return self._with(full_match(F.col("id"), pattern))

    def containing(self, part: str) -> NodeQuery:
        return self._with(F.lower("id").contains(part.lower()))

    def in_set(self, ids) -> NodeQuery:
        """Ids as a short list or as a table with a column id."""
        return NodeQuery(self.g, self.df.join(ids.select("id"), "id", "left_semi")) if isinstance(ids, DataFrame) else self._with(F.col("id").isin(list(ids)))

    def connected_by_type(self, kind: str) -> NodeQuery:
        return NodeQuery(self.g, self.df.join(self.g.both("type").filter(F.col("type") == kind).select(F.col("v").alias("id")), "id", "left_semi"))

    def neighbors_of(self, node: str) -> NodeQuery:
        return NodeQuery(self.g, self.df.join(self.g.both().filter(F.col("u") == node).select(F.col("v").alias("id")), "id", "left_semi"))

    def isolated(self) -> NodeQuery:
        return self._with(F.col("degree") == 0)

    def leaves(self) -> NodeQuery:
        return self._with(F.col("degree") == 1)

    def where(self, condition: Column) -> NodeQuery:
        return self._with(condition)

    def results(self) -> DataFrame:
        return self.df.select("id")

    def count(self) -> int:
        return self.df.count()

    def sorted_by_degree(self) -> DataFrame:
        return self.df.orderBy(F.desc("degree"), "id")


class EdgeQuery:
    def __init__(self, g: Graph, df: DataFrame | None = None):
        self.g, self.df = g, df if df is not None else g.edges

    def _with(self, condition: Column) -> EdgeQuery:
        return EdgeQuery(self.g, self.df.filter(condition))

    def of_type(self, kind: str) -> EdgeQuery:
        return self._with(F.col("type") == kind)

    def with_min_weight(self, w: float) -> EdgeQuery:
        return self._with(F.col("weight") >= w)

    def with_max_weight(self, w: float) -> EdgeQuery:
        return self._with(F.col("weight") <= w)

    def between_nodes(self, ids) -> EdgeQuery:
        if isinstance(ids, DataFrame):
            one = ids.select("id").distinct()
            return EdgeQuery(self.g, self.df.join(one.withColumnRenamed("id", "src"), "src", "left_semi").join(one.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        return self._with(F.col("src").isin(list(ids)) & F.col("dst").isin(list(ids)))

    def incident_to(self, node: str) -> EdgeQuery:
        return self._with((F.col("src") == node) | (F.col("dst") == node))

    def label_matching(self, pattern: str) -> EdgeQuery:
        return self._with(F.col("label").isNotNull() & full_match(F.col("label"), pattern))

    def active_at(self, t: int) -> EdgeQuery:
        return self._with(active_at(t))

    def active_during(self, start: int, end: int) -> EdgeQuery:
        return self._with(active_during(start, end))

    def temporal(self) -> EdgeQuery:
        return self._with(F.col("ts").isNotNull())

    def where(self, condition: Column) -> EdgeQuery:
        return self._with(condition)

    def results(self) -> DataFrame:
        """Edges are equal by type, ends and weight; label and times do not count."""
        return self.df.dropDuplicates(["type", "src", "dst", "weight"])

    def count(self) -> int:
        return self.results().count()

    def sorted_by_weight(self) -> DataFrame:
        return self.results().orderBy(F.desc("weight"), "src", "dst")

    def type_breakdown(self) -> DataFrame:
        return self.df.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


class GraphQueryEngine:
    def __init__(self, g: Graph):
        if g is None:
            raise ValueError("a graph is needed")
        self.g = g

    def nodes(self) -> NodeQuery:
        return NodeQuery(self.g)

    def edges(self) -> EdgeQuery:
        return EdgeQuery(self.g)

    def stats(self) -> DataFrame:
        d = self.g.degrees().agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"))
        return d


_T = 800_000_000_000


def _nodes(f):
    return lambda s, d: f(GraphQueryEngine(co_part(s, d)).nodes()).results()


def _edges(f):
    return lambda s, d: f(GraphQueryEngine(co_part(s, d)).edges()).results().select("src", "dst", "type", "weight")


_E = "SELECT src, dst, type, weight FROM e WHERE "
QUERIES = {
    "nodes_min_degree": _nodes(lambda q: q.with_min_degree(3)),
    "nodes_max_degree": _nodes(lambda q: q.with_max_degree(1)),
    "nodes_exact_degree": _nodes(lambda q: q.with_degree(2)),
    "nodes_regex": _nodes(lambda q: q.matching("p[0-9]*7")),
    "nodes_containing": _nodes(lambda q: q.containing("P1")),
    "nodes_in_set": _nodes(lambda q: q.in_set(["p1", "p2", "p999999"])),
    "nodes_by_type": _nodes(lambda q: q.connected_by_type("fs")),
    "nodes_neighbors_of": _nodes(lambda q: q.neighbors_of("p1")),
    "nodes_isolated": _nodes(lambda q: q.isolated()),
    "nodes_leaves": _nodes(lambda q: q.leaves()),
    "nodes_where": _nodes(lambda q: q.with_min_degree(1).where(F.length("id") == 3)),
    "nodes_sorted_by_degree": lambda s, d: GraphQueryEngine(co_part(s, d)).nodes().sorted_by_degree(),
    "edges_of_type": _edges(lambda q: q.of_type("c")),
    "edges_weight_range": _edges(lambda q: q.with_min_weight(2).with_max_weight(3)),
    "edges_between": _edges(lambda q: q.between_nodes(q.g.degrees().filter("degree >= 4"))),
    "edges_incident": _edges(lambda q: q.incident_to("p1")),
    "edges_label_regex": _edges(lambda q: q.label_matching(".*[12]")),
    "edges_active_at": _edges(lambda q: q.active_at(_T)),
    "edges_active_during": _edges(lambda q: q.active_during(_T, _T + 10**10)),
    "edges_where": _edges(lambda q: q.where((F.col("weight") > 2) | (F.length("label") < 8))),
    "edges_sorted_by_weight": lambda s, d: GraphQueryEngine(co_part(s, d)).edges().with_min_weight(3).sorted_by_weight().select("src", "dst", "weight"),
    "node_count": lambda s, d: GraphQueryEngine(co_part(s, d)).nodes().with_min_degree(2).results().agg(F.count("*").alias("nodes")),
    "edges_temporal": _edges(lambda q: q.temporal()),
    "type_breakdown": lambda s, d: GraphQueryEngine(co_part(s, d)).edges().type_breakdown(),
    "query_stats": lambda s, d: GraphQueryEngine(co_part(s, d)).stats(),
}
SQL = {
    "nodes_min_degree": sql("SELECT id FROM d WHERE degree >= 3"),
    "nodes_max_degree": sql("SELECT id FROM d WHERE degree <= 1"),
    "nodes_exact_degree": sql("SELECT id FROM d WHERE degree = 2"),
    "nodes_regex": sql("SELECT id FROM v WHERE regexp_full_match(id, 'p[0-9]*7')"),
    "nodes_containing": sql("SELECT id FROM v WHERE contains(lower(id), 'p1')"),
    "nodes_in_set": sql("SELECT id FROM v WHERE id IN ('p1', 'p2', 'p999999')"),
    "nodes_by_type": sql("SELECT id FROM v WHERE id IN (SELECT v FROM s WHERE type = 'fs')"),
    "nodes_neighbors_of": sql("SELECT id FROM v WHERE id IN (SELECT v FROM s WHERE u = 'p1')"),
    "nodes_isolated": sql("SELECT id FROM v WHERE id NOT IN (SELECT v FROM s)"),
    "nodes_leaves": sql("SELECT id FROM d WHERE degree = 1"),
    "nodes_where": sql("SELECT id FROM d WHERE degree >= 1 AND length(id) = 3"),
    "nodes_sorted_by_degree": sql("SELECT id, degree FROM d"),
    "edges_of_type": sql(_E + "type = 'c'"),
    "edges_weight_range": sql(_E + "weight BETWEEN 2 AND 3"),
    "edges_between": sql(_E + "src IN (SELECT id FROM d WHERE degree >= 4) AND dst IN (SELECT id FROM d WHERE degree >= 4)"),
    "edges_incident": sql(_E + "src = 'p1' OR dst = 'p1'"),
    "edges_label_regex": sql(_E + "regexp_full_match(label, '.*[12]')"),
    "edges_active_at": sql(_E + f"ts <= {_T} AND end_ts >= {_T}"),
    "edges_active_during": sql(_E + f"ts <= {_T + 10**10} AND end_ts >= {_T}"),
    "edges_where": sql(_E + "weight > 2 OR length(label) < 8"),
    "edges_sorted_by_weight": sql("SELECT src, dst, weight FROM e WHERE weight >= 3"),
    "node_count": sql("SELECT count(*) AS nodes FROM d WHERE degree >= 2"),
    "edges_temporal": sql(_E + "ts IS NOT NULL"),
    "type_breakdown": sql("SELECT type, count(*) AS n FROM e GROUP BY type"),
    "query_stats": sql("SELECT count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree FROM d"),
}
