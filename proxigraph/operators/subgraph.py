"""Subgraphs, snapshots and windows in time, differences, merges, products and sparsification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxigraph.operators.query import active_at, active_during
from proxigraph.plans.graph import Graph, co_part, rounded, sql, user_seq, user_sql
from proxigraph.plans.shared import materialize


def induced(g: Graph, ids: DataFrame) -> Graph:
    one = ids.select("id").distinct()
    e = g.edges.join(one.withColumnRenamed("id", "src"), "src", "left_semi").join(one.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(g.vertices.join(one, "id", "left_semi"), e.select(*g.edges.columns))


def extract(g: Graph, types=None, min_weight=None, max_weight=None, during=None, ids: DataFrame | None = None, degree=None, connected_only: bool = False) -> Graph:
    """Edge filters, then the induced graph, then one pass by degree on the result (not iterated)."""
    e = g.edges
    if types:
        e = e.filter(F.lower("type").isin([t.lower() for t in types]))
    if min_weight is not None:
        e = e.filter(F.col("weight") >= min_weight)
    if max_weight is not None:
        e = e.filter(F.col("weight") <= max_weight)
    if during:
        e = e.filter(active_during(*during))
    out = Graph(g.vertices, e)
    if ids is not None:
        out = induced(out, ids)
    if degree:
        out = induced(out, out.degrees().filter(F.col("degree").between(*degree)))
    if connected_only:
        out = Graph(out.degrees().filter("degree > 0").select("id"), out.edges)
    return out


def ends(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def snapshot(g: Graph, t: int) -> Graph:
    e = g.edges.filter(active_at(t))
    return Graph(ends(e), e)


def window(g: Graph, start: int, end: int) -> Graph:
    if start > end:
        raise ValueError("the window ends before it starts")
    e = g.edges.filter(active_during(start, end))
    return Graph(ends(e), e)


def time_points(g: Graph) -> DataFrame:
    return g.edges.select(F.explode(F.array("ts", "end_ts")).alias("t")).filter("t is not null").distinct()


def windows(g: Graph, k: int) -> DataFrame:
    """(w, ws, we): k windows of equal width over all stamps; the last ends at the latest."""
    r = g.edges.agg(F.min("ts").alias("lo"), F.max(F.coalesce("end_ts", "ts")).alias("hi"))
    width = F.greatest(F.lit(1).cast("long"), F.floor((F.col("hi") - F.col("lo") + 1) / k).cast("long"))
    w = r.filter("lo is not null").select("lo", "hi", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("w"))
    return w.select("w", (F.col("lo") + F.col("w") * F.col("width")).alias("ws"), F.when(F.col("w") == k - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("w") + 1) * F.col("width") - 1).alias("we"))


def in_windows(g: Graph, k: int) -> DataFrame:
    """(w, src, dst): edges of each window; a table of k rows is joined by overlap."""
    return g.edges.join(F.broadcast(windows(g, k)), F.col("ts").isNull() | ((F.col("ts") <= F.col("we")) & (F.coalesce("end_ts", "ts") >= F.col("ws")))).select("w", "src", "dst")


def persistence(g: Graph, k: int) -> DataFrame:
    share = F.col("n") / k
    n = in_windows(g, k).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.select("src", "dst", rounded(share, "share"), F.when(share >= 0.75, "PERSISTENT").when(share >= 0.25, "PERIODIC").otherwise("TRANSIENT").alias("kind"))


def growth(g: Graph, k: int) -> DataFrame:
    """Vertices, edges and density of each window."""
    e = in_windows(g, k)
    n = e.select("w", F.explode(F.array("src", "dst")).alias("id")).groupBy("w").agg(F.count_distinct("id").alias("n"))
    m = e.groupBy("w").agg(F.count("*").alias("m"))
    return m.join(n, "w").select("w", "n", "m", rounded(F.when(F.col("n") > 1, 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), "density"))


def growth_rate(g: Graph, k: int) -> DataFrame:
    return growth(g, k).agg(rounded(F.coalesce(F.regr_slope(F.col("m").cast("double"), F.col("w").cast("double")), F.lit(0.0)), "slope", 4))


def timeline(g: Graph, k: int) -> DataFrame:
    """Edges that are new or lost against the window before: presence by window, compared by lag."""
    e = in_windows(g, k).select("w", "src", "dst")
    there = e.withColumn("prev", F.lag("w").over(Window.partitionBy("src", "dst").orderBy("w")))
    new = there.groupBy("w").agg(F.count("*").alias("edges"), F.sum(F.when(F.col("prev").isNull() | (F.col("prev") < F.col("w") - 1), 1).otherwise(0)).alias("new_edges"))
    w = Window.orderBy("w")
    return new.select("w", "edges", "new_edges", (F.coalesce(F.lag("edges").over(w), F.lit(0)) - (F.col("edges") - F.col("new_edges"))).alias("lost_edges"))


def trends(g: Graph, k: int) -> DataFrame:
    """Relative change of edges against the window before; a phase transition above 0.3."""
    w = Window.orderBy("w")
    x = growth(g, k).withColumn("prev", F.lag("m").over(w))
    change = (F.col("m") - F.col("prev")) / F.col("prev")
    return x.select("w", "m", rounded(change, "change"), F.when(change > 0.3, "growth_spike").when(change < -0.3, "contraction").alias("transition"))


def baseline(g: Graph, k: int) -> DataFrame:
    """Density against mean and population deviation of all windows before."""
    before = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    x = growth(g, k).withColumns({"mean": F.avg("density").over(before), "sd": F.stddev_pop("density").over(before)})
    return x.select("w", "density", rounded("mean", "mean"), rounded("sd", "sd"), (F.abs(F.col("density") - F.col("mean")) > F.greatest(2 * F.col("sd"), F.lit(0.01))).alias("anomaly"))


def forecast(g: Graph, k: int, horizon: int = 3) -> DataFrame:
    a = growth(g, k).agg(F.regr_slope(F.col("m").cast("double"), F.col("w").cast("double")).alias("b"), F.regr_intercept(F.col("m").cast("double"), F.col("w").cast("double")).alias("a"))
    return a.select(F.explode(F.sequence(F.lit(k), F.lit(k + horizon - 1))).alias("w"), "a", "b").select("w", rounded(F.col("a") + F.col("b") * F.col("w"), "edges", 4))


def _pairs(g: Graph) -> DataFrame:
    return g.edges.select("src", "dst", "weight")


def diff(a: Graph, b: Graph) -> DataFrame:
    """One row: added, removed and common vertices and edges, Jaccard of edges, edit distance."""

    def count(x: DataFrame, y: DataFrame, keys: list[str], what: str) -> DataFrame:
        both = x.select(*keys, F.lit(1).alias("l")).join(y.select(*keys, F.lit(1).alias("r")), keys, "full")
        n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
        l, r = F.col("l").isNotNull(), F.col("r").isNotNull()  # noqa: E741
        return both.agg(n(~l & r).alias(f"added_{what}"), n(l & ~r).alias(f"removed_{what}"), n(l & r).alias(f"common_{what}"))

    x = count(a.vertices, b.vertices, ["id"], "nodes").join(count(a.edges, b.edges, ["src", "dst"], "edges"))
    total = F.col("added_edges") + F.col("removed_edges") + F.col("common_edges")
    return x.withColumn("jaccard", F.round(F.when(total > 0, F.col("common_edges") / total).otherwise(1.0), 6)).withColumn("edit_distance", F.col("added_nodes") + F.col("removed_nodes") + F.col("added_edges") + F.col("removed_edges"))


def conflict(left, right, rule: str):
    return {"KEEP_LEFT": left, "KEEP_RIGHT": right, "MAX": F.greatest(left, right), "MIN": F.least(left, right), "SUM": left + right, "AVERAGE": (left + right) / 2}[rule]


def merge(a: Graph, b: Graph, how: str = "union", rule: str = "KEEP_LEFT") -> DataFrame:
    """(src, dst, weight) of union, intersection, symdiff, left or right."""
    if how == "right":
        return merge(b, a, "left", rule)
    x, y = _pairs(a), _pairs(b).withColumnRenamed("weight", "other")
    if how == "intersection":
        return x.join(y, ["src", "dst"]).select("src", "dst", conflict(F.col("weight"), F.col("other"), rule).alias("weight"))
    if how == "left":
        y = Graph(b.vertices, y)
        y = induced(y, a.vertices).edges
    both = x.join(y, ["src", "dst"], "full")
    if how == "symdiff":
        both = both.filter(F.col("weight").isNull() | F.col("other").isNull())
    w = F.when(F.col("weight").isNull(), F.col("other")).when(F.col("other").isNull(), F.col("weight")).otherwise(conflict(F.col("weight"), F.col("other"), rule))
    return both.select("src", "dst", w.alias("weight"))


def complement(g: Graph, block: int = 1024) -> DataFrame:
    """All non-adjacent pairs, as many as the square of the vertices. Each vertex meets blocks of some ``block`` vertices,
    with its neighbours in a block beside it, so pairs are only made after the joins and are never shuffled."""
    n = -(-g.vertices.count() // block) or 1
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).alias("at")
    v = materialize(g.vertices.select("id"), "complement")
    blocks = v.groupBy(at("id")).agg(F.collect_list("id").alias("ids"))
    near = g.edges.groupBy("src", at("dst")).agg(F.collect_list("dst").alias("near"))
    met = v.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("at"))
    rest = F.array_except("ids", F.coalesce("near", F.array().cast("array<string>")))
    return met.join(near, ["src", "at"], "left").join(blocks, "at").select("src", F.explode(rest).alias("dst")).filter("src < dst")


def ball(g: Graph, seed: str, k: int) -> DataFrame:
    """(id, hops) within k hops: one join of the frontier for each hop."""
    seen = g.vertices.filter(F.col("id") == seed).select("id", F.lit(0).alias("hops"))
    s = g.both()
    for h in range(1, k + 1):
        nxt = seen.filter(F.col("hops") == h - 1).join(s, F.col("id") == F.col("v")).select(F.col("u").alias("id")).distinct()
        seen = materialize(seen.unionByName(nxt.join(seen, "id", "left_anti").withColumn("hops", F.lit(h))), "ball")
    return seen


def sparsify_local(g: Graph, k: int) -> DataFrame:
    """Union over vertices of their k heaviest edges."""
    r = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("weight"), "u"))
    return g.both("weight").withColumn("r", r).filter(F.col("r") <= k).select(F.least("v", "u").alias("src"), F.greatest("v", "u").alias("dst")).distinct()


def sparsify_threshold(g: Graph, t: float) -> DataFrame:
    return g.edges.filter(F.col("weight") >= t).select("src", "dst")


def quotient(g: Graph, label: DataFrame) -> DataFrame:
    """Edges between groups with the number and total weight of what they stand for."""
    l = label.select("id", F.coalesce("label", F.lit("__unassigned__")).alias("label"))  # noqa: E741
    e = g.edges.join(l.select(F.col("id").alias("src"), F.col("label").alias("x")), "src").join(l.select(F.col("id").alias("dst"), F.col("label").alias("y")), "dst")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def contract(g: Graph, a: str, b: str) -> DataFrame:
    """Edges after b has become a: loops go, parallel edges are one."""
    to = lambda c: F.when(F.col(c) == b, F.lit(a)).otherwise(F.col(c))
    e = g.edges.select(to("src").alias("x"), to("dst").alias("y")).filter("x <> y")
    return e.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()


def _half(g: Graph, first: bool) -> Graph:
    e = g.edges.filter(F.col("ts") < _MID if first else F.col("end_ts") >= _MID)
    return Graph(ends(e), e)


_MID = 830_000_000_000
_K = 6


def _two(f):
    def run(s, d):
        g = co_part(s, d)
        return f(_half(g, True), _half(g, False))

    return run


_HALF = f"ea AS MATERIALIZED (SELECT * FROM e WHERE ts < {_MID}), eb AS MATERIALIZED (SELECT * FROM e WHERE end_ts >= {_MID}), va AS (SELECT src AS id FROM ea UNION SELECT dst FROM ea), vb AS (SELECT src AS id FROM eb UNION SELECT dst FROM eb)"
_WIN = f"""r AS (SELECT min(ts) AS lo, max(end_ts) AS hi, greatest(1, (max(end_ts) - min(ts) + 1) // {_K}) AS width FROM e),
wi AS (SELECT w, lo + w * width AS ws, CASE WHEN w = {_K - 1} THEN hi ELSE lo + (w + 1) * width - 1 END AS we FROM r, (SELECT unnest(range({_K})) AS w)),
ew AS (SELECT w, src, dst FROM e JOIN wi ON ts <= we AND end_ts >= ws),
gr AS (SELECT w::INT AS w, n, m, round(2.0 * m / (n * (n - 1)), 6) AS density FROM (SELECT w, count(*) AS m FROM ew GROUP BY w) JOIN (SELECT w, count(DISTINCT id) AS n FROM (SELECT w, unnest([src, dst]) AS id FROM ew) GROUP BY w) USING (w))"""
_PICK = "CASE WHEN a.weight IS NULL THEN b.weight WHEN b.weight IS NULL THEN a.weight ELSE {} END"
QUERIES = {
    "subgraph_extract": lambda s, d: extract(co_part(s, d), types=["F", "c", "sg"], min_weight=2, degree=(1, 3), connected_only=True).vertices,
    "khop_ball": lambda s, d: ball(co_part(s, d), "p1", 3),
    "snapshot_at": lambda s, d: snapshot(co_part(s, d), _MID).edges.select("src", "dst"),
    "window_between": lambda s, d: window(co_part(s, d), _MID, _MID + 10**10).vertices,
    "time_points": lambda s, d: time_points(co_part(s, d)),
    "windows_k": lambda s, d: in_windows(co_part(s, d), _K),
    "edge_persistence": lambda s, d: persistence(co_part(s, d), _K),
    "growth_metrics": lambda s, d: growth(co_part(s, d), _K),
    "growth_rate": lambda s, d: growth_rate(co_part(s, d), _K),
    "timeline_steps": lambda s, d: timeline(co_part(s, d), _K),
    "trend_transitions": lambda s, d: trends(co_part(s, d), _K),
    "rolling_baseline": lambda s, d: baseline(co_part(s, d), _K),
    "linear_forecast": lambda s, d: forecast(co_part(s, d), _K),
    "graph_diff": _two(diff),
    "merge_union": _two(lambda a, b: merge(a, b, "union", "SUM")),
    "merge_intersection": _two(lambda a, b: merge(a, b, "intersection", "AVERAGE")),
    "merge_symdiff": _two(lambda a, b: merge(a, b, "symdiff")),
    "merge_left": _two(lambda a, b: merge(a, b, "left", "MAX")),
    "complement_small": lambda s, d: complement(user_seq(s, d)),
    "sparsify_local_k": lambda s, d: sparsify_local(co_part(s, d), 2),
    "sparsify_threshold": lambda s, d: sparsify_threshold(co_part(s, d), 3),
    "quotient_degree": lambda s, d: quotient(co_part(s, d), co_part(s, d).degrees().select("id", F.floor(F.col("degree") / 3).cast("string").alias("label"))),
    "edge_contraction": lambda s, d: contract(co_part(s, d), "p1", "p2"),
}
SQL = {
    "subgraph_extract": sql("SELECT DISTINCT id FROM (SELECT unnest([src, dst]) AS id FROM f WHERE src IN (SELECT id FROM fd) AND dst IN (SELECT id FROM fd))", "f AS (SELECT * FROM e WHERE type IN ('f', 'c', 'sg') AND weight >= 2), fd AS (SELECT id FROM (SELECT unnest([src, dst]) AS id FROM f) GROUP BY id HAVING count(*) BETWEEN 1 AND 3)"),
    "khop_ball": sql("SELECT id, min(h)::INT AS hops FROM b GROUP BY id", "b(id, h) AS (SELECT id, 0 FROM v WHERE id = 'p1' UNION SELECT s.u, h + 1 FROM b JOIN s ON s.v = b.id WHERE h < 3)"),
    "snapshot_at": sql(f"SELECT src, dst FROM e WHERE ts <= {_MID} AND end_ts >= {_MID}"),
    "window_between": sql(f"SELECT DISTINCT unnest([src, dst]) AS id FROM e WHERE ts <= {_MID + 10**10} AND end_ts >= {_MID}"),
    "time_points": sql("SELECT ts AS t FROM e UNION SELECT end_ts FROM e"),
    "windows_k": sql("SELECT w::INT AS w, src, dst FROM ew", _WIN),
    "edge_persistence": sql(f"SELECT src, dst, round(count(*) / {_K}, 6) AS share, CASE WHEN count(*) / {_K} >= 0.75 THEN 'PERSISTENT' WHEN count(*) / {_K} >= 0.25 THEN 'PERIODIC' ELSE 'TRANSIENT' END AS kind FROM ew GROUP BY src, dst", _WIN),
    "growth_metrics": sql("SELECT * FROM gr", _WIN),
    "growth_rate": sql("SELECT round(regr_slope(m, w), 4) AS slope FROM gr", _WIN),
    "timeline_steps": sql("SELECT w::INT AS w, edges, nw AS new_edges, coalesce(lag(edges) OVER (ORDER BY w), 0) - (edges - nw) AS lost_edges FROM (SELECT w, count(*) AS edges, sum((p IS NULL OR p < w - 1)::INT)::BIGINT AS nw FROM (SELECT w, lag(w) OVER (PARTITION BY src, dst ORDER BY w) AS p FROM ew) GROUP BY w)", _WIN),
    "trend_transitions": sql("SELECT w, m, round(c, 6) AS change, CASE WHEN c > 0.3 THEN 'growth_spike' WHEN c < -0.3 THEN 'contraction' END AS transition FROM (SELECT w, m, (m - lag(m) OVER (ORDER BY w)) / lag(m) OVER (ORDER BY w) AS c FROM gr)", _WIN),
    "rolling_baseline": sql("SELECT w, density, round(a, 6) AS mean, round(s, 6) AS sd, abs(density - a) > greatest(2 * s, 0.01) AS anomaly FROM (SELECT w, density, avg(density) OVER b AS a, stddev_pop(density) OVER b AS s FROM gr WINDOW b AS (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", _WIN),
    "linear_forecast": sql(f"SELECT x::INT AS w, round((SELECT regr_intercept(m, w) FROM gr) + (SELECT regr_slope(m, w) FROM gr) * x, 4) AS edges FROM (SELECT unnest(range({_K}, {_K + 3})) AS x)", _WIN),
    "graph_diff": sql("SELECT *, round(common_edges / (added_edges + removed_edges + common_edges), 6) AS jaccard, added_nodes + removed_nodes + added_edges + removed_edges AS edit_distance FROM (SELECT (SELECT count(*) FROM vb WHERE id NOT IN (FROM va)) AS added_nodes, (SELECT count(*) FROM va WHERE id NOT IN (FROM vb)) AS removed_nodes, (SELECT count(*) FROM va WHERE id IN (FROM vb)) AS common_nodes, (SELECT count(*) FROM eb ANTI JOIN ea USING (src, dst)) AS added_edges, (SELECT count(*) FROM ea ANTI JOIN eb USING (src, dst)) AS removed_edges, (SELECT count(*) FROM ea JOIN eb USING (src, dst)) AS common_edges)", _HALF),
    "merge_union": sql(f"SELECT src, dst, {_PICK.format('a.weight + b.weight')} AS weight FROM ea a FULL JOIN eb b USING (src, dst)", _HALF),
    "merge_intersection": sql("SELECT src, dst, (a.weight + b.weight) / 2 AS weight FROM ea a JOIN eb b USING (src, dst)", _HALF),
    "merge_symdiff": sql("SELECT src, dst, coalesce(a.weight, b.weight) AS weight FROM ea a FULL JOIN eb b USING (src, dst) WHERE a.weight IS NULL OR b.weight IS NULL", _HALF),
    "merge_left": sql(f"SELECT src, dst, {_PICK.format('greatest(a.weight, b.weight)')} AS weight FROM ea a FULL JOIN (SELECT * FROM eb WHERE src IN (FROM va) AND dst IN (FROM va)) b USING (src, dst)", _HALF),
    "complement_small": user_sql("SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.id < b.id ANTI JOIN e ON e.src = a.id AND e.dst = b.id"),
    "sparsify_local_k": sql("SELECT DISTINCT least(v, u) AS src, greatest(v, u) AS dst FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY v ORDER BY weight DESC, u) <= 2)"),
    "sparsify_threshold": sql("SELECT src, dst FROM e WHERE weight >= 3"),
    "quotient_degree": sql("SELECT least(x.l, y.l) AS a, greatest(x.l, y.l) AS b, count(*) AS edges, sum(weight) AS weight FROM e JOIN l x ON x.id = src JOIN l y ON y.id = dst GROUP BY 1, 2", "l AS (SELECT id, (degree // 3)::VARCHAR AS l FROM d)"),
    "edge_contraction": sql("SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM (SELECT CASE WHEN src = 'p2' THEN 'p1' ELSE src END AS x, CASE WHEN dst = 'p2' THEN 'p1' ELSE dst END AS y FROM e) WHERE x <> y"),
}
