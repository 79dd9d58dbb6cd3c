"""Cycle basis and girth, and hitting times of random walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.operators.iterative import connected, levels
from proxigraph.plans.graph import Graph, user_seq, user_sql
from proxigraph.plans.shared import drop, materialize

BATCH = 4096  # sources that are searched at once


def forest(g: Graph) -> DataFrame:
    """(id, hops, parent): breadth first from the least vertex of each component; parent is the least neighbour a
    hop nearer, null at the root."""
    roots = connected(g).select(F.col("component").alias("id"), F.col("component").alias("source")).distinct()
    found = materialize(levels(g, roots).select("id", "hops"), "forest-levels")
    near = g.both().join(found.select(F.col("id").alias("v"), (F.col("hops") + 1).alias("hops")), "v").select(F.col("u").alias("id"), "hops", "v")
    return materialize(found.join(near, ["id", "hops"], "left").groupBy("id", "hops").agg(F.min("v").alias("parent")), "forest")


def cycle_basis(g: Graph) -> DataFrame:
    """(src, dst, length, cycle): the fundamental cycle of each edge off the breadth-first forest, from where its
    ends meet, by way of src and dst, back to there: m - n + c of them.

    Loops and parallel edges are no cycles here. Each round the end that lies deeper climbs to its parent, both
    if they are level, until they meet; a round touches only cycles that are still open."""
    edges = materialize(g.edges.filter("src <> dst").select("src", "dst").distinct(), "cycle-edges")
    g = Graph(g.vertices.distinct(), edges)
    up = forest(g)
    stem = up.filter("parent is not null").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
    end = lambda c: up.select(F.col("id").alias(c), F.col("hops").alias(f"{c}_hops"), F.col("parent").alias(f"{c}_up"))
    open_ = edges.join(stem, ["src", "dst"], "left_anti").select("src", "dst", F.col("src").alias("x"), F.col("dst").alias("y"), F.array("src").alias("px"), F.array("dst").alias("py"))
    open_, done = materialize(open_, "cycles-open"), []
    while not open_.isEmpty():
        at = open_.join(end("x"), "x").join(end("y"), "y")
        a, b = F.col("x_hops") >= F.col("y_hops"), F.col("y_hops") >= F.col("x_hops")
        climb = lambda on, c, p: (F.when(on, F.col(f"{c}_up")).otherwise(F.col(c)).alias(c), F.when(on, F.concat(p, F.array(f"{c}_up"))).otherwise(F.col(p)).alias(p))
        nxt = materialize(at.select("src", "dst", *climb(a, "x", "px"), *climb(b, "y", "py")), "cycles-open")
        done.append(nxt.filter("x = y"))
        drop(open_)
        open_ = materialize(nxt.filter("x <> y"), "cycles-open")
    none = edges.limit(0).select("src", "dst", F.col("src").alias("x"), F.col("dst").alias("y"), F.array("src").alias("px"), F.array("dst").alias("py"))
    found = reduce(DataFrame.unionByName, done, none)
    cycle = F.concat(F.reverse("px"), F.expr("slice(py, 1, size(py) - 1)"))
    return found.select("src", "dst", F.size(cycle).alias("length"), cycle.alias("cycle"))


def girth(g: Graph, batch: int = BATCH) -> int | None:
    """The length of the shortest cycle, None without one; parallel edges and loops are no cycles.

    Balls grow around batches of vertices, up to half the shortest cycle known: an edge within a level, or a
    vertex met from two vertices of the level before, closes a cycle, and around one of its own vertices
    the shortest is seen as it is."""
    edges = materialize(g.edges.filter("src <> dst").select("src", "dst").distinct(), "girth-edges")
    g = Graph(materialize(g.vertices.distinct(), "girth-vertices"), edges)
    links = materialize(g.both(), "girth-links")
    core = materialize(links.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("d")).filter("d > 1").select("id"), "girth-sources")
    parts, best = max(1, -(-core.count() // batch)), None
    for i in range(parts):
        some = core.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
        found = materialize(levels(g, some.withColumn("source", F.col("id")), most=None if best is None else best // 2), "girth-balls")
        ends = found.select(F.col("id").alias("u"), "source", F.col("hops").alias("h"))
        met = found.join(links, F.col("id") == F.col("v")).join(ends, ["u", "source"])
        level = met.filter("h = hops").agg(F.min(2 * F.col("hops") + 1).alias("n"))
        twice = met.filter("h = hops + 1").groupBy("u", "source", "h").agg(F.count("*").alias("k")).filter("k > 1").agg(F.min(2 * F.col("h")).alias("n"))
        n = level.unionByName(twice).agg(F.min("n")).first()[0]
        if n is not None:
            best = n if best is None else min(best, n)
        drop(found)
    return best


def hitting_times(g: Graph, target: str, weighted: bool = False, tolerance: float = 1e-10, rounds: int = 10_000) -> DataFrame:
    """(id, time): the expected number of steps of a random walk from each vertex to ``target``, infinite where
    it is out of reach; an unknown target gives no rows.

    Times solve a linear system over the edges, degree times time less the times around being the degree,
    by conjugate gradients: a join with the edges and one sum of products a round. RuntimeError if ``rounds`` do not
    bring the residual below ``tolerance``, or if it is not small when it is computed afresh."""
    both = g.both("weight").filter("v <> u")
    links = both.groupBy("v", "u").agg(F.sum("weight").alias("w")) if weighted else both.select("v", "u").distinct().withColumn("w", F.lit(1.0))
    links = materialize(links.filter("w > 0"), "walk-links")
    inside = materialize(levels(Graph(g.vertices, links.select(F.col("v").alias("src"), F.col("u").alias("dst"))), g.vertices.filter(F.col("id") == target).distinct().select("id", F.col("id").alias("source"))).select("id"), "walk-reach")
    if inside.isEmpty():
        return inside.select("id", F.lit(0.0).alias("time"))
    degree = links.groupBy(F.col("v").alias("id")).agg(F.sum("w").alias("d"))
    state = materialize(inside.filter(F.col("id") != target).join(degree, "id").select("id", "d", F.lit(0.0).alias("x"), F.col("d").alias("r"), F.lit(1.0).alias("p")), "walk")

    def times(df: DataFrame, c: str) -> DataFrame:
        """``df`` with q, the matrix times column ``c``; the target's row is left out of it."""
        far = links.join(df.select(F.col("id").alias("u"), F.col(c).alias("y")), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("w") * F.col("y")).alias("s"))
        return df.join(far, "id", "left").withColumn("q", F.col("d") * F.col(c) - F.coalesce("s", F.lit(0.0))).drop("s")

    first = state.agg(F.sum("d")).first()[0]
    now = first
    for _ in range(rounds):
        if first is None or now <= tolerance * tolerance * first:
            break
        new = materialize(times(state, "p"), "walk")
        drop(state)
        s = new.agg(F.sum(F.col("p") * F.col("q")), F.sum(F.col("r") * F.col("q") / F.col("d")), F.sum(F.col("q") * F.col("q") / F.col("d")), F.sum(F.col("r") * F.col("r") / F.col("d"))).first()
        step = now / s[0]
        after = max(0.0, s[3] - 2 * step * s[1] + step * step * s[2])
        r = F.col("r") - step * F.col("q")
        state, now = new.select("id", "d", (F.col("x") + step * F.col("p")).alias("x"), r.alias("r"), (r / F.col("d") + (after / now) * F.col("p")).alias("p")), after
    else:
        raise RuntimeError(f"hitting times did not settle in {rounds} rounds")
    state = materialize(state, "walk")
    worst = times(state, "x").agg(F.max(F.abs(F.col("d") - F.col("q")) / F.col("d"))).first()[0]
    if worst is not None and worst > 1e-6:
        raise RuntimeError(f"the residual of the hitting times is {worst}")
    known = state.select("id", F.col("x").alias("time")).unionByName(inside.filter(F.col("id") == target).select("id", F.lit(0.0).alias("time")))
    return g.vertices.distinct().join(known, "id", "left").select("id", F.coalesce("time", F.lit(float("inf"))).alias("time"))


_TREE = """rr(id, c) AS (SELECT id, id FROM v UNION SELECT s.u, rr.c FROM rr JOIN s ON s.v = rr.id), comp AS MATERIALIZED (SELECT id, min(c) AS root FROM rr GROUP BY id),
hh(id, h) AS (SELECT DISTINCT root, 0 FROM comp UNION SELECT s.u, h + 1 FROM hh JOIN s ON s.v = hh.id WHERE h < 40), lv AS MATERIALIZED (SELECT id, min(h) AS h FROM hh GROUP BY id),
up AS MATERIALIZED (SELECT lv.id, min(n.id) AS parent FROM lv LEFT JOIN (s JOIN lv n ON n.id = s.u) ON s.v = lv.id AND n.h = lv.h - 1 GROUP BY lv.id),
rp(id, path) AS (SELECT id, [id] FROM up WHERE parent IS NULL UNION ALL SELECT up.id, list_append(path, up.id) FROM rp JOIN up ON up.parent = rp.id),
off AS (SELECT e.src, e.dst, a.path AS p, b.path AS q FROM e JOIN rp a ON a.id = e.src JOIN rp b ON b.id = e.dst JOIN up x ON x.id = e.src JOIN up y ON y.id = e.dst WHERE x.parent IS DISTINCT FROM e.dst AND y.parent IS DISTINCT FROM e.src),
cy AS (SELECT src, dst, p, q, len(list_filter(p, lambda z: list_contains(q, z))) AS k FROM off)"""
_four = lambda x: x.replace("count(*) >= 2", "count(*) >= 4")

QUERIES = {
    "cycle_basis": lambda s, d: cycle_basis(user_seq(s, d, 4)).withColumn("cycle", F.array_join("cycle", ",")),
    "girth": lambda s, d: s.createDataFrame([(girth(user_seq(s, d, 4)),)], "girth int"),
    "hitting_times": lambda s, d: hitting_times(user_seq(s, d), "u1").select("id", F.round("time", 4).alias("time")),
}
SQL = {
    "cycle_basis": _four(user_sql("SELECT src, dst, (len(p) + len(q) - 2 * k + 1)::INT AS length, array_to_string(list_concat(p[k:], list_reverse(q[k + 1:])), ',') AS cycle FROM cy", _TREE)),
    "girth": _four(user_sql("SELECT min(len(path))::INT AS girth FROM wk WHERE EXISTS (SELECT 1 FROM s WHERE s.v = tip AND s.u = path[1]) AND len(path) > 2", "wk(tip, path) AS (SELECT id, [id] FROM v UNION ALL SELECT s.u, list_append(path, s.u) FROM wk JOIN s ON s.v = wk.tip WHERE s.u > path[1] AND NOT list_contains(path, s.u) AND len(path) < 5)")),
}
