"""Directed graphs: strong components, their condensation, topological levels, reciprocity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.operators.paths import climb
from proxigraph.plans.graph import Graph, next_sql, rounded, user_next, user_seq, user_sql
from proxigraph.plans.shared import drop, materialize


def _spread(start: DataFrame, links: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(id, mark): the least mark that reaches each vertex along ``links`` (v, u)."""
    now = materialize(start.select("id", "mark", F.lit(True).alias("new")), "spread")
    for _ in range(rounds):
        got = now.filter("new").join(links, F.col("id") == F.col("v")).groupBy(F.col("u").alias("id")).agg(F.min("mark").alias("m"))
        both = now.join(got, "id", "left")
        better = F.coalesce(F.col("m") < F.col("mark"), F.lit(False)) | (F.col("mark").isNull() & F.col("m").isNotNull())
        nxt = materialize(both.select("id", F.when(better, F.col("m")).otherwise(F.col("mark")).alias("mark"), better.alias("new")), "spread")
        drop(now)
        now = nxt
        if now.filter("new").isEmpty():
            return now.select("id", "mark")
    raise RuntimeError(f"marks did not settle in {rounds} rounds")


def strong_components(g: Graph) -> DataFrame:
    """(id, scc): scc is the least id of the vertices that reach the vertex and are reached by it.

    Each round marks every vertex with the least id that reaches it; the vertices of a mark that
    reach its owner are that owner's component, and leave. Rounds grow with the depth of the
    condensation, not with its size.
    """
    left = materialize(g.vertices.select("id").distinct(), "scc-left")
    e = materialize(g.edges.select(F.col("src").alias("v"), F.col("dst").alias("u")).filter("v <> u").distinct(), "scc-edges")
    out = None
    while not left.isEmpty():
        # vertices without an edge in or out are components of their own: most go here, many at once
        both = e.select(F.col("v").alias("id")).distinct().join(e.select(F.col("u").alias("id")).distinct(), "id")
        alone = materialize(left.join(both, "id", "left_anti").select("id", F.col("id").alias("scc")), "scc-alone")
        if not alone.isEmpty():
            out = alone if out is None else materialize(out.unionByName(alone), "scc")
            rest = materialize(left.join(alone, "id", "left_anti"), "scc-left")
            inside = materialize(e.join(rest.select(F.col("id").alias("v")), "v", "left_semi").join(rest.select(F.col("id").alias("u")), "u", "left_semi"), "scc-edges")
            left, e = rest, inside
            continue
        fore = _spread(left.withColumn("mark", F.col("id")), e)
        inner = e.join(fore.select(F.col("id").alias("v"), F.col("mark").alias("a")), "v").join(fore.select(F.col("id").alias("u"), F.col("mark").alias("b")), "u").filter("a = b")
        back = _spread(fore.select("id", F.when(F.col("mark") == F.col("id"), F.col("id")).alias("mark")), inner.select(F.col("u").alias("v"), F.col("v").alias("u")))
        found = materialize(back.filter("mark is not null").select("id", F.col("mark").alias("scc")), "scc-found")
        out = found if out is None else materialize(out.unionByName(found), "scc")
        rest = materialize(left.join(found, "id", "left_anti"), "scc-left")
        inside = materialize(e.join(rest.select(F.col("id").alias("v")), "v", "left_semi").join(rest.select(F.col("id").alias("u")), "u", "left_semi"), "scc-edges")
        drop(left)
        drop(e)
        left, e = rest, inside
    # an owner's mark is the least id that reaches it: of a component, its own least id
    return g.vertices.select("id", F.col("id").alias("scc")).limit(0) if out is None else out


def condensation(g: Graph) -> DataFrame:
    """(scc, size, kind): components and whether the graph between them makes each a source, a sink,
    isolated or intermediate."""
    c = materialize(strong_components(g), "condensed")
    of = lambda x, y: c.select(F.col("id").alias(x), F.col("scc").alias(y))
    e = g.edges.select("src", "dst").join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a <> b").select("a", "b").distinct()
    out, into = e.select(F.col("a").alias("scc")).distinct().withColumn("o", F.lit(1)), e.select(F.col("b").alias("scc")).distinct().withColumn("i", F.lit(1))
    n = c.groupBy("scc").agg(F.count("*").alias("size")).join(out, "scc", "left").join(into, "scc", "left")
    o, i = F.col("o").isNotNull(), F.col("i").isNotNull()
    return n.select("scc", "size", F.when(o & i, "intermediate").when(o, "source").when(i, "sink").otherwise("isolated").alias("kind"))


def edges_to_connect(parts: DataFrame) -> DataFrame:
    """One row: edges that make the graph strongly connected: the greater of sources and sinks,
    isolated components in both; 0 if it is already."""
    n = lambda *k: F.sum(F.when(F.col("kind").isin(*k), 1).otherwise(0))
    return parts.agg(F.count("*").alias("components"), F.when(F.count("*") <= 1, 0).otherwise(F.greatest(n("source", "isolated"), n("sink", "isolated"))).cast("long").alias("edges_needed"))


def topological_levels(g: Graph, rounds: int = 100_000) -> DataFrame:
    """(id, level): the longest path that ends at the vertex; null for vertices on or behind a cycle.
    Each round takes the vertices whose last predecessor was taken in the round before."""
    e = materialize(g.edges.select("src", "dst").distinct(), "topo-edges")
    n_in = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    wait = materialize(g.vertices.select("id").distinct().join(n_in, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("int").alias("level")), "topo")
    for h in range(rounds):
        ready = (F.col("n") == 0) & F.col("level").isNull()
        now = wait.filter(ready).select(F.col("id").alias("src"))
        less = e.join(now, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))
        nxt = materialize(wait.join(less, "id", "left").select("id", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n"), F.when(ready, F.lit(h)).otherwise(F.col("level")).alias("level")), "topo")
        if nxt.filter(ready).isEmpty():
            return nxt.select("id", "level")
        drop(wait)
        wait = nxt
    raise RuntimeError(f"levels did not settle in {rounds} rounds")


def critical_path(g: Graph) -> DataFrame:
    """(step, id): a longest path of a graph without cycles, of equals by the least last vertex and the
    least predecessors; no rows if there is a cycle."""
    level = materialize(topological_levels(g), "topo-levels")
    if not level.filter("level is null").isEmpty():
        return level.filter(F.lit(False)).select(F.col("level").alias("step"), "id")
    of = lambda x: level.select(F.col("id").alias(x), F.col("level").alias(f"l_{x}"))
    up = g.edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").filter("l_dst = l_src + 1").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    last = level.agg(F.max("level").alias("level"))
    end = level.join(F.broadcast(last), "level").agg(F.min("id").alias("id"))  # a row each
    return climb(materialize(level.select("id").join(up, "id", "left"), "topo-parents"), end)


def reciprocity(g: Graph) -> DataFrame:
    """One row: edges, those with an edge back, and their share."""
    e = g.edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("r"))
    a = e.join(back, ["src", "dst"], "left").agg(F.count("*").alias("edges"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("mutual"))
    return a.select("edges", "mutual", rounded(F.when(F.col("edges") > 0, F.col("mutual") / F.col("edges")).otherwise(0.0), "rate"))


def reciprocity_candidates(g: Graph, k: int = 20) -> DataFrame:
    """The k likeliest missing edges back: mean of the graph's rate, shared neighbours over 3 (at most
    1) and the likeness of the degrees, neighbours of either direction counting once."""
    e = g.edges.select("src", "dst").distinct()
    near = materialize(e.select(F.col("src").alias("v"), F.col("dst").alias("u")).unionByName(e.select(F.col("dst").alias("v"), F.col("src").alias("u"))).distinct(), "near")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    miss = e.join(back, ["src", "dst"], "left_anti")
    d = near.groupBy("v").agg(F.count("*").alias("d"))
    shared = miss.join(near.select(F.col("v").alias("src"), "u"), "src").join(near.select(F.col("v").alias("dst"), "u"), ["dst", "u"]).groupBy("src", "dst").agg(F.count("*").alias("n"))
    x = miss.join(shared, ["src", "dst"], "left").join(d.select(F.col("v").alias("src"), F.col("d").alias("a")), "src").join(d.select(F.col("v").alias("dst"), F.col("d").alias("b")), "dst").join(F.broadcast(reciprocity(g).select("rate")))
    p = (F.col("rate") + F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 3) + 1 - F.abs(F.col("a") - F.col("b")) / F.greatest("a", "b")) / 3
    return x.select(F.col("dst").alias("src"), F.col("src").alias("dst"), rounded(p, "probability")).orderBy(F.desc("probability"), "src", "dst").limit(k)


def upward(g: Graph) -> Graph:
    """The edges of an undirected graph from the lesser to the greater id: never a cycle."""
    return Graph(g.vertices, g.edges, directed=True)


_REACH = "rc(a, b) AS (SELECT id, id FROM v UNION SELECT rc.a, e.dst FROM rc JOIN e ON e.src = rc.b), scc AS MATERIALIZED (SELECT x.a AS id, min(x.b) AS scc FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"
_COND = _REACH + ", ce AS (SELECT DISTINCT p.scc AS a, q.scc AS b FROM e JOIN scc p ON p.id = src JOIN scc q ON q.id = dst WHERE p.scc <> q.scc), cond AS (SELECT scc, count(*) AS size, CASE WHEN scc IN (SELECT a FROM ce) AND scc IN (SELECT b FROM ce) THEN 'intermediate' WHEN scc IN (SELECT a FROM ce) THEN 'source' WHEN scc IN (SELECT b FROM ce) THEN 'sink' ELSE 'isolated' END AS kind FROM scc GROUP BY scc)"
_RATE = "rt AS (SELECT count(*) AS edges, count(b.src) AS mutual, round(count(b.src) / count(*), 6) AS rate FROM e LEFT JOIN e b ON b.src = e.dst AND b.dst = e.src)"

QUERIES = {
    "strong_components": lambda s, d: strong_components(user_next(s, d, 3)),
    "condensation": lambda s, d: condensation(user_next(s, d, 3)),
    "condensation_cost": lambda s, d: edges_to_connect(condensation(user_next(s, d, 3))),
    "topological_levels": lambda s, d: topological_levels(upward(user_seq(s, d, 4))),
    "critical_path": lambda s, d: critical_path(upward(user_seq(s, d, 4))),
    "topological_cycles": lambda s, d: topological_levels(user_next(s, d, 3)),
    "reciprocity": lambda s, d: reciprocity(user_next(s, d)),
    "reciprocity_candidates": lambda s, d: reciprocity_candidates(user_next(s, d)),
}
_three = lambda q: q.replace("count(*) >= 2", "count(*) >= 3")
SQL = {
    "strong_components": _three(next_sql("SELECT * FROM scc", _REACH)),
    "condensation": _three(next_sql("SELECT * FROM cond", _COND)),
    "condensation_cost": _three(next_sql("SELECT count(*) AS components, CASE WHEN count(*) <= 1 THEN 0 ELSE greatest(count(*) FILTER (kind IN ('source', 'isolated')), count(*) FILTER (kind IN ('sink', 'isolated'))) END::BIGINT AS edges_needed FROM cond", _COND)),
    "topological_levels": user_sql("SELECT id, max(l)::INT AS level FROM lp GROUP BY id", "lp(id, l) AS (SELECT id, 0 FROM v UNION SELECT e.dst, l + 1 FROM lp JOIN e ON e.src = lp.id)").replace("count(*) >= 2", "count(*) >= 4"),
    "critical_path": user_sql("SELECT ((SELECT max(k) FROM cp) - k)::INT AS step, id FROM cp", "lp(id, l) AS (SELECT id, 0 FROM v UNION SELECT e.dst, l + 1 FROM lp JOIN e ON e.src = lp.id), lv AS MATERIALIZED (SELECT id, max(l) AS l FROM lp GROUP BY id), pa AS MATERIALIZED (SELECT y.id, min(x.id) AS p FROM e JOIN lv x ON x.id = src JOIN lv y ON y.id = dst AND y.l = x.l + 1 GROUP BY y.id), cp(id, k) AS (SELECT min(id), 0 FROM lv WHERE l = (SELECT max(l) FROM lv) UNION ALL SELECT p, k + 1 FROM cp JOIN pa ON pa.id = cp.id)").replace("count(*) >= 2", "count(*) >= 4"),
    "topological_cycles": _three(next_sql("SELECT v.id, x.level FROM v LEFT JOIN (SELECT id, max(l)::INT AS level FROM lp GROUP BY id) x ON x.id = v.id", "rc(a, b) AS (SELECT src, dst FROM e UNION SELECT rc.a, e.dst FROM rc JOIN e ON e.src = rc.b), bad AS (SELECT a AS id FROM rc WHERE a = b UNION SELECT b FROM rc WHERE a IN (SELECT a FROM rc WHERE a = b)), lp(id, l) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT id FROM bad) UNION SELECT e.dst, l + 1 FROM lp JOIN e ON e.src = lp.id WHERE e.dst NOT IN (SELECT id FROM bad))")),
    "reciprocity": next_sql("SELECT * FROM rt", _RATE),
    "reciprocity_candidates": next_sql("SELECT m.dst AS src, m.src AS dst, round((rate + least(1.0, coalesce(n, 0) / 3) + 1 - abs(a.d - b.d) / greatest(a.d, b.d)) / 3, 6) AS probability FROM m LEFT JOIN sh ON sh.src = m.src AND sh.dst = m.dst JOIN dg a ON a.v = m.src JOIN dg b ON b.v = m.dst, rt ORDER BY probability DESC, 1, 2 LIMIT 20", _RATE + ", nr AS (SELECT src AS v, dst AS u FROM e UNION SELECT dst, src FROM e), dg AS (SELECT v, count(*) AS d FROM nr GROUP BY v), m AS (SELECT e.src, e.dst FROM e ANTI JOIN e b ON b.src = e.dst AND b.dst = e.src), sh AS (SELECT m.src, m.dst, count(*) AS n FROM m JOIN nr x ON x.v = m.src JOIN nr y ON y.v = m.dst AND y.u = x.u GROUP BY 1, 2)"),
}
