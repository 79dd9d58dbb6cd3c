"""Paths: breadth-first trees, weighted distances by rounds of relaxation, growth of balls,
betweenness by batches of sources, bridges, label propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.operators.iterative import _SEARCH, histogram, layer_sizes, levels
from proxigraph.plans.graph import Graph, co_part, rounded, sql, user_seq, user_sql
from proxigraph.plans.shared import drop, materialize


def tree(g: Graph, source: str, links: DataFrame | None = None) -> DataFrame:
    """(id, hops, parent): breadth first from ``source``; parent is the least neighbour a hop nearer,
    null at the source. An unknown source gives no rows."""
    found = levels(g, g.vertices.filter(F.col("id") == source).select("id", F.col("id").alias("source"))).select("id", "hops")
    s = g.both() if links is None else links
    up = found.select(F.col("id").alias("v"), (F.col("hops") + 1).alias("hops"))
    near = s.join(up, "v").select(F.col("u").alias("id"), "hops", F.col("v").alias("p"))
    parent = found.join(near, ["id", "hops"]).groupBy("id", "hops").agg(F.min("p").alias("parent"))
    return found.join(parent, ["id", "hops"], "left")


def climb(parents: DataFrame, target: DataFrame) -> DataFrame:
    """(step, id) from the root to the one row (id) of ``target``, by ``parents`` (id, parent) whose roots
    have none. Pointers double: a round knows all vertices below 2^k steps and looks up as many at once,
    so a path takes the logarithm of its length in rounds. No rows for an unknown or missing target."""
    jump = parents.filter("parent is not null").select("id", "parent")
    path = materialize(parents.join(target.select("id"), "id", "left_semi").select("id", F.lit(0).cast("long").alias("up")), "climb")
    for k in range(64):
        more = path.join(jump, "id").select(F.col("parent").alias("id"), (F.col("up") + F.lit(1 << k)).alias("up"))
        more = materialize(more, "climb")
        if more.isEmpty():
            drop(more)
            break
        path = materialize(path.unionByName(more), "climb")
        twice = jump.select("id", F.col("parent").alias("mid")).join(jump.select(F.col("id").alias("mid"), "parent"), "mid")
        jump = materialize(twice.select("id", "parent"), "jump")
    else:
        raise ValueError("the parents form a cycle")
    length = path.agg(F.max("up").alias("top"))
    return path.join(F.broadcast(length)).select((F.col("top") - F.col("up")).cast("int").alias("step"), "id")  # length: one row


def _one(g: Graph, vertex: str) -> DataFrame:
    return g.vertices.filter(F.col("id") == vertex).select("id")


def path_by_hops(g: Graph, source: str, target: str, avoid: tuple[str, ...] = ()) -> DataFrame:
    """(step, id) of a shortest path, of equals by least predecessors; no rows without a path.
    Vertices in ``avoid`` are left out of the graph. A path to the source itself is one row."""
    if avoid:
        keep = ~F.col("id").isin(*avoid)
        g = Graph(g.vertices.filter(keep), g.edges.filter(~F.col("src").isin(*avoid) & ~F.col("dst").isin(*avoid)))
    return climb(materialize(tree(g, source).select("id", "parent"), "tree"), _one(g, target))


def path_through(g: Graph, stops: list[str]) -> DataFrame:
    """(step, id): shortest paths from stop to stop, joined; no rows if one of them is missing."""
    legs, base = [], 0
    for i, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
        leg = materialize(path_by_hops(g, a, b), "leg")
        n = leg.count()
        if not n:
            return leg
        legs.append(leg.filter(F.col("step") >= (1 if i else 0)).select((F.col("step") + base).alias("step"), "id"))
        base += n - 1
    return reduce(DataFrame.unionByName, legs, g.vertices.limit(0).select(F.lit(0).alias("step"), "id"))


def weighted_distances(g: Graph, source: str, rounds: int = 100_000) -> DataFrame:
    """(id, total, parent): least sum of weights from ``source``; of equals the least parent.
    Negative weights are an error. Rounds relax only vertices that changed in the round before."""
    s = materialize(g.both("weight"), "relax-links")
    if not s.filter("weight < 0").isEmpty():
        raise ValueError("negative weight")
    start = g.vertices.filter(F.col("id") == source).select("id", F.lit(0.0).alias("total"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("new"))
    now = materialize(start, "relax")
    for _ in range(rounds):
        offer = now.filter("new").join(s, F.col("id") == F.col("v")).groupBy(F.col("u").alias("id")).agg(F.min(F.struct((F.col("total") + F.col("weight")).alias("total"), F.col("v").alias("parent"))).alias("x"))
        both = now.join(offer, "id", "full")
        better = F.col("x").isNotNull() & (F.col("id") != source) & (F.col("total").isNull() | (F.col("x.total") < F.col("total")) | ((F.col("x.total") == F.col("total")) & (F.col("x.parent") < F.col("parent"))))
        nxt = materialize(both.select("id", F.when(better, F.col("x.total")).otherwise(F.col("total")).alias("total"), F.when(better, F.col("x.parent")).otherwise(F.col("parent")).alias("parent"), F.coalesce(better, F.lit(False)).alias("new")), "relax")
        drop(now)
        now = nxt
        if now.filter("new").isEmpty():
            return now.select("id", "total", "parent")
    raise RuntimeError(f"distances did not settle in {rounds} rounds")


def path_by_weight(g: Graph, source: str, target: str) -> DataFrame:
    """(step, id, total) of a path of least weight; no rows without one."""
    d = materialize(weighted_distances(g, source), "relaxed")
    return climb(d, _one(g, target)).join(d.select("id", "total"), "id").select("step", "id", "total")


def power(g: Graph, k: int) -> DataFrame:
    """(src, dst): pairs at most ``k`` hops apart, src < dst."""
    near = levels(g, g.vertices.select("id", F.col("id").alias("source")), most=k)
    return near.filter("source < id").select(F.col("source").alias("src"), F.col("id").alias("dst"))


def growth_profile(g: Graph, source: str) -> DataFrame:
    """(hops, boundary, reached, rate): layers around a vertex; rate is the layer over all before it."""
    layer = levels(g, g.vertices.filter(F.col("id") == source).select("id", F.col("id").alias("source"))).groupBy("hops").agg(F.count("*").alias("boundary"))
    before = layer.select(F.col("hops").alias("h"), F.col("boundary").alias("b"))
    x = layer.join(F.broadcast(before), F.col("h") <= F.col("hops")).groupBy("hops", "boundary").agg(F.sum("b").alias("reached"))  # a row per layer
    inner = F.col("reached") - F.col("boundary")
    return x.select("hops", "boundary", "reached", rounded(F.when(inner > 0, F.col("boundary") / inner).otherwise(0.0), "rate"))


def ball_overlap(g: Graph, a: str, b: str, k: int) -> DataFrame:
    """One row: Jaccard of the balls of ``k`` hops around two vertices, themselves included."""
    near = levels(g, g.vertices.filter(F.col("id").isin(a, b)).select("id", F.col("id").alias("source")), most=k)
    c = near.groupBy("id").agg(F.count_distinct("source").alias("n"))
    return c.agg(rounded(F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)) / F.count("*"), F.lit(1.0)), "overlap"))


def distance_percentiles(sizes: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.9)) -> DataFrame:
    """(p, hops): nearest-rank percentiles of the distances between different vertices, from their histogram."""
    h = histogram(sizes)
    lower = h.select(F.col("hops").alias("x"), F.col("pairs").alias("n"))
    upto = h.join(F.broadcast(lower), F.col("x") <= F.col("hops")).groupBy("hops").agg(F.sum("n").alias("upto"))  # a row per distance
    total = h.agg(F.sum("pairs").alias("total"))
    p = upto.join(F.broadcast(total)).select("hops", "upto", "total", F.explode(F.array(*[F.lit(x) for x in at])).alias("p"))
    return p.filter(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("total")))).groupBy("p").agg(F.min("hops").alias("hops"))


def brandes(g: Graph, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, betweenness), (src, dst, betweenness)) of an undirected graph, each pair counted once.

    All sources, or a batch (id), are searched at once: forward rounds count shortest paths, backward
    rounds hand dependencies to predecessors. A table has a row per source and vertex reached, so
    for large graphs give batches and add their results.
    """
    s = materialize(g.both(), "btw-links")
    seeds = (g.vertices if sources is None else sources).select("id", F.col("id").alias("source"), F.lit(1.0).alias("sigma"))
    layers, before = [materialize(seeds, "btw")], None
    while True:
        at = layers[-1]
        nxt = at.join(s, F.col("id") == F.col("v")).groupBy("source", F.col("u").alias("id")).agg(F.sum("sigma").alias("sigma"))
        for old in (at, before):
            if old is not None:
                nxt = nxt.join(old.select("source", "id"), ["source", "id"], "left_anti")
        new = materialize(nxt.select("id", "source", "sigma"), "btw")
        if new.isEmpty():
            break
        before = at
        layers.append(new)
    nodes, links, delta = [], [], None
    for up, low in zip(reversed(layers[:-1]), reversed(layers[1:]), strict=True):
        low = low.withColumn("delta", F.lit(0.0)) if delta is None else low.join(delta, ["source", "id"], "left").select("id", "source", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        nodes.append(materialize(low.groupBy("id").agg(F.sum("delta").alias("x")), "btw-nodes"))
        w = low.select(F.col("id").alias("u"), "source", ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        flow = materialize(up.join(s, F.col("id") == F.col("v")).join(w, ["source", "u"]).select("source", "id", "u", (F.col("sigma") * F.col("share")).alias("c")), "btw-flow")
        links.append(materialize(flow.groupBy(F.least("id", "u").alias("src"), F.greatest("id", "u").alias("dst")).agg(F.sum("c").alias("x")), "btw-edges"))
        delta = flow.groupBy("source", "id").agg(F.sum("c").alias("delta"))
    zero = F.coalesce("x", F.lit(0.0)) / 2
    none = g.edges.sparkSession.createDataFrame([], "id string, x double"), g.edges.sparkSession.createDataFrame([], "src string, dst string, x double")
    v = reduce(DataFrame.unionByName, nodes, none[0]).groupBy("id").agg(F.sum("x").alias("x"))
    e = reduce(DataFrame.unionByName, links, none[1]).groupBy("src", "dst").agg(F.sum("x").alias("x"))
    return g.vertices.join(v, "id", "left").select("id", zero.alias("betweenness")), g.edges.select("src", "dst").join(e, ["src", "dst"], "left").select("src", "dst", zero.alias("betweenness"))


def bridges(g: Graph) -> DataFrame:
    """(src, dst): edges whose loss parts their ends.

    Edges off a breadth-first forest get random 64-bit marks; the exclusive-or of the marks at the
    vertices below a forest edge is that of the edges leaving the part below it, zero if there is
    none. Marks climb one level a round.
    """
    from proxigraph.operators.iterative import connected

    g = Graph(g.vertices, materialize(g.edges.select("src", "dst"), "bridge-edges"))
    root = materialize(connected(g), "bridge-roots")
    found = levels(g, root.select(F.col("component").alias("id"), F.col("component").alias("source")).distinct()).select("id", "hops")
    near = g.both().join(found.select(F.col("id").alias("v"), (F.col("hops") + 1).alias("hops")), "v").select(F.col("u").alias("id"), "hops", "v")
    found = materialize(found.join(near, ["id", "hops"], "left").groupBy("id", "hops").agg(F.min("v").alias("parent")), "bridge-tree")
    stem = found.filter("parent is not null").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
    mark = F.xxhash64("src", "dst", F.lit("mark"))
    loose = Graph(g.vertices, g.edges.join(stem, ["src", "dst"], "left_anti")).both(mark.alias("m")).groupBy(F.col("v").alias("id")).agg(F.bit_xor("m").alias("m"))
    now = materialize(found.join(loose, "id", "left").select("id", "hops", "parent", F.coalesce("m", F.lit(0)).alias("m")), "bridge-marks")
    depth = found.agg(F.max("hops")).first()[0] or 0
    out = []
    for h in range(depth, 0, -1):
        layer = now.filter(F.col("hops") == h)
        out.append(materialize(layer.filter("m = 0").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst")), "bridges"))
        up = layer.groupBy(F.col("parent").alias("id")).agg(F.bit_xor("m").alias("more"))
        nxt = materialize(now.filter(F.col("hops") < h).join(up, "id", "left").select("id", "hops", "parent", F.coalesce(F.col("m").bitwiseXOR(F.col("more")), F.col("m")).alias("m")), "bridge-marks")
        drop(now)
        now = nxt
    return reduce(DataFrame.unionByName, out, g.edges.limit(0))


def label_propagation(g: Graph, rounds: int = 5) -> DataFrame:
    """(id, label): in every round each vertex takes the most frequent label around it, of equals the
    least; vertices without edges keep their own."""
    s = materialize(g.both(), "lp-links")
    now = materialize(g.vertices.select("id", F.col("id").alias("label")), "lp")
    for _ in range(rounds):
        n = s.join(now.select(F.col("id").alias("u"), "label"), "u").groupBy("v", "label").agg(F.count("*").alias("n"))
        best = n.groupBy(F.col("v").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("x"))
        nxt = materialize(now.join(best, "id", "left").select("id", F.coalesce("x.label", "label").alias("label")), "lp")
        drop(now)
        now = nxt
    return now


A, B = "u1", "u9"
_DIST = "dd(source, id, hops) AS (SELECT id, id, 0 FROM v UNION SELECT source, s.u, hops + 1 FROM dd JOIN s ON s.v = dd.id WHERE hops < 12), dist AS MATERIALIZED (SELECT source, id, min(hops)::INT AS hops FROM dd GROUP BY source, id)"
#: Breadth first from all vertices to the end, 64 of them as the bits of a row.
_LAYERS = """links AS MATERIALIZED (SELECT v, u FROM s), places AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v),
w(id, word, hops, fresh, seen) AS (SELECT id, i // 64, 0, 1::UBIGINT << (i % 64)::INT, 1::UBIGINT << (i % 64)::INT FROM places UNION ALL
 SELECT id, word, hops + 1, bit_or(new) & ~bit_or(old), bit_or(new) | bit_or(old) FROM (SELECT links.u AS id, word, hops, fresh AS new, 0::UBIGINT AS old FROM w JOIN links ON links.v = w.id WHERE fresh <> 0
 UNION ALL SELECT id, word, hops, 0, seen FROM w WHERE EXISTS (SELECT 1 FROM w WHERE fresh <> 0)) GROUP BY id, word, hops)"""
_PAR = "par AS MATERIALIZED (SELECT x.id, x.hops, min(y.id) AS parent FROM dist x JOIN s ON s.u = x.id JOIN dist y ON y.source = x.source AND y.id = s.v AND y.hops = x.hops - 1 WHERE x.source = '{a}' GROUP BY 1, 2), back(id, hops) AS (SELECT id, hops FROM dist WHERE source = '{a}' AND id = '{b}' UNION ALL SELECT par.parent, back.hops - 1 FROM back JOIN par ON par.id = back.id)"
_RELAX = ", ".join(["f0 AS MATERIALIZED (SELECT id, 0.0::DOUBLE AS total FROM v WHERE id = 'u1')"] + [f"f{i + 1} AS MATERIALIZED (SELECT id, min(total) AS total FROM (SELECT * FROM f{i} UNION ALL SELECT s.u, total + weight FROM f{i} JOIN s ON s.v = f{i}.id) GROUP BY id)" for i in range(40)])
_WPAR = _RELAX + ", par AS MATERIALIZED (SELECT x.id, x.total, min(y.id) AS parent FROM f40 x LEFT JOIN (s JOIN f40 y ON y.id = s.v) ON s.u = x.id AND y.total + s.weight = x.total AND x.id <> 'u1' GROUP BY 1, 2)"
#: Brandes from all vertices at once, to the end: forth counts shortest paths layer by layer and carries the layer before (old) along;
#: dep has each vertex's dependency by source, from the last layer back.
_BRANDES = """places AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id)::INT AS i FROM v),
links AS MATERIALIZED (SELECT a.i AS v, b.i AS u FROM s JOIN places a ON a.id = s.v JOIN places b ON b.id = s.u),
forth(source, i, hops, sigma, old) AS (SELECT i, i, 0, 1.0::DOUBLE, false FROM places UNION ALL
 SELECT source, i, min(hops), sum(sigma), max(age) = 1 FROM (SELECT f.source, links.u AS i, f.hops + 1 AS hops, f.sigma, 0 AS age FROM forth f JOIN links ON links.v = f.i WHERE NOT f.old
 UNION ALL SELECT source, i, hops, sigma, CASE WHEN old THEN 2 ELSE 1 END FROM forth) GROUP BY source, i HAVING max(age) < 2),
ahead AS MATERIALIZED (SELECT source, i, hops, sigma FROM forth WHERE NOT old),
back(source, i, hops, sigma, delta) AS (SELECT source, i, hops, sigma, 0.0::DOUBLE FROM ahead WHERE hops = (SELECT max(hops) FROM ahead) UNION ALL
 SELECT a.source, a.i, a.hops, a.sigma, a.sigma * coalesce(x.share, 0) FROM ahead a LEFT JOIN (SELECT w.source, links.v AS i, sum((1 + w.delta) / w.sigma) AS share FROM back w JOIN links ON links.u = w.i GROUP BY w.source, links.v) x
 ON x.source = a.source AND x.i = a.i WHERE a.hops = (SELECT max(hops) - 1 FROM back)),
dep AS MATERIALIZED (SELECT * FROM back)"""
_EDGE_DEP = """flow AS MATERIALIZED (SELECT least(x.i, y.i) AS i, greatest(x.i, y.i) AS j, sum(x.sigma * (1 + y.delta) / y.sigma) / 2 AS b FROM dep x JOIN links ON links.v = x.i JOIN dep y ON y.source = x.source AND y.i = links.u AND y.hops = x.hops + 1 GROUP BY 1, 2),
eflow AS MATERIALIZED (SELECT a.id AS src, c.id AS dst, b FROM flow JOIN places a ON a.i = flow.i JOIN places c ON c.i = flow.j)"""
_LP = ", ".join(["l0 AS MATERIALIZED (SELECT id, id AS label FROM v)"] + [f"l{i + 1} AS MATERIALIZED (SELECT l.id, coalesce(b.label, l.label) AS label FROM l{i} l LEFT JOIN (SELECT v, arg_min(label, (-n, label)) AS label FROM (SELECT s.v, label, count(*) AS n FROM s JOIN l{i} x ON x.id = s.u GROUP BY 1, 2) GROUP BY v) b ON b.v = l.id)" for i in range(5)])


QUERIES = {
    "shortest_path_hops": lambda s, d: path_by_hops(user_seq(s, d), A, B),
    "shortest_path_avoiding": lambda s, d: path_by_hops(user_seq(s, d), A, B, ("u2", "u3", "u5")),
    "shortest_path_waypoints": lambda s, d: path_through(user_seq(s, d), [A, "u7", B]),
    "shortest_path_weight": lambda s, d: path_by_weight(user_seq(s, d), A, B),
    "weighted_distances": lambda s, d: weighted_distances(user_seq(s, d), A),
    "power_graph": lambda s, d: power(user_seq(s, d), 2),
    "growth_profile": lambda s, d: growth_profile(user_seq(s, d), A),
    "ball_overlap": lambda s, d: ball_overlap(user_seq(s, d), A, B, 1),
    "distance_percentiles": lambda s, d: distance_percentiles(materialize(layer_sizes(user_seq(s, d)), "dist")),
    "betweenness": lambda s, d: brandes(user_seq(s, d))[0].select("id", rounded("betweenness", "betweenness")),
    "betweenness_edges": lambda s, d: brandes(user_seq(s, d))[1].select("src", "dst", rounded("betweenness", "betweenness")),
    "bridges": lambda s, d: bridges(user_seq(s, d, 4)),
    "label_propagation": lambda s, d: label_propagation(co_part(s, d)),
}
_BTW = user_sql("SELECT v.id, round(coalesce(b, 0), 6) AS betweenness FROM v LEFT JOIN (SELECT places.id, sum(delta) / 2 AS b FROM dep JOIN places USING (i) WHERE hops > 0 GROUP BY places.id) q ON q.id = v.id", _BRANDES)
_path = lambda a, b: _PAR.replace("{a}", a).replace("{b}", b)
SQL = {
    "shortest_path_hops": user_sql("SELECT hops AS step, id FROM back", _DIST + ", " + _path(A, B)),
    "shortest_path_avoiding": user_sql("SELECT hops AS step, id FROM back", _DIST + ", " + _path(A, B)).replace("s AS (SELECT src", "e2 AS (SELECT * FROM e WHERE src NOT IN ('u2', 'u3', 'u5') AND dst NOT IN ('u2', 'u3', 'u5')), s AS (SELECT src", 1).replace("weight FROM e UNION ALL SELECT dst, src, weight FROM e)", "weight FROM e2 UNION ALL SELECT dst, src, weight FROM e2)"),
    "shortest_path_waypoints": user_sql("SELECT hops AS step, id FROM back UNION ALL SELECT hops + (SELECT max(hops) FROM back), id FROM back2 WHERE hops > 0", _DIST + ", " + _path(A, "u7") + ", " + _path("u7", B).replace("par AS", "par2 AS").replace("par.", "par2.").replace("JOIN par ", "JOIN par2 ").replace("back(", "back2(").replace("back.", "back2.").replace("FROM back ", "FROM back2 ")),
    "weighted_distances": user_sql("SELECT id, total, parent FROM par", _WPAR),
    "shortest_path_weight": user_sql("SELECT ((SELECT max(k) FROM back) - k)::INT AS step, id, total FROM back JOIN par USING (id)", _WPAR + f", back(id, k) AS (SELECT id, 0 FROM par WHERE id = '{B}' UNION ALL SELECT par.parent, k + 1 FROM back JOIN par ON par.id = back.id WHERE par.parent IS NOT NULL)"),
    "power_graph": user_sql("SELECT source AS src, id AS dst FROM dist WHERE source < id AND hops <= 2", _DIST),
    "growth_profile": user_sql("SELECT hops, boundary, reached, round(CASE WHEN reached > boundary THEN boundary / (reached - boundary) ELSE 0 END, 6) AS rate FROM (SELECT hops, count(*) AS boundary, sum(count(*)) OVER (ORDER BY hops)::BIGINT AS reached FROM b GROUP BY hops)", _SEARCH.format(f"'{A}'")),
    "ball_overlap": user_sql(f"SELECT round(coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) / count(*), 1), 6) AS overlap FROM (SELECT id, count(DISTINCT source) AS n FROM dist WHERE source IN ('{A}', '{B}') AND hops <= 1 GROUP BY id)", _DIST),
    "distance_percentiles": user_sql("SELECT p, min(hops)::INT AS hops FROM (SELECT hops, sum(sum(bit_count(fresh))) OVER (ORDER BY hops) / 2 AS upto, sum(sum(bit_count(fresh))) OVER () / 2 AS total FROM w WHERE hops > 0 GROUP BY hops), (SELECT unnest([0.25::DOUBLE, 0.5, 0.9]) AS p) WHERE upto >= greatest(1, ceil(p * total)) GROUP BY p", _LAYERS),
    "betweenness": _BTW,
    "betweenness_edges": user_sql("SELECT e.src, e.dst, round(coalesce(b, 0), 6) AS betweenness FROM e LEFT JOIN eflow q ON q.src = e.src AND q.dst = e.dst", _BRANDES + ", " + _EDGE_DEP),
    "bridges": user_sql("SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.a = e.src AND cut.b = e.dst AND cut.id = e.dst)", "cut(a, b, id) AS (SELECT src, dst, src FROM e UNION SELECT cut.a, cut.b, s.u FROM cut JOIN s ON s.v = cut.id AND NOT (s.v = cut.a AND s.u = cut.b) AND NOT (s.v = cut.b AND s.u = cut.a))").replace("count(*) >= 2", "count(*) >= 4"),
    "label_propagation": sql("SELECT * FROM l5", _LP),
}
