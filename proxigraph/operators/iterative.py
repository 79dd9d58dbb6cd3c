"""Fixpoints over edge tables: every round is a join and an aggregation, written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.plans.components import components
from proxigraph.plans.graph import Graph, co_part, rounded, sql, user_seq, user_sql
from proxigraph.plans.numbering import numbered
from proxigraph.plans.shared import drop, materialize

LAYER_ROWS = 30_000_000  # rows that a layer of a batch of sources can have at most


def connected(g: Graph) -> DataFrame:
    """(id, component) of every vertex; component is its least id."""
    c = components(g.edges)
    return g.vertices.join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def community_report(g: Graph) -> DataFrame:
    """Components with size, inner edges and total weight."""
    c = connected(g)
    e = g.edges.join(c.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    return c.groupBy("component").agg(F.count("*").alias("size")).join(e, "component", "left").select("component", "size", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def levels(g: Graph, seeds: DataFrame, rounds: int = 10_000, most: int | None = None) -> DataFrame:
    """(id, source, hops): breadth first from every row (id, source) of ``seeds`` at once, up to ``most`` hops.

    Neighbours of a level lie in it or next to it, so only the last two levels are looked at and
    each is written once. An error if ``rounds`` do not reach the end."""
    s = materialize(g.both(), "bfs-links")
    done, now, before = None, materialize(seeds.select("id", "source", F.lit(0).alias("hops")).distinct(), "bfs"), None
    parts = [now]
    for h in range(1, (rounds if most is None else most) + 1):
        nxt = now.join(s, F.col("id") == F.col("v")).select(F.col("u").alias("id"), "source").distinct()
        for old in (now, before):
            if old is not None:
                nxt = nxt.join(old.select("id", "source"), ["id", "source"], "left_anti")
        new = materialize(nxt.withColumn("hops", F.lit(h)), "bfs")
        if new.isEmpty():
            drop(new)
            break
        parts.append(new)
        before, now = now, new
        if len(parts) > 24:  # a plan of a few scans
            done = materialize(reduce(DataFrame.unionByName, parts[:-2] if done is None else [done, *parts[:-2]]), "bfs")
            parts = parts[-2:]
    else:
        if most is None:
            raise RuntimeError(f"not all levels were reached in {rounds} rounds")
    return reduce(DataFrame.unionByName, parts if done is None else [done, *parts])


def bfs(g: Graph, source: str) -> DataFrame:
    return levels(g, g.vertices.filter(F.col("id") == source).withColumn("source", F.col("id"))).select("id", "hops")


def layer_sizes(g: Graph) -> DataFrame:
    """(id, hops, n): how many vertices of an undirected graph lie so many hops from each, itself at 0.

    Breadth first from all vertices, 64 of them as the bits of a row: (id, word, bits) are those of a word's sources that
    reach id at this layer. Distances are symmetric, so bits are counted where they arrive. As many words are
    searched at once as LAYER_ROWS allows; of the layers only the last two are kept, and counts."""
    s = materialize(g.both().distinct(), "layer-links")
    i = F.col("i") - 1
    v = materialize(numbered(g.vertices.select("id"), [F.col("id")], "i").select("id", F.floor(i / 64).alias("word"), F.expr("shiftleft(1L, cast((i - 1) % 64 as int))").alias("bits")), "layer-sources")
    n = v.count()
    most, zero, counted = max(1, LAYER_ROWS // max(1, n)), F.lit(0).cast("long"), []
    for first in range(0, -(-n // 64), most):
        now, before, h = materialize(v.filter(F.col("word").between(first, first + most - 1)), "layer"), None, 0
        held = [(h, now)]
        while True:
            offer = now.join(s, F.col("id") == F.col("v")).select(F.col("u").alias("id"), "word", F.col("bits").alias("new"), zero.alias("old"))
            for table in (now, before):
                if table is not None:
                    offer = offer.unionByName(table.select("id", "word", zero.alias("new"), F.col("bits").alias("old")))
            x = offer.groupBy("id", "word").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
            h, before, now = h + 1, now, materialize(x.select("id", "word", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("bits")).filter("bits <> 0"), "layer")
            over = now.isEmpty()
            done = held if over else held[:-1]  # the next round looks at the last one
            if over or len(done) == 8:
                sizes = [t.select("id", F.lit(k).alias("hops"), F.bit_count("bits").alias("n")) for k, t in done]
                counted.append(materialize(reduce(DataFrame.unionByName, sizes).groupBy("id", "hops").agg(F.sum("n").alias("n")), "layer-sizes"))
                for _, t in done:
                    drop(t)
                held = held[len(done) :]
            if over:
                drop(now)
                break
            held.append((h, now))
    none = v.select("id", F.lit(0).alias("hops"), zero.alias("n")).limit(0)
    return reduce(DataFrame.unionByName, counted, none).groupBy("id", "hops").agg(F.sum("n").alias("n"))


def distance_summary(sizes: DataFrame, n: int) -> DataFrame:
    k, h = F.col("pairs"), F.col("hops")
    a = histogram(sizes).agg(F.coalesce(F.sum(k), F.lit(0)).alias("pairs"), F.sum(h * k).alias("wiener"), F.sum(F.expr("hops * (hops + 1) div 2") * k).alias("hyper_wiener"), F.sum(k / h).alias("h"), F.max(h).alias("diameter"))
    return a.select("pairs", "wiener", "hyper_wiener", rounded("h", "harary"), "diameter", rounded(F.col("wiener") / F.col("pairs"), "avg_path"), rounded(2 * F.col("h") / (n * (n - 1)), "efficiency"))


def eccentricity(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("id").agg(F.max("hops").alias("ecc"))


def closeness(sizes: DataFrame, n: int) -> DataFrame:
    """r^2 / ((n - 1) sum of distances), r the number of vertices reached."""
    a = sizes.groupBy("id").agg((F.sum("n") - 1).alias("r"), F.sum(F.col("hops") * F.col("n")).alias("s"))
    return a.select("id", rounded(F.when(F.col("s") > 0, F.col("r") * F.col("r") / ((n - 1) * F.col("s"))).otherwise(0.0), "closeness"))


def histogram(sizes: DataFrame) -> DataFrame:
    """(hops, pairs) of different vertices, each pair counted once."""
    return sizes.filter("hops > 0").groupBy("hops").agg(F.expr("sum(n) div 2").alias("pairs"))


def pagerank(g: Graph, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, exact_rounds: int | None = None) -> DataFrame:
    """Undirected PageRank; mass of vertices without edges is spread over all. Stops when the ranks
    change by less than ``tolerance`` in sum, with an error if ``rounds`` do not reach that, or after exactly
    ``exact_rounds``."""
    d = materialize(g.degrees(), "pr-degrees")
    n = d.count()
    if n == 0:
        return d.select("id", F.lit(0.0).alias("rank"))
    s = materialize(g.both().join(d.select(F.col("id").alias("v"), "degree"), "v").select("v", "u", "degree"), "pr-links")
    r = materialize(d.select("id", "degree", F.lit(1.0 / n).alias("rank")), "pr")
    for _ in range(exact_rounds or rounds):
        loose = r.agg(F.sum(F.when(F.col("degree") == 0, F.col("rank")))).first()[0] or 0.0
        got = s.join(r.select(F.col("id").alias("v"), "rank"), "v").groupBy(F.col("u").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("x"))
        new = materialize(r.join(got, "id", "left").select("id", "degree", "rank", ((1 - damping) / n + damping * (F.coalesce("x", F.lit(0.0)) + loose / n)).alias("new")), "pr")
        moved = new.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0]
        drop(r)
        r = new.select("id", "degree", F.col("new").alias("rank"))
        r._proxigraph_path = new._proxigraph_path
        if exact_rounds is None and moved < tolerance:
            break
    else:
        if exact_rounds is None:
            raise RuntimeError(f"the ranks did not settle in {rounds} rounds")
    return r.select("id", "rank")


def rank_compare(ranks: DataFrame, g: Graph, top: int = 20) -> DataFrame:
    """Places by rank and by degree, for those among the first ``top`` of either: vertices ahead of
    each of these few are counted, so nothing is numbered as a whole."""
    x = materialize(ranks.join(g.degrees(), "id").select("id", F.round("rank", 12).alias("rank"), F.col("degree")), "rank-compare")
    a, b = x.orderBy(F.desc("rank"), "id").limit(top), x.orderBy(F.desc("degree"), "id").limit(top)
    few = a.union(b).distinct().select(F.col("id").alias("i"), F.col("rank").alias("r"), F.col("degree").alias("d"))
    ahead = lambda c, k: F.sum(F.when((F.col(c) > F.col(k)) | ((F.col(c) == F.col(k)) & (F.col("id") <= F.col("i"))), 1).otherwise(0))
    n = x.join(F.broadcast(few)).groupBy("i").agg(ahead("rank", "r").alias("by_rank"), ahead("degree", "d").alias("by_degree"))  # 2 * top rows
    return n.select(F.col("i").alias("id"), "by_rank", "by_degree", (F.col("by_degree") - F.col("by_rank")).alias("shift"))


def coreness(g: Graph, rounds: int = 1000) -> DataFrame:
    """(id, core): starting from degrees, each vertex takes the h-index of its neighbours' values
    until none changes; the fixpoint is the core number. h-indices come from counts by value."""
    d = materialize(g.degrees(), "core-degrees")
    s = materialize(g.both(), "core-links")
    c = materialize(d.select("id", F.col("degree").alias("core")), "core")
    for _ in range(rounds):
        n = s.join(c.select(F.col("id").alias("u"), "core"), "u").groupBy("v", "core").agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("v").orderBy(F.desc("core")))
        h = n.withColumn("m", at_least).groupBy("v").agg(F.max(F.least("core", "m")).alias("h"))
        new = materialize(c.join(h, F.col("id") == F.col("v"), "left").select("id", F.col("core").alias("old"), F.coalesce("h", F.lit(0)).cast("long").alias("core")), "core")
        changed = new.filter("old <> core").limit(1).count()
        drop(c)
        c = new.select("id", "core")
        c._proxigraph_path = new._proxigraph_path
        if not changed:
            return c
    raise RuntimeError(f"core numbers did not settle in {rounds} rounds")


def core_profile(g: Graph) -> DataFrame:
    """Vertices, edges and density of every k-core."""
    c = coreness(g)
    e = g.edges.join(c.select(F.col("id").alias("src"), F.col("core").alias("cu")), "src").join(c.select(F.col("id").alias("dst"), F.col("core").alias("cv")), "dst").groupBy(F.least("cu", "cv").alias("core")).agg(F.count("*").alias("e"))
    n = c.groupBy("core").agg(F.count("*").alias("n")).join(e, "core", "left")
    w = Window.orderBy(F.desc("core"))
    x = n.select("core", F.sum("n").over(w).alias("vertices"), F.sum(F.coalesce("e", F.lit(0))).over(w).alias("edges"))
    return x.select("core", "vertices", "edges", rounded(F.when(F.col("vertices") > 1, 2.0 * F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1))).otherwise(0.0), "density"))


def truss(g: Graph, k: int) -> DataFrame:
    """Edges of the k-truss: peel those with fewer than k - 2 triangles until none is left to peel."""
    e = materialize(g.edges.select("src", "dst"), "truss")
    m = e.count()
    while True:
        t = Graph(g.vertices, e).triangles()
        sides = [F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))]
        n = t.select(F.explode(F.array(*sides)).alias("x")).groupBy("x.src", "x.dst").agg(F.count("*").alias("n"))
        new = materialize(e.join(n.filter(F.col("n") >= k - 2), ["src", "dst"], "left_semi"), "truss")
        left = new.count()
        drop(e)
        e = new
        if left == m:
            return e
        m = left


def voronoi(g: Graph, seeds: list[str]) -> DataFrame:
    """(id, seed, hops): the nearest seed, of equals the least."""
    v = g.vertices.filter(F.col("id").isin(seeds)).withColumn("source", F.col("id"))
    best = levels(g, v).groupBy("id").agg(F.min(F.struct("hops", "source")).alias("x"))
    return best.select("id", F.col("x.source").alias("seed"), F.col("x.hops").alias("hops"))


def spanning_forest(g: Graph) -> DataFrame:
    """(src, dst, weight) of the minimum spanning forest by Boruvka rounds; ties by ends, so it is unique."""
    e = materialize(g.edges.select("src", "dst", "weight"), "mst-edges")
    chosen = None
    label = materialize(g.vertices.select("id", F.col("id").alias("c")), "mst-labels")
    while True:
        x = e.join(label.select(F.col("id").alias("src"), F.col("c").alias("cu")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("cv")), "dst").filter("cu <> cv")
        pick = x.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("weight", "src", "dst").alias("k")).groupBy("c").agg(F.min("k").alias("k"))
        new = materialize(pick.select("k.src", "k.dst", "k.weight").distinct(), "mst-picked")
        if new.isEmpty():
            break
        both = new if chosen is None else materialize(chosen.unionByName(new), "mst")
        chosen = both
        drop(label)
        c = components(chosen)
        label = materialize(g.vertices.join(c, "id", "left").select("id", F.coalesce("component", "id").alias("c")), "mst-labels")
    return chosen if chosen is not None else e.limit(0)


def two_colours(g: Graph) -> DataFrame:
    """(component, bipartite): whether breadth-first parity from the least vertex holds on all edges."""
    c = materialize(connected(g), "bip")
    p = levels(g, c.select(F.col("component").alias("id"), F.col("component").alias("source")).distinct()).select("id", (F.col("hops") % 2).alias("p"))
    bad = g.edges.join(p.select(F.col("id").alias("src"), F.col("p").alias("pu")), "src").join(p.select(F.col("id").alias("dst"), F.col("p").alias("pv")), "dst").filter("pu = pv").join(c.withColumnRenamed("id", "src"), "src").select("component").distinct().withColumn("odd", F.lit(True))
    return c.select("component").distinct().join(bad, "component", "left").select("component", F.col("odd").isNull().alias("bipartite"))


def orbits(g: Graph, rounds: int = 3) -> DataFrame:
    """(id, colour) after so many rounds of colour refinement from degrees."""
    c = g.degrees().select("id", F.sha2(F.col("degree").cast("string"), 256).alias("colour"))
    for _ in range(rounds):
        n = g.both().join(c.select(F.col("id").alias("u"), F.col("colour").alias("cu")), "u").groupBy("v").agg(F.array_join(F.array_sort(F.collect_list("cu")), "").alias("around"))
        c = materialize(c.join(n, F.col("id") == F.col("v"), "left").select("id", F.sha2(F.concat("colour", F.coalesce("around", F.lit(""))), 256).alias("colour")), "orbits")
    return c


_RR = "rr(id, c) AS (SELECT id, id FROM v UNION SELECT s.u, rr.c FROM rr JOIN s ON s.v = rr.id), comp AS (SELECT id, min(c) AS component FROM rr GROUP BY id)"
#: To the end, a row for each vertex and source: the first to reach it stays.
_SEARCH = "b(id, source, hops) USING KEY (id, source) AS (SELECT id, id, 0 FROM v WHERE id IN ({}) UNION SELECT s.u, b.source, min(b.hops) + 1 FROM b JOIN s ON s.v = b.id WHERE NOT EXISTS (SELECT 1 FROM recurring.b r WHERE r.id = s.u AND r.source = b.source) GROUP BY s.u, b.source)"
_DIST = "dd(source, id, hops) AS (SELECT id, id, 0 FROM v UNION SELECT source, s.u, hops + 1 FROM dd JOIN s ON s.v = dd.id WHERE hops < 12), dist AS (SELECT source, id, min(hops) AS hops FROM dd GROUP BY source, id)"


def _pagerank_sql(k: int) -> str:
    out = ["p0 AS (SELECT id, degree, 1.0::DOUBLE / (SELECT count(*) FROM d) AS r FROM d)"]
    for i in range(k):
        out.append(f"p{i + 1} AS (SELECT a.id, a.degree, 0.15 / (SELECT count(*) FROM d) + 0.85 * (coalesce(x, 0) + (SELECT coalesce(sum(r), 0) FROM p{i} WHERE degree = 0) / (SELECT count(*) FROM d)) AS r FROM p{i} a LEFT JOIN (SELECT s.u, sum(r / degree) AS x FROM s JOIN p{i} b ON b.id = s.v GROUP BY s.u) ON u = a.id)")
    return ", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out)


def _core_sql(k: int) -> str:
    out = ["c0 AS MATERIALIZED (SELECT id, degree AS core FROM d)"]
    for i in range(k):
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT d.id, coalesce(h, 0)::BIGINT AS core FROM d LEFT JOIN (SELECT v, max(least(core, r)) AS h FROM (SELECT s.v, core, row_number() OVER (PARTITION BY s.v ORDER BY core DESC) AS r FROM s JOIN c{i} ON c{i}.id = s.u) GROUP BY v) ON v = d.id)")
    return ", ".join(out)


_TRI = "tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)"
_ORBITS = ", ".join(["o0 AS MATERIALIZED (SELECT id, sha256(degree::VARCHAR) AS colour FROM d)"] + [f"o{i + 1} AS MATERIALIZED (SELECT o.id, sha256(o.colour || coalesce(a, '')) AS colour FROM o{i} o LEFT JOIN (SELECT s.v, string_agg(x.colour, '' ORDER BY x.colour) AS a FROM s JOIN o{i} x ON x.id = s.u GROUP BY s.v) ON v = o.id)" for i in range(3)])


def _dist(f):
    def run(s: SparkSession, d: str) -> DataFrame:
        g = user_seq(s, d)
        return f(materialize(layer_sizes(g), "dist"), g.vertices.count())

    return run


QUERIES = {
    "components": lambda s, d: connected(co_part(s, d)),
    "community_report": lambda s, d: community_report(co_part(s, d)),
    "bfs_levels": lambda s, d: bfs(user_seq(s, d), "u1"),
    "distance_histogram": _dist(lambda x, n: histogram(x)),
    "eccentricity": _dist(lambda x, n: eccentricity(x)),
    "closeness": _dist(closeness),
    "wiener": _dist(distance_summary),
    "pagerank_k": lambda s, d: pagerank(co_part(s, d), exact_rounds=5).select("id", rounded("rank", "rank", 9)),
    "rank_compare": lambda s, d: rank_compare(pagerank(co_part(s, d), exact_rounds=5), co_part(s, d)),
    "kcore": lambda s, d: coreness(co_part(s, d)),
    "core_density_profile": lambda s, d: core_profile(co_part(s, d)),
    "ktruss": lambda s, d: truss(co_part(s, d), 3),
    "voronoi": lambda s, d: voronoi(user_seq(s, d), ["u1", "u2", "u3"]),
    "mst": lambda s, d: spanning_forest(co_part(s, d)),
    "bipartite_test": lambda s, d: two_colours(co_part(s, d)),
    "symmetry_orbits": lambda s, d: orbits(co_part(s, d)),
}
SQL = {
    "components": sql("SELECT * FROM comp", _RR),
    "community_report": sql("SELECT component, size, coalesce(edges, 0) AS edges, coalesce(weight, 0) AS weight FROM (SELECT component, count(*) AS size FROM comp GROUP BY 1) LEFT JOIN (SELECT component, count(*) AS edges, sum(weight) AS weight FROM e JOIN comp ON id = src GROUP BY 1) USING (component)", _RR),
    "bfs_levels": user_sql("SELECT id, hops::INT AS hops FROM b", _SEARCH.format("'u1'")),
    "distance_histogram": user_sql("SELECT hops::INT AS hops, count(*) AS pairs FROM dist WHERE source < id GROUP BY 1", _DIST),
    "eccentricity": user_sql("SELECT id, max(hops)::INT AS ecc FROM dist GROUP BY id", _DIST),
    "closeness": user_sql("SELECT id, round(CASE WHEN sum(hops) > 0 THEN (count(*) - 1) * (count(*) - 1) / (((SELECT count(*) FROM v) - 1) * sum(hops)) ELSE 0 END, 6) AS closeness FROM dist GROUP BY id", _DIST),
    "wiener": user_sql("SELECT count(*) AS pairs, sum(hops)::BIGINT AS wiener, sum((hops + hops * hops) / 2)::BIGINT AS hyper_wiener, round(sum(1 / hops), 6) AS harary, max(hops)::INT AS diameter, round(sum(hops) / count(*), 6) AS avg_path, round(2 * sum(1 / hops) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 6) AS efficiency FROM dist WHERE source < id", _DIST),
    "pagerank_k": sql("SELECT id, round(r, 9) AS rank FROM p5", _pagerank_sql(5)),
    "rank_compare": sql("SELECT id, a AS by_rank, b AS by_degree, b - a AS shift FROM (SELECT id, row_number() OVER (ORDER BY round(r, 12) DESC, id) AS a, row_number() OVER (ORDER BY degree DESC, id) AS b FROM p5) WHERE a <= 20 OR b <= 20", _pagerank_sql(5)),
    "kcore": sql("SELECT * FROM c40", _core_sql(40)),
    "core_density_profile": sql("SELECT core, vertices, edges, round(CASE WHEN vertices > 1 THEN 2.0 * edges / (vertices * (vertices - 1)) ELSE 0 END, 6) AS density FROM (SELECT core, sum(n) OVER (ORDER BY core DESC)::BIGINT AS vertices, sum(coalesce(k, 0)) OVER (ORDER BY core DESC)::BIGINT AS edges FROM (SELECT core, count(*) AS n FROM c40 GROUP BY core) LEFT JOIN (SELECT least(x.core, y.core) AS core, count(*) AS k FROM e JOIN c40 x ON x.id = src JOIN c40 y ON y.id = dst GROUP BY 1) USING (core))", _core_sql(40)),
    "ktruss": sql("SELECT DISTINCT src, dst FROM (SELECT unnest([a, a, b]) AS src, unnest([b, c, c]) AS dst FROM tri)", _TRI),
    "symmetry_orbits": sql("SELECT * FROM o3", _ORBITS),
    "voronoi": user_sql("SELECT id, arg_min(source, (hops, source)) AS seed, min(hops)::INT AS hops FROM b GROUP BY id", _SEARCH.format("'u1', 'u2', 'u3'")),
    "bipartite_test": sql("SELECT component, bool_and(NOT odd) AS bipartite FROM (SELECT c.component, EXISTS (SELECT 1 FROM par a JOIN par b ON a.id = b.id AND a.p <> b.p AND a.id = c.id) AS odd FROM comp c) GROUP BY component", _RR + ", par(id, p) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT s.u, 1 - par.p FROM par JOIN s ON s.v = par.id)"),
}
