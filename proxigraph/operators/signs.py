"""Signed graphs beyond the census, similarity of chosen vertices, and labels around vertices. Edges
of types s and fs are negative."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.operators.iterative import connected, two_colours
from proxigraph.operators.local import _TRI, signed_census
from proxigraph.plans.graph import Graph, co_part, rounded, sql
from proxigraph.plans.shared import materialize

NEGATIVE = ("s", "fs")


def _camps(g: Graph) -> tuple[DataFrame, DataFrame]:
    """((id, component) over positive edges, (a, b) components that negative edges join)."""
    neg = F.col("type").isin(*NEGATIVE)
    c = materialize(connected(Graph(g.vertices, g.edges.filter(~neg))), "camps")
    of = lambda x, y: c.select(F.col("id").alias(x), F.col("component").alias(y))
    return c, materialize(g.edges.filter(neg).select("src", "dst").join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("a", "b"), "camp-links")


def weak_balance(g: Graph) -> DataFrame:
    """One row: whether no negative edge lies inside a positive component, and how many do."""
    _, links = _camps(g)
    bad = F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)), F.lit(0)).cast("long")
    return links.agg(bad.alias("violations")).select((F.col("violations") == 0).alias("balanced"), "violations")


def strong_balance(g: Graph) -> DataFrame:
    """One row: whether the vertices fall into two camps with all negative edges between them: positive
    components become vertices, and the negative edges among them have to be bipartite."""
    c, links = _camps(g)
    inside = links.filter("a = b").agg(F.count("*").alias("k"))
    q = Graph(c.select(F.col("component").alias("id")).distinct(), links.filter("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    odd = two_colours(q).filter("not bipartite").agg(F.count("*").alias("odd"))
    return inside.join(odd).select(((F.col("k") == 0) & (F.col("odd") == 0)).alias("balanced"))  # one row each


def status_consistency(g: Graph) -> DataFrame:
    """One row: share of triangles with an even number of negative edges; 1 without triangles."""
    even = F.sum(F.when(F.col("negative") % 2 == 0, F.col("triangles")).otherwise(0)) / F.sum("triangles")
    return signed_census(g).agg(rounded(F.coalesce(even, F.lit(1.0)), "consistency"))


def predict_signs(g: Graph, vertex: str) -> DataFrame:
    """(id, sign) for every vertex that shares a neighbour with ``vertex``: the signum of the sum, over
    shared neighbours, of the products of signs."""
    sign = F.when(F.col("type").isin(*NEGATIVE), -1).otherwise(1)
    s = g.both(sign.alias("x"))
    mine = s.filter(F.col("v") == vertex).select(F.col("u").alias("v"), F.col("x").alias("y"))
    far = s.join(mine, "v").filter(F.col("u") != vertex)
    return far.groupBy(F.col("u").alias("id")).agg(F.signum(F.sum(F.col("x") * F.col("y"))).cast("int").alias("sign"))


def nearest(g: Graph, vertex: str, k: int) -> DataFrame:
    """(id, jaccard): the k other vertices whose neighbours are most like those of ``vertex``; vertices
    that share none score 0, so all others are ranked."""
    d = g.degrees()
    mine = g.both().filter(F.col("v") == vertex).select(F.col("u").alias("m"))
    shared = g.both().join(mine, F.col("u") == F.col("m")).groupBy(F.col("v").alias("id")).agg(F.count("*").alias("i"))
    own = d.filter(F.col("id") == vertex).select(F.col("degree").alias("k"))
    x = d.filter(F.col("id") != vertex).join(shared, "id", "left").join(F.broadcast(own)).withColumn("i", F.coalesce("i", F.lit(0)))
    union = F.col("degree") + F.col("k") - F.col("i")
    return x.select("id", rounded(F.when(union > 0, F.col("i") / union).otherwise(0.0), "jaccard")).orderBy(F.desc("jaccard"), "id").limit(k)


def structural_equivalence(g: Graph, vertex: str) -> DataFrame:
    """(id, share): of all vertices besides the two, the share that is a neighbour of both or of neither."""
    n = g.vertices.count()
    d = g.degrees()
    mine = g.both().filter(F.col("v") == vertex).select(F.col("u").alias("m"))
    shared = g.both().join(mine, F.col("u") == F.col("m")).groupBy(F.col("v").alias("id")).agg(F.count("*").alias("i"))
    own = d.filter(F.col("id") == vertex).select(F.col("degree").alias("k"))
    adjacent = mine.select(F.col("m").alias("id"), F.lit(1).alias("adj"))
    x = d.filter(F.col("id") != vertex).join(shared, "id", "left").join(adjacent, "id", "left").join(F.broadcast(own))
    differ = F.col("degree") + F.col("k") - 2 * F.coalesce("adj", F.lit(0)) - 2 * F.coalesce("i", F.lit(0))
    return x.select("id", rounded(1 - differ / (n - 2) if n > 2 else F.lit(1.0), "share"))


def similar_above(g: Graph, threshold: float) -> DataFrame:
    """(a, b, jaccard): pairs whose neighbourhoods are alike to ``threshold`` (above 0) or more.

    Lesser degree / greater degree bounds the Jaccard, so each vertex only meets, in its neighbours,
    others of a degree that can reach the threshold: by prefix, a vertex of degree k has to share
    one of its first k - ceil(t * k) + 1 neighbours in a common order, the rarest first.
    """
    s = g.both()
    d = materialize(g.degrees().filter("degree > 0"), "similar-degrees")
    rare = s.join(d.select(F.col("id").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("k")), "v")
    listed = rare.groupBy("v", "k").agg(F.sort_array(F.collect_list(F.struct("du", "u"))).alias("x"))
    listed = materialize(listed.select("v", "k", F.transform("x", lambda y: y["u"]).alias("x")), "similar-lists")
    first = (F.col("k") - F.ceil(threshold * F.col("k")) + 1).cast("int")
    short = listed.select("v", "k", F.explode(F.slice("x", F.lit(1), first)).alias("m"))
    a, b = short.select(F.col("v").alias("a"), F.col("k").alias("ka"), "m"), short.select(F.col("v").alias("b"), F.col("k").alias("kb"), "m")
    meet = a.join(b, "m").filter((F.col("a") < F.col("b")) & (F.least("ka", "kb") >= threshold * F.greatest("ka", "kb"))).select("a", "b").distinct()
    both = meet.join(listed.select(F.col("v").alias("a"), F.col("x").alias("p")), "a").join(listed.select(F.col("v").alias("b"), F.col("x").alias("q")), "b")
    j = F.size(F.array_intersect("p", "q")) / F.size(F.array_union("p", "q"))
    return both.select("a", "b", rounded(j, "jaccard")).filter(F.col("jaccard") >= threshold)


def homophily(g: Graph, labels: DataFrame) -> DataFrame:
    """One row: edges with both ends labelled, and the share whose labels are equal."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}"))
    e = g.edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").filter("l_src is not null and l_dst is not null")
    return e.agg(F.count("*").alias("edges"), rounded(F.coalesce(F.avg(F.when(F.col("l_src") == F.col("l_dst"), 1.0).otherwise(0.0)), F.lit(0.0)), "homophily"))


def label_entropy(g: Graph, labels: DataFrame) -> DataFrame:
    """(id, entropy): Shannon entropy of the neighbours' labels over ln of how many there are; 0 for one."""
    n = g.both().join(labels.select(F.col("id").alias("u"), "label"), "u").filter("label is not null").groupBy("v", "label").agg(F.count("*").alias("n"))
    a = n.groupBy("v").agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.col("n") * F.log("n")).alias("w"))
    h = (F.log("t") - F.col("w") / F.col("t")) / F.log("k")
    return g.vertices.join(a, F.col("id") == F.col("v"), "left").select("id", rounded(F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))).otherwise(0.0), "entropy"))


def cluster_ids(g: Graph, flags: dict[str, int] | None = None) -> DataFrame:
    """(id, types): which edge types a vertex has, as the concatenation of f, fs, c, s in this order."""
    has = lambda t: F.max(F.when(F.col("type") == t, 1).otherwise(0))
    x = g.both("type").groupBy("v").agg(*[has(t).alias(t) for t in ("f", "fs", "c", "s")])
    name = F.concat_ws("+", *[F.when(F.col(t) == 1, t) for t in ("f", "fs", "c", "s")])
    return g.vertices.join(x, F.col("id") == F.col("v"), "left").select("id", F.coalesce(name, F.lit("")).alias("types"))


def brands(s: SparkSession, d: str) -> DataFrame:
    from proxigraph.plans.session import table

    return table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("label"))


_POS = "pr(id, c) AS (SELECT id, id FROM v UNION SELECT s.u, pr.c FROM pr JOIN s ON s.v = pr.id AND s.type NOT IN ('s', 'fs')), pc AS (SELECT id, min(c) AS c FROM pr GROUP BY id), vi AS (SELECT count(*) AS n FROM e JOIN pc x ON x.id = src JOIN pc y ON y.id = dst WHERE type IN ('s', 'fs') AND x.c = y.c)"
_SHARE = "sh AS (SELECT s.v AS id, count(*) AS i FROM s JOIN s m ON m.u = s.u AND m.v = 'p7' GROUP BY s.v), k AS (SELECT degree AS k FROM d WHERE id = 'p7')"
_BRAND = "br AS (SELECT 'p' || p_partkey AS id, p_brand AS label FROM part)"
QUERIES = {
    "signed_weak_balance": lambda s, d: weak_balance(co_part(s, d)),
    "signed_strong_balance": lambda s, d: strong_balance(co_part(s, d)),
    "signed_status_consistency": lambda s, d: status_consistency(co_part(s, d)),
    "signed_prediction": lambda s, d: predict_signs(co_part(s, d), "p7"),
    "k_nearest": lambda s, d: nearest(co_part(s, d), "p7", 15),
    "structural_equivalence": lambda s, d: structural_equivalence(co_part(s, d), "p7"),
    "similar_above_threshold": lambda s, d: similar_above(co_part(s, d), 0.25),
    "global_homophily": lambda s, d: homophily(co_part(s, d), brands(s, d)),
    "label_entropy": lambda s, d: label_entropy(co_part(s, d), brands(s, d)),
    "vertex_edge_types": lambda s, d: cluster_ids(co_part(s, d)),
}
SQL = {
    "signed_weak_balance": sql("SELECT n = 0 AS balanced, n AS violations FROM vi", _POS),
    "signed_strong_balance": sql("SELECT count(*) = 0 AS balanced FROM par a JOIN par b ON a.root = b.root AND a.id = b.id AND a.p <> b.p", "rr(id, c) AS (SELECT id, id FROM v UNION SELECT s.u, rr.c FROM rr JOIN s ON s.v = rr.id), cc AS (SELECT DISTINCT min(c) AS root FROM rr GROUP BY id), par(root, id, p) AS (SELECT root, root, 0 FROM cc UNION SELECT par.root, s.u, CASE WHEN s.type IN ('s', 'fs') THEN 1 - par.p ELSE par.p END FROM par JOIN s ON s.v = par.id)"),
    "signed_status_consistency": sql("SELECT round(coalesce(sum(CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) / count(*), 1), 6) AS consistency FROM (SELECT (x.type IN ('s', 'fs'))::INT + (y.type IN ('s', 'fs'))::INT + (z.type IN ('s', 'fs'))::INT AS n FROM tri JOIN e x ON x.src = a AND x.dst = b JOIN e y ON y.src = b AND y.dst = c JOIN e z ON z.src = a AND z.dst = c)", _TRI),
    "signed_prediction": sql("SELECT y.u AS id, sign(sum(CASE WHEN (x.type IN ('s', 'fs')) = (y.type IN ('s', 'fs')) THEN 1 ELSE -1 END))::INT AS sign FROM s x JOIN s y ON y.v = x.u WHERE x.v = 'p7' AND y.u <> 'p7' GROUP BY y.u"),
    "k_nearest": sql("SELECT id, round(CASE WHEN degree + k - coalesce(i, 0) > 0 THEN coalesce(i, 0) / (degree + k - coalesce(i, 0)) ELSE 0 END, 6) AS jaccard FROM d LEFT JOIN sh USING (id), k WHERE id <> 'p7' ORDER BY jaccard DESC, id LIMIT 15", _SHARE),
    "structural_equivalence": sql("SELECT d.id, round(1 - (degree + k - 2 * (EXISTS (SELECT 1 FROM s WHERE s.v = 'p7' AND s.u = d.id))::INT - 2 * coalesce(i, 0)) / ((SELECT count(*) FROM v) - 2), 6) AS share FROM d LEFT JOIN sh USING (id), k WHERE d.id <> 'p7'", _SHARE),
    "similar_above_threshold": sql("SELECT * FROM (SELECT w.a, w.b, round(i / (x.degree + y.degree - i), 6) AS jaccard FROM (SELECT p.v AS a, q.v AS b, count(*) AS i FROM s p JOIN s q ON p.u = q.u AND p.v < q.v GROUP BY 1, 2) w JOIN d x ON x.id = a JOIN d y ON y.id = b) WHERE jaccard >= 0.25"),
    "global_homophily": sql("SELECT count(*) AS edges, round(coalesce(avg((x.label = y.label)::INT), 0), 6) AS homophily FROM e JOIN br x ON x.id = src JOIN br y ON y.id = dst WHERE x.label IS NOT NULL AND y.label IS NOT NULL", _BRAND),
    "label_entropy": sql("SELECT v.id, round(CASE WHEN k > 1 THEN greatest(0, least(1, (ln(t) - w / t) / ln(k))) ELSE 0 END, 6) AS entropy FROM v LEFT JOIN (SELECT v AS x, sum(n) AS t, count(*) AS k, sum(n * ln(n)) AS w FROM (SELECT s.v, br.label, count(*) AS n FROM s JOIN br ON br.id = s.u WHERE br.label IS NOT NULL GROUP BY 1, 2) GROUP BY v) q ON q.x = v.id", _BRAND),
    "vertex_edge_types": sql("SELECT v.id, coalesce(concat_ws('+', CASE WHEN f = 1 THEN 'f' END, CASE WHEN fs = 1 THEN 'fs' END, CASE WHEN c = 1 THEN 'c' END, CASE WHEN st = 1 THEN 's' END), '') AS types FROM v LEFT JOIN (SELECT v AS x, max((type = 'f')::INT) AS f, max((type = 'fs')::INT) AS fs, max((type = 'c')::INT) AS c, max((type = 's')::INT) AS st FROM s GROUP BY v) q ON q.x = v.id"),
}
