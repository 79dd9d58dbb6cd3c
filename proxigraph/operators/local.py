"""Wedges and triangles: clustering, motifs, similarity, link prediction, brokerage, signs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxigraph.plans.graph import Graph, co_part, rounded, sql


def local_clustering(g: Graph) -> DataFrame:
    """2 links / (k(k-1)) for every vertex, 0 below two neighbours. Triangles come from the side of
    the lesser degree, so no hub pairs up its neighbours."""
    t = g.triangles().select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    k, n = F.col("degree"), F.coalesce("t", F.lit(0))
    return g.degrees().join(t, "id", "left").select("id", "degree", n.cast("long").alias("triangles"), rounded(F.when(k > 1, 2.0 * n / (k * (k - 1))).otherwise(0.0), "clustering"))


def average_clustering(g: Graph) -> DataFrame:
    c = local_clustering(g)
    wedges = F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    return c.agg(rounded(F.avg("clustering"), "average"), rounded(F.when(wedges > 0, F.sum("triangles") / wedges).otherwise(0.0), "transitivity"))


def open_wedges(g: Graph) -> DataFrame:
    """(m, a, b): a - m - b without an edge a - b."""
    e = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return g.wedges().join(e, ["a", "b"], "left_anti")


def squares(g: Graph) -> DataFrame:
    """Sum over non-adjacent pairs of C(common neighbours, 2); a chordless 4-cycle counts twice."""
    c = open_wedges(g).groupBy("a", "b").agg(F.count("*").alias("c"))
    return c.agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0)).cast("long").alias("squares"))


def motif_census(g: Graph) -> DataFrame:
    d = g.degrees()
    k = F.col("degree")
    choose = lambda r: {3: k * (k - 1) * (k - 2) / 6, 4: k * (k - 1) * (k - 2) * (k - 3) / 24}[r]
    w = d.agg(F.sum(k * (k - 1) / 2).cast("long").alias("wedges"), F.sum(choose(3)).cast("long").alias("stars3"), F.sum(choose(4)).cast("long").alias("stars4"))
    t = g.triangles().agg(F.count("*").alias("triangles"))
    return w.join(t).join(squares(g)).withColumn("paths", F.col("wedges") - 3 * F.col("triangles"))


def stars(g: Graph, least: int = 3) -> DataFrame:
    return g.degrees().filter(F.col("degree") >= least).select("id", "degree")


def common(g: Graph, adjacent: bool = True) -> DataFrame:
    """(a, b, common, aa, ra, du, dv): pairs with a common neighbour; sums of 1/ln deg (above 1) and
    1/deg over the common ones; degrees of both."""
    d = g.degrees()
    w = g.wedges() if adjacent else open_wedges(g)
    x = w.join(d.select(F.col("id").alias("m"), F.col("degree").alias("dm")), "m")
    c = x.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.when(F.col("dm") > 1, 1 / F.log("dm")).otherwise(0.0)).alias("aa"), F.sum(1.0 / F.col("dm")).alias("ra"), F.sum(F.col("dm") * F.col("dm")).alias("dd"))
    return c.join(d.select(F.col("id").alias("a"), F.col("degree").alias("du")), "a").join(d.select(F.col("id").alias("b"), F.col("degree").alias("dv")), "b")


def score(c: DataFrame, name: str, n: int | None = None):
    i, u, v = F.col("common"), F.col("du"), F.col("dv")
    return {"jaccard": i / (u + v - i), "overlap": i / F.least(u, v), "adamic_adar": F.col("aa"), "resource_allocation": F.col("ra"), "common_neighbors": i.cast("double"), "preferential_attachment": (u * v).cast("double")}[name]


def most_similar(g: Graph, metric: str, k: int = 20) -> DataFrame:
    """The k most similar pairs within two hops, adjacent or not."""
    c = common(g)
    return c.select("a", "b", rounded(score(c, metric), "score")).orderBy(F.desc("score"), "a", "b").limit(k)


def cosine_pairs(g: Graph, k: int = 20) -> DataFrame:
    """Cosine of neighbour vectors weighted by the neighbours' degrees."""
    d = g.degrees()
    norm = g.both().join(d.select(F.col("id").alias("u"), "degree"), "u").groupBy("v").agg(F.sum(F.col("degree") * F.col("degree")).alias("q"))
    c = common(g)
    x = c.join(norm.select(F.col("v").alias("a"), F.col("q").alias("qa")), "a").join(norm.select(F.col("v").alias("b"), F.col("q").alias("qb")), "b")
    return x.select("a", "b", rounded(F.col("dd") / F.sqrt(F.col("qa").cast("double") * F.col("qb")), "score")).orderBy(F.desc("score"), "a", "b").limit(k)


def predict_links(g: Graph, method: str, k: int = 20) -> DataFrame:
    """The k best non-adjacent pairs with a common neighbour."""
    c = common(g, adjacent=False)
    return c.select("a", "b", rounded(score(c, method), "score")).orderBy(F.desc("score"), "a", "b").limit(k)


def ensemble(g: Graph, k: int = 20) -> DataFrame:
    """Mean of four scores, each over its maximum, among non-adjacent pairs with a common neighbour."""
    c = common(g, adjacent=False)
    names = ("common_neighbors", "jaccard", "adamic_adar", "preferential_attachment")
    s = c.select("a", "b", *[score(c, m).alias(m) for m in names])
    top = s.agg(*[F.max(m).alias(f"top_{m}") for m in names])
    parts = [F.when(F.col(f"top_{m}") > 0, F.col(m) / F.col(f"top_{m}")).otherwise(0.0) for m in names]
    return s.join(F.broadcast(top)).select("a", "b", rounded(sum(parts[1:], parts[0]) / 4, "score")).orderBy(F.desc("score"), "a", "b").limit(k)


def triadic_closure(g: Graph, k: int = 20) -> DataFrame:
    c = open_wedges(g).groupBy("a", "b").agg(F.count("*").alias("common"))
    return c.select("a", "b", "common", rounded(F.least(F.lit(1.0), F.col("common") / 3), "likelihood")).orderBy(F.desc("likelihood"), F.desc("common"), "a", "b").limit(k)


def structural_holes(g: Graph) -> DataFrame:
    """Effective size, efficiency and constraint with p_ij = 1 / deg(i) also in the indirect term."""
    d = g.degrees().filter("degree > 0")
    t = g.triangles()
    # ego i, alter j, how many third vertices q are neighbours of both
    sides = [F.struct(F.col(i).alias("i"), F.col(j).alias("j")) for i, j in (("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"))]
    q = t.select(F.explode(F.array(*sides)).alias("x")).groupBy("x.i", "x.j").agg(F.count("*").alias("q"))
    pair = g.both().select(F.col("v").alias("i"), F.col("u").alias("j")).join(q, ["i", "j"], "left").join(d.select(F.col("id").alias("i"), F.col("degree").alias("k")), "i")
    p = 1 / F.col("k")
    c = F.coalesce("q", F.lit(0))
    per = pair.groupBy("i", "k").agg(F.sum(F.pow(p + c * p * p, 2)).alias("constraint"), F.sum(c).alias("ties"))
    size = F.greatest(F.lit(0.0), F.col("k") - F.col("ties") / F.col("k"))
    return per.select(F.col("i").alias("id"), rounded(size, "effective_size"), rounded(size / F.col("k"), "efficiency"), rounded("constraint", "constraint", 8))


def bridging_edges(g: Graph) -> DataFrame:
    """Edges whose ends share little: 1 - Jaccard of the neighbourhoods without the ends > 0.5."""
    t = g.triangles()
    q = t.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("a").alias("src"), F.col("c").alias("dst")), F.struct(F.col("b").alias("src"), F.col("c").alias("dst")))).alias("x")).groupBy("x.src", "x.dst").agg(F.count("*").alias("q"))
    d = g.degrees()
    e = g.edges.select("src", "dst").join(q, ["src", "dst"], "left").join(d.select(F.col("id").alias("src"), F.col("degree").alias("du")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dv")), "dst")
    i = F.coalesce("q", F.lit(0))
    union = F.col("du") - 1 + F.col("dv") - 1 - i
    return e.select("src", "dst", rounded(F.when(union > 0, 1 - i / union).otherwise(1.0), "bridge_score")).filter("bridge_score > 0.5")


def anomaly_scores(g: Graph) -> DataFrame:
    """Absolute z of degree, clustering and neighbour-degree deviation (population sd), as one length
    scaled to 100 for the largest."""
    c = local_clustering(g)
    nd = g.both().join(g.degrees().select(F.col("id").alias("u"), F.col("degree").alias("du")), "u").groupBy("v").agg(F.avg("du").alias("nd"))
    x = c.join(nd, F.col("id") == F.col("v"), "left").select("id", F.col("degree").cast("double").alias("m1"), F.col("clustering").alias("m2"), F.abs(F.col("degree") - F.coalesce("nd", F.lit(0.0))).alias("m3"))
    a = x.agg(*[f(f"m{i}").alias(f"{n}{i}") for i in (1, 2, 3) for f, n in ((F.avg, "a"), (F.stddev_pop, "s"))])
    z = [F.when(F.col(f"s{i}") > 0, F.abs((F.col(f"m{i}") - F.col(f"a{i}")) / F.col(f"s{i}"))).otherwise(0.0) for i in (1, 2, 3)]
    y = x.join(F.broadcast(a)).select("id", F.sqrt(z[0] * z[0] + z[1] * z[1] + z[2] * z[2]).alias("r"))
    top = y.agg(F.max("r").alias("top"))
    return y.join(F.broadcast(top)).select("id", rounded(F.when(F.col("top") > 0, 100 * F.col("r") / F.col("top")).otherwise(0.0), "score", 4))


def signed_census(g: Graph) -> DataFrame:
    """Triangles by number of negative edges; here types s and fs are negative."""
    sign = g.edges.select("src", "dst", F.when(F.col("type").isin("s", "fs"), 1).otherwise(0).alias("neg"))
    t = g.triangles()
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        t = t.join(sign.select(F.col("src").alias(x), F.col("dst").alias(y), F.col("neg").alias(f"n{x}{y}")), [x, y])
    return t.groupBy((F.col("nab") + F.col("nac") + F.col("nbc")).alias("negative")).agg(F.count("*").alias("triangles"))


def polarization(g: Graph) -> DataFrame:
    s = g.both("type").groupBy("v").agg(F.avg(F.when(F.col("type").isin("s", "fs"), 1.0).otherwise(0.0)).alias("p"))
    return g.vertices.join(s, F.col("id") == F.col("v"), "left").select("id", rounded(F.coalesce("p", F.lit(0.0)), "polarization"))


def equal_neighbourhoods(g: Graph) -> DataFrame:
    """Groups of at least two vertices with the same neighbours."""
    n = g.both().groupBy("v").agg(F.array_join(F.array_sort(F.collect_set("u")), ",").alias("nbrs"))
    return n.groupBy("nbrs").agg(F.count("*").alias("size"), F.min("v").alias("first")).filter("size > 1").select("first", "size")


def line_graph(g: Graph) -> DataFrame:
    """Pairs of edges that share an end, each once; the edges' names are their ends."""
    inc = g.both().select(F.col("v").alias("m"), F.concat_ws("|", F.least("v", "u"), F.greatest("v", "u")).alias("edge"))
    return inc.select("m", F.col("edge").alias("e1")).join(inc.select("m", F.col("edge").alias("e2")), "m").filter("e1 < e2").select("e1", "e2")


_TRI = "tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)"
_W = "w AS (SELECT x.v AS m, x.u AS a, y.u AS b FROM s x JOIN s y ON x.v = y.v AND x.u < y.u), ow AS (SELECT w.* FROM w ANTI JOIN e ON src = a AND dst = b)"
_COMMON = _W + """, cm AS (SELECT a, b, count(*) AS common, sum(CASE WHEN d.degree > 1 THEN 1 / ln(d.degree) ELSE 0 END) AS aa, sum(1.0::DOUBLE / d.degree) AS ra, sum(d.degree * d.degree) AS dd FROM {w} JOIN d ON d.id = m GROUP BY a, b),
c AS (SELECT cm.*, x.degree AS du, y.degree AS dv FROM cm JOIN d x ON x.id = a JOIN d y ON y.id = b)"""
_TOP = "SELECT a, b, round({}, 6) AS score FROM c ORDER BY score DESC, a, b LIMIT 20"
_SCORE = {"jaccard": "common / (du + dv - common)", "overlap": "common / least(du, dv)", "adamic_adar": "aa", "resource_allocation": "ra", "common_neighbors": "common::DOUBLE", "preferential_attachment": "(du * dv)::DOUBLE"}
_CLU = _TRI + ", t AS (SELECT id, count(*) AS t FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY id), cl AS (SELECT id, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN t USING (id))"
_Q = _TRI + ", q AS (SELECT i, j, count(*) AS q FROM (SELECT unnest([a, a, b, b, c, c]) AS i, unnest([b, c, a, c, a, b]) AS j FROM tri) GROUP BY i, j)"

QUERIES = {
    "local_clustering": lambda s, d: local_clustering(co_part(s, d)),
    "average_clustering": lambda s, d: average_clustering(co_part(s, d)),
    "triangles": lambda s, d: co_part(s, d).triangles(),
    "open_wedges": lambda s, d: open_wedges(co_part(s, d)),
    "motif_census": lambda s, d: motif_census(co_part(s, d)),
    "motif_stars": lambda s, d: stars(co_part(s, d)),
    "squares": lambda s, d: squares(co_part(s, d)),
    **{f"similar_{m}": (lambda s, d, m=m: most_similar(co_part(s, d), m)) for m in ("jaccard", "overlap", "adamic_adar")},
    "similar_cosine": lambda s, d: cosine_pairs(co_part(s, d)),
    **{f"predict_{m}": (lambda s, d, m=m: predict_links(co_part(s, d), m)) for m in ("common_neighbors", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment")},
    "predict_ensemble": lambda s, d: ensemble(co_part(s, d)),
    "triadic_closure": lambda s, d: triadic_closure(co_part(s, d)),
    "structural_holes": lambda s, d: structural_holes(co_part(s, d)),
    "bridging_edges": lambda s, d: bridging_edges(co_part(s, d)),
    "anomaly_scores": lambda s, d: anomaly_scores(co_part(s, d)),
    "signed_census": lambda s, d: signed_census(co_part(s, d)),
    "vertex_polarization": lambda s, d: polarization(co_part(s, d)),
    "quotient_equal_neighbourhoods": lambda s, d: equal_neighbourhoods(co_part(s, d)),
    "line_graph": lambda s, d: line_graph(co_part(s, d)),
}
SQL = {
    "local_clustering": sql("SELECT * FROM cl", _CLU),
    "average_clustering": sql("SELECT round(avg(clustering), 6) AS average, round(sum(triangles) / sum(degree * (degree - 1) / 2), 6) AS transitivity FROM cl", _CLU),
    "triangles": sql("SELECT a, b, c FROM tri", _TRI),
    "open_wedges": sql("SELECT m, a, b FROM ow", _W),
    "motif_census": sql("SELECT *, wedges - 3 * triangles AS paths FROM (SELECT sum(degree * (degree - 1) / 2)::BIGINT AS wedges, sum(degree * (degree - 1) * (degree - 2) / 6)::BIGINT AS stars3, sum(degree * (degree - 1) * (degree - 2) * (degree - 3) / 24)::BIGINT AS stars4 FROM d), (SELECT count(*) AS triangles FROM tri), (SELECT coalesce(sum(c * (c - 1) / 2), 0)::BIGINT AS squares FROM (SELECT count(*) AS c FROM ow GROUP BY a, b))", f"{_TRI}, {_W}"),
    "motif_stars": sql("SELECT id, degree FROM d WHERE degree >= 3"),
    "squares": sql("SELECT coalesce(sum(c * (c - 1) / 2), 0)::BIGINT AS squares FROM (SELECT count(*) AS c FROM ow GROUP BY a, b)", _W),
    **{f"similar_{m}": sql(_TOP.format(_SCORE[m]), _COMMON.format(w="w")) for m in ("jaccard", "overlap", "adamic_adar")},
    "similar_cosine": sql("SELECT a, b, round(dd / sqrt(x.q::DOUBLE * y.q), 6) AS score FROM c JOIN nq x ON x.v = a JOIN nq y ON y.v = b ORDER BY score DESC, a, b LIMIT 20", _COMMON.format(w="w") + ", nq AS (SELECT v, sum(degree * degree) AS q FROM s JOIN d ON id = u GROUP BY v)"),
    **{f"predict_{m}": sql(_TOP.format(_SCORE[m]), _COMMON.format(w="ow")) for m in ("common_neighbors", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment")},
    "predict_ensemble": sql("SELECT a, b, round((common / mc + common / (du + dv - common) / mj + aa / ma + du * dv / mp) / 4, 6) AS score FROM c, (SELECT max(common) AS mc, max(common / (du + dv - common)) AS mj, max(aa) AS ma, max(du * dv) AS mp FROM c) ORDER BY score DESC, a, b LIMIT 20", _COMMON.format(w="ow")),
    "triadic_closure": sql("SELECT a, b, count(*) AS common, round(least(1.0, count(*) / 3), 6) AS likelihood FROM ow GROUP BY a, b ORDER BY likelihood DESC, common DESC, a, b LIMIT 20", _W),
    "structural_holes": sql("SELECT i AS id, round(greatest(0, k - t / k), 6) AS effective_size, round(greatest(0, k - t / k) / k, 6) AS efficiency, round(con, 8) AS constraint FROM (SELECT s.v AS i, degree AS k, sum((1 / degree + coalesce(q, 0) / degree / degree) ** 2) AS con, sum(coalesce(q, 0)) AS t FROM s JOIN d ON id = v LEFT JOIN q ON i = v AND j = u GROUP BY s.v, degree)", _Q),
    "bridging_edges": sql("SELECT src, dst, sc AS bridge_score FROM (SELECT src, dst, round(CASE WHEN x.degree + y.degree - 2 - coalesce(q, 0) > 0 THEN 1 - coalesce(q, 0) / (x.degree + y.degree - 2 - coalesce(q, 0)) ELSE 1 END, 6) AS sc FROM e JOIN d x ON x.id = src JOIN d y ON y.id = dst LEFT JOIN q ON i = src AND j = dst) WHERE sc > 0.5", _Q),
    "anomaly_scores": sql("SELECT id, round(100 * r / max(r) OVER (), 4) AS score FROM (SELECT id, sqrt(((m1 - avg(m1) OVER ()) / stddev_pop(m1) OVER ()) ** 2 + coalesce(((m2 - avg(m2) OVER ()) / nullif(stddev_pop(m2) OVER (), 0)) ** 2, 0) + ((m3 - avg(m3) OVER ()) / stddev_pop(m3) OVER ()) ** 2) AS r FROM (SELECT id, degree AS m1, clustering AS m2, abs(degree - coalesce(nd, 0)) AS m3 FROM cl LEFT JOIN (SELECT s.v, avg(d.degree) AS nd FROM s JOIN d ON d.id = s.u GROUP BY s.v) ON v = id))", _CLU),
    "signed_census": sql("SELECT x.n + y.n + z.n AS negative, count(*) AS triangles FROM tri JOIN sg x ON x.src = a AND x.dst = b JOIN sg y ON y.src = a AND y.dst = c JOIN sg z ON z.src = b AND z.dst = c GROUP BY 1", _TRI + ", sg AS (SELECT src, dst, (type IN ('s', 'fs'))::INT AS n FROM e)"),
    "vertex_polarization": sql("SELECT id, round(coalesce(p, 0), 6) AS polarization FROM v LEFT JOIN (SELECT v AS x, avg((type IN ('s', 'fs'))::INT) AS p FROM s GROUP BY v) ON x = id"),
    "quotient_equal_neighbourhoods": sql("SELECT min(v) AS first, count(*) AS size FROM (SELECT v, string_agg(u, ',' ORDER BY u) AS n FROM s GROUP BY v) GROUP BY n HAVING count(*) > 1"),
    "line_graph": sql("SELECT x.edge AS e1, y.edge AS e2 FROM i x JOIN i y ON x.m = y.m AND x.edge < y.edge", "i AS (SELECT v AS m, least(v, u) || '|' || greatest(v, u) AS edge FROM s)"),
}
