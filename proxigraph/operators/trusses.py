"""Truss numbers and what follows from them, from one table of triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxigraph.plans.graph import Graph, rounded, user_seq, user_sql
from proxigraph.plans.shared import drop, materialize


def truss_numbers(g: Graph, rounds: int = 1000) -> DataFrame:
    """(src, dst, support, truss): in how many triangles an edge lies, and the greatest k whose k-truss
    holds it; 2 for edges without a triangle.

    Starting from its support, each edge takes the h-index of its triangles, a triangle being worth
    the lesser value of its two other edges, until none changes; the fixpoint plus 2 is the truss
    number. All k are found at once, and an h-index comes from counts by value, so an edge with very
    many triangles is a few rows. An error if ``rounds`` do not settle it.
    """
    t = g.triangles()
    e = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    ab, ac, bc = e("a", "b"), e("a", "c"), e("b", "c")
    seen = F.array(*[F.struct(x.alias("e"), y.alias("f"), z.alias("h")) for x, y, z in ((ab, ac, bc), (ac, ab, bc), (bc, ab, ac))])
    met = materialize(t.select(F.explode(seen).alias("x")).select("x.*"), "truss-triangles")  # an edge and the two others
    value = materialize(met.groupBy("e").agg(F.count("*").alias("support")).select("e", "support", F.col("support").alias("t")), "truss")
    for _ in range(rounds):
        of = lambda x: value.select(F.col("e").alias(x), F.col("t").alias(f"t_{x}"))  # noqa: B023, E731
        worth = met.join(of("f"), "f").join(of("h"), "h").groupBy("e", F.least("t_f", "t_h").alias("t")).agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("e").orderBy(F.desc("t")))
        h = worth.withColumn("m", at_least).groupBy("e").agg(F.max(F.least("t", "m")).alias("h"))
        new = materialize(value.join(h, "e").select("e", "support", "t", F.least("t", "h").alias("h")), "truss")
        moved = not new.filter("h < t").isEmpty()
        drop(value)
        value = new.select("e", "support", F.col("h").alias("t"))
        value._proxigraph_path = new._proxigraph_path
        if not moved:
            break
    else:
        raise RuntimeError(f"truss numbers did not settle in {rounds} rounds")
    known = value.select("e.src", "e.dst", "support", "t")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return g.edges.select("src", "dst").join(known, ["src", "dst"], "left").select("src", "dst", zero("support").alias("support"), (zero("t") + 2).alias("truss"))


def truss_profile(g: Graph, numbers: DataFrame) -> DataFrame:
    """(k, edges, vertices, density) of the k-truss for every k from 2 to the greatest truss number."""
    n = materialize(numbers.select("src", "dst", "truss"), "truss-numbers")
    per = n.groupBy("truss").agg(F.count("*").alias("m"))
    ends = n.select(F.explode(F.array("src", "dst")).alias("id"), "truss").groupBy("id").agg(F.max("truss").alias("truss"))
    per = per.join(ends.groupBy("truss").agg(F.count("*").alias("n")), "truss", "left")
    ks = per.select(F.explode(F.sequence(F.lit(2), F.col("truss").cast("int"))).alias("k"), "m", "n")  # a few rows for each truss number
    x = ks.groupBy("k").agg(F.sum("m").alias("edges"), F.sum(F.coalesce("n", F.lit(0))).alias("vertices"))
    return x.select("k", "edges", "vertices", rounded(F.when(F.col("vertices") > 1, 2.0 * F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1))).otherwise(0.0), "density"))


_ROUNDS = 32


def _sql(rounds: int) -> str:
    """The same fixpoint with its rounds written out."""
    out = [
        "tri AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)",
        "mt AS MATERIALIZED (SELECT a || '|' || b AS e, a || '|' || c AS f, b || '|' || c AS h FROM tri UNION ALL SELECT a || '|' || c, a || '|' || b, b || '|' || c FROM tri UNION ALL SELECT b || '|' || c, a || '|' || b, a || '|' || c FROM tri)",
        "t0 AS MATERIALIZED (SELECT e, count(*) AS t FROM mt GROUP BY e)",
    ]
    for i in range(rounds):
        out.append(f"t{i + 1} AS MATERIALIZED (SELECT e, max(least(t, r)) AS t FROM (SELECT mt.e, least(x.t, y.t) AS t, row_number() OVER (PARTITION BY mt.e ORDER BY least(x.t, y.t) DESC) AS r FROM mt JOIN t{i} x ON x.e = mt.f JOIN t{i} y ON y.e = mt.h) GROUP BY e)")
    out.append(f"tn AS MATERIALIZED (SELECT src, dst, coalesce(s.t, 0)::BIGINT AS support, coalesce(x.t, 0)::BIGINT + 2 AS truss FROM e LEFT JOIN t0 s ON s.e = src || '|' || dst LEFT JOIN t{rounds} x ON x.e = src || '|' || dst)")
    return ", ".join(out)


_DENSE = _sql(_ROUNDS)
QUERIES = {
    "truss_numbers": lambda s, d: truss_numbers(user_seq(s, d)),
    "truss_profile": lambda s, d: (lambda g: truss_profile(g, truss_numbers(g)))(user_seq(s, d)),
}
SQL = {
    "truss_numbers": user_sql("SELECT * FROM tn", _DENSE),
    "truss_profile": user_sql("SELECT k::INT AS k, m AS edges, n AS vertices, round(CASE WHEN n > 1 THEN 2.0 * m / (n * (n - 1)) ELSE 0 END, 6) AS density FROM (SELECT k, count(*) AS m FROM (SELECT unnest(range(2, (SELECT max(truss) FROM tn) + 1)) AS k) JOIN tn ON truss >= k GROUP BY k) JOIN (SELECT k, count(DISTINCT id) AS n FROM (SELECT unnest(range(2, (SELECT max(truss) FROM tn) + 1)) AS k) JOIN (SELECT unnest([src, dst]) AS id, truss FROM tn) ON truss >= k GROUP BY k) USING (k)", _DENSE),
}
