"""Walks and opinions: stationary distribution, DeGroot averaging, advice from triads and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.plans.graph import Graph, co_part, rounded, sql
from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize


def stationary(g: Graph) -> DataFrame:
    """deg(v) / sum of degrees; uniform without edges."""
    d = g.degrees()
    t = d.agg(F.sum("degree").alias("s"), F.count("*").alias("n"))
    return d.join(F.broadcast(t)).select("id", rounded(F.when(F.col("s") > 0, F.col("degree") / F.col("s")).otherwise(1 / F.col("n")), "p", 9))


def degroot(g: Graph, opinions: DataFrame, steps: int) -> DataFrame:
    """(id, opinion): each step takes the weighted mean of one's own (weight 1) and the neighbours'."""
    s = materialize(g.both("weight"), "degroot-links")
    now = opinions.select("id", F.col("opinion").cast("double").alias("opinion"))
    for _ in range(steps):
        n = s.join(now.select(F.col("id").alias("u"), F.col("opinion").alias("x")), "u").groupBy("v").agg(F.sum(F.col("weight") * F.col("x")).alias("a"), F.sum("weight").alias("w"))
        now = materialize(now.join(n, F.col("id") == F.col("v"), "left").select("id", ((F.col("opinion") + F.coalesce("a", F.lit(0.0))) / (1 + F.coalesce("w", F.lit(0.0)))).alias("opinion")), "degroot")
    return now


def homophily(g: Graph, labels: DataFrame) -> DataFrame:
    """Per vertex the share of neighbours with its own label; null without labelled neighbours."""
    l = lambda c, n: labels.select(F.col("id").alias(c), F.col("label").alias(n))  # noqa: E731, E741
    e = g.both().join(l("v", "lv"), "v").join(l("u", "lu"), "u")
    return e.groupBy(F.col("v").alias("id")).agg(rounded(F.avg(F.when(F.col("lv") == F.col("lu"), 1.0).otherwise(0.0)), "homophily"))


def triad_scores(g: Graph) -> DataFrame:
    """Open and closed triads around each vertex, with bridging 20 log10(1 + open) and bonding
    25 log10(1 + closed), at most 100 each."""
    t = g.triangles().select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("closed"))
    d = g.degrees().join(t, "id", "left").withColumn("closed", F.coalesce("closed", F.lit(0)))
    d = d.withColumn("open", (F.col("degree") * (F.col("degree") - 1) / 2).cast("long") - F.col("closed"))
    return d.select("id", "open", "closed", rounded(F.least(F.lit(100.0), 20 * F.log10(1 + F.col("open"))), "bridging"), rounded(F.least(F.lit(100.0), 25 * F.log10(1 + F.col("closed"))), "bonding"))


def _opinions(s, d) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") / 50).alias("opinion"), F.col("p_brand").alias("label"))


def _degroot_sql(k: int) -> str:
    out = ["o0 AS MATERIALIZED (SELECT 'p' || p_partkey AS id, p_size / 50 AS x FROM part)"]
    for i in range(k):
        out.append(f"o{i + 1} AS MATERIALIZED (SELECT id, (x + coalesce(a, 0)) / (1 + coalesce(w, 0)) AS x FROM o{i} LEFT JOIN (SELECT s.v, sum(weight * x) AS a, sum(weight) AS w FROM s JOIN o{i} ON o{i}.id = s.u GROUP BY s.v) ON v = id)")
    return ", ".join(out)


_TRI = "tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)"
QUERIES = {
    "stationary_distribution": lambda s, d: stationary(co_part(s, d)),
    "opinion_degroot": lambda s, d: degroot(co_part(s, d), _opinions(s, d), 3).select("id", rounded("opinion", "opinion")),
    "echo_homophily": lambda s, d: homophily(co_part(s, d), _opinions(s, d)),
    "triad_advisor_scores": lambda s, d: triad_scores(co_part(s, d)),
}
SQL = {
    "stationary_distribution": sql("SELECT id, round(degree / sum(degree) OVER (), 9) AS p FROM d"),
    "opinion_degroot": sql("SELECT id, round(x, 6) AS opinion FROM o3", _degroot_sql(3)),
    "echo_homophily": sql("SELECT s.v AS id, round(avg((a.label = b.label)::INT), 6) AS homophily FROM s JOIN lab a ON a.id = s.v JOIN lab b ON b.id = s.u GROUP BY s.v", "lab AS (SELECT 'p' || p_partkey AS id, p_brand AS label FROM part)"),
    "triad_advisor_scores": sql("SELECT id, open, closed, round(least(100, 20 * log10(1 + open)), 6) AS bridging, round(least(100, 25 * log10(1 + closed)), 6) AS bonding FROM (SELECT id, coalesce(t, 0) AS closed, (degree * (degree - 1) / 2)::BIGINT - coalesce(t, 0) AS open FROM d LEFT JOIN (SELECT id, count(*) AS t FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY id) USING (id))", _TRI),
}
