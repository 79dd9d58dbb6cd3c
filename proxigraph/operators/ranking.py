"""Rankings of vertices: degree centrality, what PageRank says beyond it, agreement of measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.operators.iterative import _pagerank_sql, pagerank
from proxigraph.operators.local import _CLU, local_clustering
from proxigraph.plans.graph import Graph, co_part, rounded, sql
from proxigraph.plans.numbering import numbered
from proxigraph.plans.shared import materialize

#: Bounds of rank times vertex count, and names: fixed values.
BUCKETS = ((2.0, "very_high"), (1.5, "high"), (0.5, "average"), (0.25, "low"))


def degree_centrality(g: Graph) -> DataFrame:
    """(id, degree, centrality): degree over n - 1; 0 for a single vertex."""
    n = g.vertices.count()
    return g.degrees().select("id", "degree", rounded(F.col("degree") / (n - 1) if n > 1 else F.lit(0.0), "centrality"))


def top_by(metrics: DataFrame, metric: str, k: int) -> DataFrame:
    """The k first rows by a metric, largest first; an unknown metric means degree."""
    return metrics.orderBy(F.desc(metric if metric in metrics.columns else "degree"), "id").limit(k)


def ranks(g: Graph, rounds: int = 5) -> DataFrame:
    """(id, rank, degree, n): PageRank, degree, and the number of vertices."""
    n = g.vertices.count()
    return materialize(pagerank(g, exact_rounds=rounds).join(g.degrees(), "id").withColumn("n", F.lit(n)), "ranks")


def buckets(r: DataFrame) -> DataFrame:
    """(bucket, vertices): vertices by rank times their number."""
    x = F.round(F.col("rank") * F.col("n"), 9)
    name = F.when(x > BUCKETS[0][0], BUCKETS[0][1]).when(x > BUCKETS[1][0], BUCKETS[1][1]).when(x >= BUCKETS[2][0], BUCKETS[2][1]).when(x >= BUCKETS[3][0], BUCKETS[3][1]).otherwise("very_low")
    return r.groupBy(name.alias("bucket")).agg(F.count("*").alias("vertices"))


def hidden_influencers(r: DataFrame, threshold: float) -> DataFrame:
    """(id, degree, ratio): rank times n over degree centrality above the threshold; no isolated vertices."""
    c = F.col("degree") / (F.col("n") - 1)
    x = r.filter("degree > 0 and n > 1").select("id", "degree", rounded(F.col("rank") * F.col("n") / c, "ratio", 4))
    return x.filter(F.col("ratio") > threshold)


def gini(values: DataFrame, value: str, ties: str = "id") -> DataFrame:
    """One row: sum of (2 i - n - 1) x_i over n times the total, x ascending; 0 without a total."""
    x = numbered(values.select(value, ties), [F.col(value), F.col(ties)], "i")
    n = F.count("*")
    a = x.agg(n.alias("n"), F.sum(value).alias("s"), F.sum(F.col("i") * F.col(value)).alias("w"))
    g = (2 * F.col("w") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))
    return a.select(rounded(F.when(F.col("s") > 0, g).otherwise(0.0), "gini"))


def entropy_ratio(r: DataFrame) -> DataFrame:
    """One row: Shannon entropy of the ranks over ln n."""
    a = r.agg((-F.sum(F.when(F.col("rank") > 0, F.col("rank") * F.log("rank")))).alias("h"), F.count("*").alias("n"))
    return a.select(rounded(F.when(F.col("n") > 1, F.col("h") / F.log("n")).otherwise(0.0), "entropy_ratio"))


def ordinal(m: DataFrame, names: list[str]) -> DataFrame:
    """``m`` (id, metrics) with by_<name>: places 1..n, largest first, ties by id."""
    for c in names:
        m = numbered(m, [F.desc(c), F.col("id")], f"by_{c}")
    return m


def spearman(places: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, rho) of each pair of measures from their places; 0 below two vertices."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    d = [F.sum(F.pow((F.col(f"by_{a}") - F.col(f"by_{b}")).cast("double"), 2)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]
    agg = places.agg(F.count("*").cast("double").alias("n"), *d)
    rho = lambda i: F.when(F.col("n") > 1, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 1 - 6 * F.col(f"d{i}") / (F.col("n") * (F.col("n") * F.col("n") - 1))))).otherwise(0.0)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(rho(i), 6).alias("rho")) for i, (a, b) in enumerate(pairs)])
    return agg.select(F.explode(rows).alias("x")).select("x.*")


def discordant(places: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """(id, a, b, gap): places that differ by at least ceil(threshold * (n - 1))."""
    n = places.count()
    least = -int(-threshold * (n - 1) // 1)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(F.col(f"by_{a}") - F.col(f"by_{b}")).alias("gap")) for a, b in pairs])
    return places.select("id", F.explode(rows).alias("x")).select("id", "x.*").filter(F.col("gap") >= least)


_NAMES = ["degree", "clustering", "rank"]


def _places(s: SparkSession, d: str) -> DataFrame:
    g = co_part(s, d)
    m = ranks(g).select("id", F.round("rank", 12).alias("rank"), "degree").join(local_clustering(g).select("id", "clustering"), "id")
    return ordinal(m, _NAMES)


_P = _pagerank_sql(5) + ", r AS (SELECT id, r AS rank, degree, (SELECT count(*) FROM d) AS n FROM p5)"
_PL = _P + ", " + _CLU + ", pl AS MATERIALIZED (SELECT r.id, row_number() OVER (ORDER BY r.degree DESC, r.id) AS by_degree, row_number() OVER (ORDER BY clustering DESC, r.id) AS by_clustering, row_number() OVER (ORDER BY round(rank, 12) DESC, r.id) AS by_rank FROM r JOIN cl ON cl.id = r.id)"
_PAIRS = [("degree", "clustering"), ("degree", "rank"), ("clustering", "rank")]
QUERIES = {
    "degree_centrality": lambda s, d: degree_centrality(co_part(s, d)),
    "top_by_metric": lambda s, d: top_by(local_clustering(co_part(s, d)), "clustering", 10),
    "rank_buckets": lambda s, d: buckets(ranks(co_part(s, d))),
    "hidden_influencers": lambda s, d: hidden_influencers(ranks(co_part(s, d)), 1.0),
    "pagerank_gini": lambda s, d: gini(ranks(co_part(s, d)), "rank"),
    "pagerank_entropy_ratio": lambda s, d: entropy_ratio(ranks(co_part(s, d))),
    "full_ranking": lambda s, d: numbered(ranks(co_part(s, d)).select("id", F.round("rank", 9).alias("rank")), [F.desc("rank"), F.col("id")], "place"),
    "centrality_spearman": lambda s, d: spearman(_places(s, d), _NAMES),
    "discordant_nodes": lambda s, d: discordant(_places(s, d), _NAMES, 0.8),
}
SQL = {
    "degree_centrality": sql("SELECT id, degree, round(degree / ((SELECT count(*) FROM v) - 1), 6) AS centrality FROM d"),
    "top_by_metric": sql("SELECT id, degree, triangles::BIGINT AS triangles, clustering FROM cl ORDER BY clustering DESC, id LIMIT 10", _CLU),
    "rank_buckets": sql("SELECT CASE WHEN x > 2 THEN 'very_high' WHEN x > 1.5 THEN 'high' WHEN x >= 0.5 THEN 'average' WHEN x >= 0.25 THEN 'low' ELSE 'very_low' END AS bucket, count(*) AS vertices FROM (SELECT round(rank * n, 9) AS x FROM r) GROUP BY 1", _P),
    "hidden_influencers": sql("SELECT * FROM (SELECT id, degree, round(rank * n / (degree / (n - 1)), 4) AS ratio FROM r WHERE degree > 0) WHERE ratio > 1.0", _P),
    "pagerank_gini": sql("SELECT round((2 * sum(i * rank) - (count(*) + 1) * sum(rank)) / (count(*) * sum(rank)), 6) AS gini FROM (SELECT rank, row_number() OVER (ORDER BY rank, id) AS i FROM r)", _P),
    "pagerank_entropy_ratio": sql("SELECT round(-sum(rank * ln(rank)) / ln(count(*)), 6) AS entropy_ratio FROM r", _P),
    "full_ranking": sql("SELECT id, round(rank, 9) AS rank, row_number() OVER (ORDER BY round(rank, 9) DESC, id) AS place FROM r", _P),
    "centrality_spearman": sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(1 - 6 * sum(((by_{a} - by_{b})::DOUBLE) ** 2) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM pl" for a, b in _PAIRS), _PL),
    "discordant_nodes": sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{a}' AS a, '{b}' AS b, abs(by_{a} - by_{b}) AS gap FROM pl" for a, b in _PAIRS) + ") WHERE gap >= ceil(0.8 * ((SELECT count(*) FROM v) - 1))", _PL),
}
