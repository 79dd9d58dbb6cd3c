"""Degree distributions, entropies, assortativity, rich clubs and the quality of clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxigraph.plans.graph import Graph, co_part, rounded, sql
from proxigraph.plans.session import table

PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def graph_stats(g: Graph) -> DataFrame:
    """Density 2m / (n(n-1)), mean degree, isolated vertices, total and mean weight."""
    d = g.degrees().agg(F.count("*").alias("n"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("isolated"))
    e = g.edges.agg(F.count("*").alias("m"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))
    n, m = F.col("n"), F.col("m")
    return d.join(e).select("n", "m", "isolated", rounded(F.when(n < 2, 0.0).otherwise(2.0 * m / (n * (n - 1))), "density"), rounded(F.when(n > 0, 2.0 * m / n).otherwise(0.0), "avg_degree"), "total_weight", rounded(F.when(m > 0, F.col("total_weight") / m).otherwise(0.0), "avg_weight"))


def top_hubs(g: Graph, k: int = 10) -> DataFrame:
    return g.degrees().orderBy(F.desc("degree"), "id").limit(k)


def degree_stats(g: Graph) -> DataFrame:
    """Mean, sample variance, adjusted skewness, excess kurtosis and percentiles (linear on (n-1)p),
    from power sums in one pass; mode: least of the most frequent degrees."""
    d = g.degrees()
    x = F.col("degree").cast("double")
    pct = F.percentile("degree", [p / 100 for p in PERCENTILES])
    a = d.agg(F.count("*").alias("n"), F.min("degree").alias("lo"), F.max("degree").alias("hi"), F.avg(x).alias("mean"), F.sum(x * x).alias("s2"), F.sum(x * x * x).alias("s3"), F.sum(x * x * x * x).alias("s4"), pct.alias("p"))
    mode = d.groupBy("degree").agg(F.count("*").alias("c")).agg(F.max(F.struct("c", -F.col("degree"))).alias("x")).select((-F.col("x.col2")).alias("mode"))
    n, mu = F.col("n").cast("double"), F.col("mean")  # powers of n leave the range of longs at 2.1 M vertices
    m2 = F.col("s2") - n * mu * mu
    m3 = F.col("s3") - 3 * mu * F.col("s2") + 2 * n * mu * mu * mu
    m4 = F.col("s4") - 4 * mu * F.col("s3") + 6 * mu * mu * F.col("s2") - 3 * n * mu * mu * mu * mu
    var = F.when(n > 1, m2 / (n - 1)).otherwise(0.0)
    sd = F.sqrt(var)
    skew = F.when((n > 2) & (var > 0), n / ((n - 1) * (n - 2)) * m3 / (sd * sd * sd)).otherwise(0.0)
    kurt = F.when((n > 3) & (var > 0), n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * m4 / (var * var) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))).otherwise(0.0)
    return a.join(mode).select("n", "lo", "hi", "mode", rounded("mean", "mean"), rounded(var, "variance"), rounded(skew, "skewness", 4), rounded(kurt, "kurtosis", 4), *[rounded(F.get("p", F.lit(i)), f"p{q}") for i, q in enumerate(PERCENTILES)])


def degree_cdf(g: Graph) -> DataFrame:
    """PDF, CDF and CCDF by ascending degree; the window runs over distinct degrees only."""
    h = g.degrees().groupBy("degree").agg(F.count("*").alias("c"))
    w = Window.orderBy("degree")
    run, total = F.sum("c").over(w), F.sum("c").over(Window.partitionBy())
    return h.select("degree", rounded(F.col("c") / total, "pdf"), rounded(run / total, "cdf"), rounded(1 - run / total, "ccdf"))


def power_law(g: Graph) -> DataFrame:
    """Least squares of ln p(k) on ln k for k >= 1; scale-free iff 1.5 <= gamma <= 3.5 and R2 >= 0.7."""
    h = g.degrees().groupBy("degree").agg(F.count("*").alias("c"))
    n = h.agg(F.sum("c").alias("n"))
    xy = h.join(n).filter("degree >= 1").select(F.log("degree").alias("x"), F.log(F.col("c") / F.col("n")).alias("y"))
    a = xy.agg(F.count("*").alias("k"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("b"), F.regr_r2("y", "x").alias("r2"))
    gamma = -F.col("slope")
    return a.select("k", rounded(gamma, "gamma", 4), rounded("b", "intercept", 4), rounded("r2", "r2", 4), (gamma.between(1.5, 3.5) & (F.col("r2") >= 0.7)).alias("scale_free"))


def _ends(g: Graph) -> DataFrame:
    d = g.degrees()
    return g.edges.select("src", "dst", "type").join(d.select(F.col("id").alias("src"), F.col("degree").alias("du")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dv")), "dst")


def assortativity(g: Graph) -> DataFrame:
    """Newman's degree correlation over edges with symmetric halves, within [-1, 1]."""
    e = _ends(g)
    a = e.agg(F.count("*").alias("m"), F.sum(F.col("du") * F.col("dv")).alias("p"), F.sum((F.col("du") + F.col("dv")) * 0.5).alias("s"), F.sum((F.col("du") * F.col("du") + F.col("dv") * F.col("dv")) * 0.5).alias("q"))
    m = F.col("m")
    top, low = F.col("p") / m - F.pow(F.col("s") / m, 2), F.col("q") / m - F.pow(F.col("s") / m, 2)
    return a.select(rounded(F.when((m == 0) | (low == 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), top / low))), "assortativity"))


def albertson(g: Graph) -> DataFrame:
    d = g.degrees().agg((F.min("degree") == F.max("degree")).alias("regular"))
    return _ends(g).agg(F.coalesce(F.sum(F.abs(F.col("du") - F.col("dv"))), F.lit(0)).alias("albertson")).join(d)


def entropy(counts: DataFrame, name: str) -> DataFrame:
    """Shannon entropy in bits of the counts in column c."""
    p = F.col("c") / F.col("n")
    return counts.join(counts.agg(F.sum("c").alias("n"))).agg(rounded(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)), name))


def degree_entropy(g: Graph) -> DataFrame:
    return entropy(g.degrees().groupBy("degree").agg(F.count("*").alias("c")), "entropy")


def edge_type_entropy(g: Graph) -> DataFrame:
    return entropy(g.edges.groupBy(F.coalesce("type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("c")), "entropy")


def neighbourhood_entropy(g: Graph) -> DataFrame:
    """Entropy of the degrees of each vertex's neighbours; isolated vertices count 0 in the mean."""
    d = g.degrees()
    c = g.both().join(d.select(F.col("id").alias("u"), "degree"), "u").groupBy("v", "degree").agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    per = c.join(c.groupBy("v").agg(F.sum("c").alias("n")), "v").groupBy("v").agg((-F.sum(p * F.log2(p))).alias("h"))
    return d.join(per, F.col("id") == F.col("v"), "left").agg(rounded(F.avg(F.coalesce("h", F.lit(0.0))), "mean_entropy"))


def walk_entropy_rate(g: Graph) -> DataFrame:
    d = g.degrees().filter("degree > 0")
    x = F.col("degree")
    return d.agg(rounded(F.log2(F.sum(x)) - F.sum(x * F.log2(x)) / F.sum(x), "rate"))


def rich_club(g: Graph) -> DataFrame:
    """phi(k) = 2 E>k / (N>k (N>k - 1)) for every k below the highest degree: histograms of degrees
    and of edges' lesser degree, summed from above."""
    d = g.degrees()
    n = d.groupBy("degree").agg(F.count("*").alias("n"))
    e = _ends(g).groupBy(F.least("du", "dv").alias("degree")).agg(F.count("*").alias("e"))
    top = d.agg(F.max("degree").alias("top"))
    ks = top.select(F.explode(F.when(F.col("top") > 0, F.sequence(F.lit(0).cast("long"), F.col("top") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("k"))
    h = n.join(e, "degree", "left").select((F.col("degree") - 1).alias("k"), "n", F.coalesce("e", F.lit(0)).alias("e"))
    w = Window.orderBy(F.desc("k"))
    all_k = ks.join(h, "k", "left").select("k", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("nk"), F.sum(F.coalesce("e", F.lit(0))).over(w).alias("ek"))
    return all_k.select("k", "nk", "ek", rounded(F.when(F.col("nk") > 1, 2 * F.col("ek") / (F.col("nk") * (F.col("nk") - 1))).otherwise(0.0), "phi"))


def cluster_quality(g: Graph, labels: DataFrame) -> DataFrame:
    """Per cluster: size, inner and cut edges, volume, density, conductance; ``labels(id, label)``."""
    d = g.degrees().join(labels, "id")
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    e = g.edges.select("src", "dst").join(a, "src", "left").join(b, "dst", "left")
    inner = e.filter("la = lb").groupBy(F.col("la").alias("label")).agg(F.count("*").alias("inner"))
    cut = e.filter("not (la <=> lb)").select(F.explode(F.array("la", "lb")).alias("label")).filter("label is not null").groupBy("label").agg(F.count("*").alias("cut"))
    c = d.groupBy("label").agg(F.count("*").alias("size"), F.sum("degree").alias("vol")).join(inner, "label", "left").join(cut, "label", "left").na.fill(0, ["inner", "cut"])
    m = g.edges.agg(F.count("*").alias("m"))
    low = F.least(F.col("vol"), 2 * F.col("m") - F.col("vol"))
    return c.join(m).select("label", "size", "inner", "cut", "vol", rounded(F.when(F.col("size") > 1, 2 * F.col("inner") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0), "density"), rounded(F.when(low > 0, F.col("cut") / low).otherwise(0.0), "conductance"), rounded(F.col("inner") / F.col("m") - F.pow(F.col("vol") / (2 * F.col("m")), 2), "modularity_part"))


def _contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id", F.col("label").alias("x")).join(b.select("id", F.col("label").alias("y")), "id").groupBy("x", "y").agg(F.count("*").alias("c"))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mutual information in bits over the mean of the two entropies; 0 if both are 0."""
    t = _contingency(a, b)
    n = t.agg(F.sum("c").alias("n"))
    x, y = t.groupBy("x").agg(F.sum("c").alias("cx")), t.groupBy("y").agg(F.sum("c").alias("cy"))
    mi = t.join(x, "x").join(y, "y").join(n).agg(F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"))
    h = lambda df, c, name: df.join(n).agg((-F.sum(F.col(c) / F.col("n") * F.log2(F.col(c) / F.col("n")))).alias(name))
    return mi.join(h(x, "cx", "hx")).join(h(y, "cy", "hy")).select(rounded(F.when(F.col("hx") + F.col("hy") == 0, 0.0).otherwise(2 * F.col("mi") / (F.col("hx") + F.col("hy"))), "nmi"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    t = _contingency(a, b)
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    s = t.agg(two("c").alias("s"), F.sum("c").alias("n"))
    x, y = t.groupBy("x").agg(F.sum("c").alias("k")).agg(two("k").alias("a")), t.groupBy("y").agg(F.sum("c").alias("k")).agg(two("k").alias("b"))
    expected = F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2)
    half = (F.col("a") + F.col("b")) / 2
    return s.join(x).join(y).select(rounded(F.when(half == expected, 0.0).otherwise((F.col("s") - expected) / (half - expected)), "ari"))


def _brands(s, d) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("label"))


def _sizes(s, d) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") % 7).cast("string").alias("label"))


_LAB = "lab AS (SELECT 'p' || p_partkey AS id, p_brand AS label, (p_size % 7)::VARCHAR AS other FROM part)"
_ENDS = "ee AS (SELECT src, dst, a.degree AS du, b.degree AS dv FROM e JOIN d a ON a.id = src JOIN d b ON b.id = dst)"
_PCT = ", ".join(f"round(quantile_cont(degree, {p / 100}), 6) AS p{p}" for p in PERCENTILES)
QUERIES = {
    "graph_stats": lambda s, d: graph_stats(co_part(s, d)),
    "top_hubs": lambda s, d: top_hubs(co_part(s, d)),
    "degree_stats": lambda s, d: degree_stats(co_part(s, d)),
    "degree_cdf": lambda s, d: degree_cdf(co_part(s, d)),
    "power_law": lambda s, d: power_law(co_part(s, d)),
    "assortativity": lambda s, d: assortativity(co_part(s, d)),
    "regularity_albertson": lambda s, d: albertson(co_part(s, d)),
    "degree_entropy": lambda s, d: degree_entropy(co_part(s, d)),
    "edge_type_entropy": lambda s, d: edge_type_entropy(co_part(s, d)),
    "neighbourhood_entropy": lambda s, d: neighbourhood_entropy(co_part(s, d)),
    "walk_entropy_rate": lambda s, d: walk_entropy_rate(co_part(s, d)),
    "rich_club": lambda s, d: rich_club(co_part(s, d)),
    "cluster_quality": lambda s, d: cluster_quality(co_part(s, d), _brands(s, d)),
    "nmi": lambda s, d: nmi(_brands(s, d), _sizes(s, d)),
    "adjusted_rand": lambda s, d: adjusted_rand(_brands(s, d), _sizes(s, d)),
}
SQL = {
    "graph_stats": sql("SELECT n, m, isolated, round(2.0 * m / (n * (n - 1)), 6) AS density, round(2.0 * m / n, 6) AS avg_degree, w AS total_weight, round(w / m, 6) AS avg_weight FROM (SELECT count(*) AS n, sum((degree = 0)::INT)::BIGINT AS isolated FROM d), (SELECT count(*) AS m, sum(weight) AS w FROM e)"),
    "top_hubs": sql("SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 10"),
    "degree_stats": sql(f"SELECT count(*) AS n, min(degree) AS lo, max(degree) AS hi, (SELECT degree FROM d GROUP BY degree ORDER BY count(*) DESC, degree LIMIT 1) AS mode, round(avg(degree), 6) AS mean, round(var_samp(degree), 6) AS variance, round(skewness(degree), 4) AS skewness, round(kurtosis(degree), 4) AS kurtosis, {_PCT} FROM d"),
    "degree_cdf": sql("SELECT degree, round(c / sum(c) OVER (), 6) AS pdf, round(sum(c) OVER (ORDER BY degree) / sum(c) OVER (), 6) AS cdf, round(1 - sum(c) OVER (ORDER BY degree) / sum(c) OVER (), 6) AS ccdf FROM (SELECT degree, count(*) AS c FROM d GROUP BY degree)"),
    "power_law": sql("SELECT count(*) AS k, round(-regr_slope(y, x), 4) AS gamma, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 4) AS r2, -regr_slope(y, x) BETWEEN 1.5 AND 3.5 AND regr_r2(y, x) >= 0.7 AS scale_free FROM (SELECT ln(degree) AS x, ln(count(*) / (SELECT count(*) FROM d)) AS y FROM d WHERE degree >= 1 GROUP BY degree)"),
    "assortativity": sql("SELECT round((p / m - (s / m) ** 2) / (q / m - (s / m) ** 2), 6) AS assortativity FROM (SELECT count(*) AS m, sum(du * dv) AS p, sum((du + dv) / 2) AS s, sum((du * du + dv * dv) / 2) AS q FROM ee)", _ENDS),
    "regularity_albertson": sql("SELECT sum(abs(du - dv))::BIGINT AS albertson, (SELECT min(degree) = max(degree) FROM d) AS regular FROM ee", _ENDS),
    "degree_entropy": sql("SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM d) AS p FROM d GROUP BY degree)"),
    "edge_type_entropy": sql("SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM e) AS p FROM e GROUP BY type)"),
    "neighbourhood_entropy": sql("SELECT round(avg(coalesce(h, 0)), 6) AS mean_entropy FROM d LEFT JOIN (SELECT v, -sum(p * log2(p)) AS h FROM (SELECT s.v, count(*) / sum(count(*)) OVER (PARTITION BY s.v) AS p FROM s JOIN d ON d.id = s.u GROUP BY s.v, degree) GROUP BY v) ON v = id"),
    "walk_entropy_rate": sql("SELECT round(log2(sum(degree)) - sum(degree * log2(degree)) / sum(degree), 6) AS rate FROM d WHERE degree > 0"),
    "rich_club": sql("SELECT k, nk, ek, round(CASE WHEN nk > 1 THEN 2 * ek / (nk * (nk - 1)) ELSE 0 END, 6) AS phi FROM (SELECT k, (SELECT count(*) FROM d WHERE degree > k) AS nk, (SELECT count(*) FROM ee WHERE du > k AND dv > k) AS ek FROM (SELECT unnest(range(0, (SELECT max(degree) FROM d))) AS k))", _ENDS),
    "cluster_quality": sql("""SELECT c.label, size, coalesce(i.n, 0) AS inner, coalesce(x.n, 0) AS cut, vol, round(CASE WHEN size > 1 THEN 2 * coalesce(i.n, 0) / (size * (size - 1)) ELSE 0 END, 6) AS density,
 round(CASE WHEN least(vol, 2 * m - vol) > 0 THEN coalesce(x.n, 0) / least(vol, 2 * m - vol) ELSE 0 END, 6) AS conductance, round(coalesce(i.n, 0) / m - (vol / (2 * m)) ** 2, 6) AS modularity_part
 FROM (SELECT label, count(*) AS size, sum(degree)::BIGINT AS vol FROM d JOIN lab USING (id) GROUP BY label) c LEFT JOIN (SELECT la AS label, count(*) AS n FROM el WHERE la = lb GROUP BY la) i USING (label)
 LEFT JOIN (SELECT label, count(*) AS n FROM (SELECT unnest([la, lb]) AS label FROM el WHERE la <> lb) GROUP BY label) x USING (label), (SELECT count(*) AS m FROM e)""", f"{_LAB}, el AS (SELECT a.label AS la, b.label AS lb FROM e JOIN lab a ON a.id = src JOIN lab b ON b.id = dst)"),
    "nmi": f"WITH {_LAB}, t AS (SELECT label AS x, other AS y, count(*) AS c FROM lab GROUP BY ALL), n AS (SELECT sum(c) AS n FROM t), x AS (SELECT x, sum(c) AS cx FROM t GROUP BY x), y AS (SELECT y, sum(c) AS cy FROM t GROUP BY y) SELECT round(2 * (SELECT sum(c / n * log2(c * n / (cx * cy))) FROM t JOIN x USING (x) JOIN y USING (y), n) / ((SELECT -sum(cx / n * log2(cx / n)) FROM x, n) + (SELECT -sum(cy / n * log2(cy / n)) FROM y, n)), 6) AS nmi",
    "adjusted_rand": f"WITH {_LAB}, t AS (SELECT label AS x, other AS y, count(*) AS c FROM lab GROUP BY ALL), z AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM t) AS s, (SELECT sum(c) FROM t) AS n, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(c) AS k FROM t GROUP BY x)) AS a, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(c) AS k FROM t GROUP BY y)) AS b) SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM z",
}
