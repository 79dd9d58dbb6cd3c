"""Degree statistics of many vertices."""

from pyspark.sql import functions as F
from test_paths import graph

from proxigraph.operators import statistics


def test_moments_of_millions_of_vertices(spark):
    n = 4_000_000
    g = graph(spark, [("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("a", "d", 1)])
    x = statistics.degree_stats(type(g)(g.vertices.unionByName(spark.range(n - 4).select(F.col("id").cast("string"))), g.edges)).first()
    mean = 8 / n
    centred = lambda k: sum((d - mean) ** k for d in (3, 2, 2, 1)) + (n - 4) * mean**k
    var = centred(2) / (n - 1)
    assert (x.n, x.lo, x.hi, x.mode, x.p99) == (n, 0, 3, 0, 0)
    assert x.skewness == round(n / ((n - 1) * (n - 2)) * centred(3) / var**1.5, 4)
    assert abs(x.kurtosis - (n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * centred(4) / var**2 - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))) <= 0.001
