"""Pairs without an edge."""

import itertools
import random

from pyspark.sql import functions as F
from test_paths import graph

from proxigraph.operators import subgraph


def test_complement_in_blocks_and_of_many_vertices(spark):
    r, ids = random.Random(2), [f"v{i:02}" for i in range(40)]
    pairs = set(itertools.combinations(ids, 2))
    edges = set(r.sample(sorted(pairs), 200))
    g = graph(spark, [(*e, 1) for e in edges], ids)
    for block in (7, 1024):
        got = [tuple(x) for x in subgraph.complement(g, block).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs - edges
    many = type(g)(spark.range(5100).select(F.col("id").cast("string")), g.edges.limit(0))
    assert subgraph.complement(many).count() == 5100 * 5099 // 2
