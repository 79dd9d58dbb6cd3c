import random

import pytest
from test_paths import graph
from test_rounds import around, sparse

from proxigraph.operators import quotients
from proxigraph.plans.graph import Graph


def groups(df):
    return {r.id: r.grp for r in df.collect()}


def greedy_alike(adj, t):
    order, out = sorted(adj, key=lambda v: (len(adj[v]), v)), {}
    for i, v in enumerate(order):
        if v in out:
            continue
        out[v] = v
        for u in order[i + 1 :]:
            both, either = len(adj[v] & adj[u]), len(adj[v] | adj[u])
            if u not in out and (either == 0 or both / either >= t):
                out[u] = v
    return out


def balls(adj, seeds, k):
    out = {}
    for s in seeds:
        if s not in adj or s in out:
            continue
        mine, edge = {s}, {s}
        for _ in range(k):
            edge = {u for v in edge for u in adj[v] if u not in mine and u not in out}
            mine |= edge
        out |= dict.fromkeys(mine, s)
    return {v: out.get(v, v) for v in adj}


@pytest.mark.parametrize("t", [0.3, 0.5, 1.0])
def test_similar_neighbourhoods_against_a_greedy_pass(spark, t):
    g, pairs = sparse(spark, 24, 40, 5)
    ids = [r.id for r in g.vertices.collect()]
    assert groups(quotients.by_similarity(g, t)) == greedy_alike(around(pairs, ids), t)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_balls_of_seeds_against_one_seed_after_the_other(spark, k):
    g, pairs = sparse(spark, 30, 36, 7)
    ids = sorted(r.id for r in g.vertices.collect())
    seeds = [*random.Random(k).sample(ids, 8), "nobody"]
    table = spark.createDataFrame(list(enumerate(seeds)), "place int, id string")
    assert groups(quotients.by_hops(g, table, k)) == balls(around(pairs, ids), seeds, k)


def test_super_edges_and_reduction(spark):
    g = graph(spark, [("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("a", "c", 4)], ["z"])
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "id string, label string")
    got = quotients.by_attribute(g, labels)
    assert groups(got) == {"a": "x", "b": "x", "c": quotients.UNASSIGNED, "d": quotients.UNASSIGNED, "z": quotients.UNASSIGNED}
    assert [tuple(r) for r in quotients.super_edges(g, got).collect()] == [(quotients.UNASSIGNED, "x", 2, 6.0)]
    assert tuple(quotients.reduction(g, got).first()) == (5, 2, 4, 1, 60.0, 75.0)


def test_empty_graph_and_wrong_parameters(spark):
    g = graph(spark, [("a", "b", 1)])
    empty = Graph(g.vertices.limit(0), g.edges.limit(0))
    seeds = spark.createDataFrame([(0, "a")], "place int, id string")
    assert quotients.by_similarity(empty, 0.5).count() == quotients.by_hops(empty, seeds, 1).count() == 0
    assert tuple(quotients.reduction(empty, quotients.by_hops(empty, seeds, 1)).first())[:2] == (0, 0)
    with pytest.raises(ValueError):
        quotients.by_similarity(g, 0)
    with pytest.raises(ValueError):
        quotients.by_hops(g, seeds, 0)
