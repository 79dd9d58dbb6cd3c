"""Steiner trees against the least of all subsets' spanning trees."""

import itertools
import random

import pytest
from test_paths import graph

from proxigraph.operators import steiner


def tree_weight(ids, edges):
    """Weight of a minimum spanning tree of the induced graph, None if it is not connected."""
    up, total, joined = {i: i for i in ids}, 0.0, 1

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for w, a, b in sorted((w, a, b) for a, b, w in edges if a in up and b in up):
        if find(a) != find(b):
            up[find(a)] = find(b)
            total, joined = total + w, joined + 1
    return total if joined == len(up) else None


def test_weight_is_at_most_twice_the_least(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        ids = [f"v{i:02}" for i in range(11)]
        edges = [(a, b, float(r.randint(1, 9))) for a, b in itertools.combinations(ids, 2) if r.random() < 0.4 or int(b[1:]) == int(a[1:]) + 1]
        ends = ids[:4]
        rest = [i for i in ids if i not in ends]
        least = min(w for k in range(len(rest) + 1) for more in itertools.combinations(rest, k) if (w := tree_weight([*ends, *more], edges)) is not None)
        g = graph(spark, [*edges, (*edges[0][:2], 50.0)], ["lone"])
        got = [tuple(x) for x in steiner.steiner_tree(g, spark.createDataFrame([(e,) for e in ends], "id string")).collect()]
        inside = {x for e in got for x in e[:2]}
        assert set(got) <= set(edges) and set(ends) <= inside and len(got) == len(inside) - 1
        assert tree_weight(inside, got) == sum(w for *_, w in got) <= 2 * least
        assert all(sum(v in e[:2] for e in got) > 1 for v in inside - set(ends))
    with pytest.raises(ValueError):
        steiner.steiner_tree(g, spark.createDataFrame([("v00",), ("lone",)], "id string"))
    with pytest.raises(ValueError):
        steiner.steiner_tree(g, spark.createDataFrame([("nobody",)], "id string"))
    assert steiner.steiner_tree(g, spark.createDataFrame([("v00",)], "id string")).count() == 0


def test_terminals_in_parts_get_a_tree_each(spark, monkeypatch):
    g = graph(spark, [("u1", "b", 1.0), ("b", "u3", 1.0), ("u1", "u3", 5.0), ("u5", "x", 2.0), ("x", "u7", 2.0), ("x", "y", 1.0)], ["u9"])
    monkeypatch.setattr(steiner, "user_seq", lambda s, d: g)
    got = {tuple(r) for r in steiner.QUERIES["steiner_tree"](spark, "").collect()}
    assert got == {("b", "u1", 1.0), ("b", "u3", 1.0), ("u5", "x", 2.0), ("u7", "x", 2.0)}
