"""Flows against all cuts, matchings against a plain augmenting search."""

import itertools
import random

import pytest
from test_paths import graph

from proxigraph.operators import flow
from proxigraph.plans.graph import Graph


def least_cut(ids, edges, s, t, directed):
    best, sides = None, None
    rest = [v for v in ids if v not in (s, t)]
    for k in range(len(rest) + 1):
        for more in itertools.combinations(rest, k):
            side = {s, *more}
            c = sum(w for a, b, w in edges if (a in side and b not in side) or (not directed and b in side and a not in side))
            if best is None or c < best:
                best, sides = c, [side]
            elif c == best:
                sides.append(side)
    return best, set.intersection(*sides)  # the least of the minimum cuts on the source's side


@pytest.mark.parametrize("directed", [False, True])
def test_flow_equals_the_least_of_all_cuts(spark, directed):
    r = random.Random(5 + directed)
    ids = [f"v{i}" for i in range(9)]
    edges = [(a, b, float(r.randint(0, 6))) for a, b in itertools.permutations(ids, 2) if (a < b or directed) and r.random() < 0.35]
    e = spark.createDataFrame([(*x, "f") for x in [*edges, edges[0]]] + [("v0", "v0", 9.0, "f")], "src string, dst string, weight double, type string")
    g = Graph(spark.createDataFrame([(i,) for i in [*ids, "lone"]], "id string"), e, directed)
    edges = [*edges, edges[0]]
    want, side = least_cut(ids, edges, "v0", "v8", directed)
    value, cut = flow.flow(g, "v0", "v8")
    assert value == want and cut.agg({"weight": "sum"}).first()[0] == want
    crossing = sorted(x for x in edges if (x[0] in side) != (x[1] in side) and (not directed or x[0] in side))
    assert sorted(map(tuple, cut.collect())) == crossing
    assert flow.flow(g, "v0", "lone")[0] == 0.0
    with pytest.raises(ValueError):
        flow.flow(g, "v0", "v0")


def test_a_long_chain_and_a_bottleneck(spark):
    edges = [(f"a{i}", f"a{i + 1}", 3.0) for i in range(6)] + [("a0", "b", 5.0), ("b", "a6", 1.0), ("b", "a3", 1.0)]
    row = flow.max_flow(graph(spark, edges), "a0", "a6").first()
    assert (row.flow, row.cut, row.cut_edges) == (4.0, 4.0, 2)


def plain_matching(links):
    mate = {}

    def grow(v, seen):
        for u in links.get(v, ()):
            if u not in seen:
                seen.add(u)
                if u not in mate or grow(mate[u], seen):
                    mate[u] = v
                    return True
        return False

    return sum(grow(v, set()) for v in links)


def test_matching_is_maximum_and_as_large_as_its_cover(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        links = {f"l{i:02}": {f"r{j:02}" for j in range(14) if r.random() < 0.13} for i in range(14)}
        edges = [(a, b, 1.0) for a, bs in links.items() for b in bs]
        g = graph(spark, edges, ["lone"])
        pairs, cover = flow.matching(g)
        pairs, cover = pairs.collect(), {x.id for x in cover.collect()}
        assert len(pairs) == plain_matching(links) == len(cover)
        assert len({x for p in pairs for x in p}) == 2 * len(pairs) and {tuple(sorted(p)) for p in pairs} <= {(a, b) for a, b, _ in edges}
        assert all(a in cover or b in cover for a, b, _ in edges)
    with pytest.raises(ValueError):
        flow.matching(graph(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1)]))
    none = flow.matching(graph(spark, [], ["a"]))
    assert none[0].count() == 0 and none[1].count() == 0


def test_long_alternating_path(spark):
    """A path whose greedy matching leaves both ends free."""
    path = [("b0", "a1"), ("b1", "a1"), ("b1", "a2"), ("b2", "a2"), ("b2", "a3"), ("b3", "a3"), ("b3", "a4")]
    pairs, cover = flow.matching(graph(spark, [(a, b, 1.0) for a, b in path]))
    assert pairs.count() == 4 == cover.count()
