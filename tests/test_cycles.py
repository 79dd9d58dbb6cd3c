"""Cycles and hitting times against plain versions."""

import itertools
import random

import numpy as np
from test_paths import graph

from proxigraph.operators import cycles


def test_basis_has_a_cycle_for_each_edge_off_the_forest(spark):
    r = random.Random(2)
    ids = [f"v{i:02}" for i in range(20)]
    pairs = sorted({tuple(sorted(r.sample(ids, 2))) for _ in range(32)})
    g = graph(spark, [(*p, 1.0) for p in pairs] + [(*pairs[0], 2.0), ("v01", "v01", 1.0)], ["lone"])
    rows = cycles.cycle_basis(g).collect()
    parts = len({x.component for x in cycles.connected(g).collect()})
    linked = {x for p in pairs for x in p} | {"v01", "lone"}
    assert len(rows) == len(pairs) - len(linked) + parts
    have, own = set(map(frozenset, pairs)), []
    for x in rows:
        ring = [frozenset(e) for e in zip(x.cycle, [*x.cycle[1:], x.cycle[0]], strict=True)]
        assert len(set(x.cycle)) == len(x.cycle) == x.length >= 3 and set(ring) <= have and frozenset((x.src, x.dst)) in ring
        own.append(frozenset((x.src, x.dst)))
    assert all(sum(o in {frozenset(e) for e in zip(x.cycle, [*x.cycle[1:], x.cycle[0]], strict=True)} for o in own) == 1 for x in rows)


def test_girth(spark):
    ring = lambda n, tag: [(f"{tag}{i}", f"{tag}{(i + 1) % n}", 1.0) for i in range(n)]
    assert cycles.girth(graph(spark, ring(6, "a") + ring(9, "b"))) == 6
    assert cycles.girth(graph(spark, ring(7, "a") + [("a0", "x", 1.0), ("x", "a1", 1.0)]), batch=2) == 3
    assert cycles.girth(graph(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "b", 2.0), ("a", "a", 1.0)])) is None
    petersen = [(f"o{i}", f"o{(i + 1) % 5}", 1.0) for i in range(5)] + [(f"o{i}", f"i{i}", 1.0) for i in range(5)] + [(f"i{i}", f"i{(i + 2) % 5}", 1.0) for i in range(5)]
    assert cycles.girth(graph(spark, petersen)) == 5


def test_hitting_times_equal_a_linear_solver(spark):
    r = random.Random(3)
    ids = [f"v{i:02}" for i in range(15)]
    edges = [(a, b, float(r.randint(1, 4))) for a, b in itertools.combinations(ids, 2) if r.random() < 0.3] + [("far", "away", 1.0)]
    g = graph(spark, edges)
    for weighted in (False, True):
        w = np.zeros((15, 15))
        for a, b, x in edges[:-1]:
            w[ids.index(a), ids.index(b)] = w[ids.index(b), ids.index(a)] = x if weighted else 1.0
        lap = np.diag(w.sum(axis=1)) - w
        want = np.r_[0.0, np.linalg.solve(lap[1:, 1:], w.sum(axis=1)[1:])]
        got = {x.id: x.time for x in cycles.hitting_times(g, "v00", weighted).collect()}
        assert np.abs(np.array([got[i] for i in ids]) - want).max() < 1e-6 and got["far"] == float("inf")
    assert cycles.hitting_times(g, "nobody").count() == 0
    assert {x.id: x.time for x in cycles.hitting_times(graph(spark, [], ["a", "b"]), "a").collect()} == {"a": 0.0, "b": float("inf")}
