"""Maximal cliques against a plain search, and the order that bounds their rows."""

import itertools
import random

from test_communities import karate
from test_paths import graph

from proxigraph.operators import cliques


def plain(ids, pairs):
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in ids}
    out = []

    def grow(r, p, x):
        if not p and not x:
            out.append(tuple(sorted(r)))
        for v in sorted(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(ids), set())
    return sorted(out)


def found(g):
    return sorted(tuple(r.clique) for r in cliques.maximal_cliques(g).collect())


def test_cliques_equal_a_plain_search(spark):
    r = random.Random(1)
    ids = [f"v{i:02}" for i in range(24)]
    pairs = [p for p in itertools.combinations(ids, 2) if r.random() < 0.55]
    g = graph(spark, [(*p, 1.0) for p in pairs] + [(ids[0], ids[0], 1.0), (*pairs[0], 2.0)], ["lone"])
    assert found(g) == plain([*ids, "lone"], pairs)
    k = [(a, b) for a, b, _ in karate()]
    got = found(graph(spark, karate()))
    assert got == plain({x for e in k for x in e}, k) and max(map(len, got)) == 5 and sum(len(c) == 5 for c in got) == 2
    assert found(graph(spark, [], ["a"])) == [("a",)] and found(graph(spark, [])) == []


def test_order_leaves_few_later_neighbours(spark):
    """A star of many leaves and a clique of six: hubs and chains come in a few rounds."""
    pairs = [("hub", f"x{i:03}") for i in range(200)] + list(itertools.combinations([f"k{i}" for i in range(6)], 2)) + [(f"p{i:03}", f"p{i + 1:03}") for i in range(150)]
    g = graph(spark, [(*p, 1.0) for p in pairs])
    at = {r.id: (r["round"], r.id) for r in cliques.peeling(g).collect()}
    assert len({k for k, _ in at.values()}) <= 8
    later = {v: 0 for v in at}
    for a, b in pairs:
        later[min(a, b, key=at.get)] += 1
    assert max(later.values()) <= 2 * cliques.SLACK * 5
    assert sum(len(c) == 6 for c in found(g)) == 1
