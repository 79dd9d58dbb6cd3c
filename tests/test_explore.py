"""Paths and patterns against plain searches."""

import itertools
import random

import pytest
from test_paths import graph

from proxigraph.operators import explore


def some(seed, n=9, p=0.4):
    r = random.Random(seed)
    ids = [f"v{i}" for i in range(n)]
    return ids, [(a, b, float(r.randint(1, 5))) for a, b in itertools.combinations(ids, 2) if r.random() < p]


def all_paths(edges, s, t, depth):
    w = {frozenset(e[:2]): e[2] for e in edges}
    out, todo = [], [(s,)]
    while todo:
        p = todo.pop()
        if p[-1] == t:
            out.append((sum(w[frozenset(x)] for x in itertools.pairwise(p)), len(p) - 1, p))
            continue
        if len(p) <= depth:
            todo += [(*p, u) for e in w if p[-1] in e for u in e - {p[-1]} if u not in p]
    return sorted(out)


def test_simple_paths_and_the_shortest_of_them(spark):
    _, edges = some(3, p=0.5)
    g = graph(spark, edges, ["lone"])
    for depth in (3, 8):
        want = all_paths(edges, "v0", "v8", depth)
        got = explore.simple_paths(g, "v0", "v8", depth).collect()
        assert sorted((r.weight, r.hops, tuple(r.path)) for r in got) == want and not any(r.cut for r in got)
    few = explore.simple_paths(g, "v0", "v8", 8, most=4).collect()
    assert [(r.weight, r.hops, tuple(r.path)) for r in few] == want[:4] and all(r.cut == (len(want) > 4) for r in few)
    for k in (1, 7, 10_000):
        got = [(r.weight, r.hops, tuple(r.path)) for r in explore.k_shortest(g, "v0", "v8", k).orderBy("place").collect()]
        assert got == want[:k]
    assert explore.k_shortest(g, "v0", "lone", 3).count() == 0 == explore.simple_paths(g, "v0", "v0", 3).count()
    with pytest.raises(ValueError):
        explore.k_shortest(g, "v0", "v8", 0)


def plain(edges, pattern, types=None):
    names, links = sorted({x for e in pattern.edges for x in e[:2]}), pattern.links()
    has = {frozenset(e[:2]): e[2] for e in edges}
    found = {}
    for m in itertools.permutations(sorted({x for e in edges for x in e[:2]}), len(names)):
        at = dict(zip(names, m, strict=True))
        image = frozenset((frozenset(at[x] for x in k), t) for k, t in links.items())
        if all(k in has and t in (None, has[k]) for k, t in image):
            found.setdefault(tuple(sorted(m)), set()).add(image if any(t for _, t in image) else frozenset(k for k, _ in image))
    return {k: len(v) for k, v in found.items()}


def test_patterns_equal_all_mappings(spark):
    _, edges = some(4, 8, 0.55)
    g = graph(spark, edges)
    for p in (explore.TRIANGLE, explore.SQUARE, explore.DIAMOND, explore.CLIQUE, explore.Pattern((("x", "y"), ("y", "z")))):
        assert {tuple(r.nodes): r.occurrences for r in explore.matches(g, p).collect()} == plain(edges, p)
    kinds = [(a, b, "fc"[int(w) % 2]) for a, b, w in edges]
    typed = explore.Graph(g.vertices, spark.createDataFrame([(*e, 1.0) for e in kinds], "src string, dst string, type string, weight double"))
    p = explore.Pattern((("a", "b", "f"), ("b", "c", "c"), ("c", "d", "f")))
    assert {tuple(r.nodes): r.occurrences for r in explore.matches(typed, p).collect()} == plain(kinds, p)
    with pytest.raises(ValueError):
        explore.Pattern((("a", "b"), ("c", "d"))).order()
