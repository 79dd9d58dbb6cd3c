"""Sizes of layers around all vertices, against breadth-first search from each."""

import random

import pytest
from pyspark.sql import functions as F
from test_paths import graph

from proxigraph.operators import iterative as it


def plain(ids, edges):
    near = {v: set() for v in ids}
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for v in ids:
        seen, todo = {v: 0}, [v]
        for x in todo:
            for y in near[x] - set(seen):
                seen[y] = seen[x] + 1
                todo.append(y)
        out[v] = seen
    return out


@pytest.mark.parametrize("rows", [30_000_000, 200])
def test_layers_of_every_vertex(spark, monkeypatch, rows):
    monkeypatch.setattr(it, "LAYER_ROWS", rows)
    r, ids = random.Random(6), [f"v{i:03}" for i in range(150)]
    edges = sorted({(a, b, 1) for a, b in (sorted(r.sample(ids[:90], 2)) for _ in range(95))}) + [(ids[i], ids[i + 1], 1) for i in range(90, 104)]
    want = plain(ids, edges)
    got = it.layer_sizes(graph(spark, edges, ids)).collect()
    assert len({(x.id, x.hops) for x in got}) == len(got)
    assert {(x.id, x.hops, x.n) for x in got} == {(v, h, sum(1 for k in d.values() if k == h)) for v, d in want.items() for h in set(d.values())}


@pytest.fixture(scope="module")
def many(spark):
    """More vertices than the squares of which were listed once: a path of 4 steps, and lone ones."""
    g = graph(spark, [(f"a{i:02}", f"a{i + 1:02}", 1) for i in range(4)])
    g = type(g)(g.vertices.unionByName(spark.range(7200).select(F.col("id").cast("string"))), g.edges)
    return g.vertices.count(), it.layer_sizes(g).cache()


def test_closeness_of_many(many):
    n, sizes = many
    got = {x.id: x.closeness for x in it.closeness(sizes, n).collect()}
    assert len(got) == n and got["7"] == 0 and got["a00"] == round(16 / (7204 * 10), 6) and got["a02"] == round(16 / (7204 * 6), 6)


def test_histogram_of_many(many):
    assert sorted(map(tuple, it.histogram(many[1]).collect())) == [(1, 4), (2, 3), (3, 2), (4, 1)]


def test_eccentricity_of_many(many):
    got = {x.id: x.ecc for x in it.eccentricity(many[1]).collect()}
    assert len(got) == many[0] and [got[f"a{i:02}"] for i in range(5)] == [4, 3, 2, 3, 4] and got["7"] == 0


def test_summary_of_many(many):
    x = it.distance_summary(many[1], many[0]).first()
    assert (x.pairs, x.wiener, x.hyper_wiener, x.diameter, x.avg_path, x.harary) == (10, 20, 35, 4, 2.0, round(4 + 3 / 2 + 2 / 3 + 1 / 4, 6))
