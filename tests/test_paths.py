import itertools

import pytest
from pyspark.sql import functions as F

from proxigraph.operators import iterative, paths
from proxigraph.plans.graph import Graph
from proxigraph.plans.numbering import numbered


def graph(spark, edges, more=()):
    ids = sorted({x for e in edges for x in e[:2]} | set(more))
    rows = [(min(a, b), max(a, b), "f", float(w), None, None, None) for a, b, w in edges]
    return Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(rows, "src string, dst string, type string, weight double, label string, ts long, end_ts long"))


EDGES = [("a", "b", 1), ("b", "c", 1), ("a", "c", 5), ("c", "d", 1), ("d", "e", 2), ("e", "f", 1), ("d", "f", 1), ("x", "y", 1)]


def test_paths_by_hops_and_weight(spark):
    g = graph(spark, EDGES, ["lone"])
    steps = lambda df: [r.id for r in df.orderBy("step").collect()]
    assert steps(paths.path_by_hops(g, "a", "f")) == ["a", "c", "d", "f"]
    assert steps(paths.path_by_hops(g, "a", "a")) == ["a"]
    assert steps(paths.path_by_hops(g, "a", "x")) == [] == steps(paths.path_by_hops(g, "nobody", "a"))
    assert steps(paths.path_by_hops(g, "a", "d", ("c",))) == []
    assert steps(paths.path_through(g, ["a", "e", "f"])) == ["a", "c", "d", "e", "f"]
    got = paths.path_by_weight(g, "a", "f").orderBy("step").collect()
    assert [(r.id, r.total) for r in got] == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("f", 4)]
    with pytest.raises(ValueError):
        paths.weighted_distances(graph(spark, [("a", "b", -1)]), "a")


def test_bridges_against_removal(spark):
    g = graph(spark, EDGES, ["lone"])
    pairs = {(min(a, b), max(a, b)) for a, b, _ in EDGES}

    def joined(edges, a, b):
        seen, todo = {a}, [a]
        while todo:
            v = todo.pop()
            for e in edges:
                for x, y in (e, e[::-1]):
                    if x == v and y not in seen:
                        seen.add(y)
                        todo.append(y)
        return b in seen

    want = {e for e in pairs if not joined(pairs - {e}, *e)}
    assert {tuple(r) for r in paths.bridges(g).collect()} == want == {("c", "d"), ("x", "y")}


def test_betweenness_in_batches(spark):
    g = graph(spark, EDGES, ["lone"])
    whole = {r.id: r.betweenness for r in paths.brandes(g)[0].collect()}
    assert whole["c"] == 6 and whole["d"] == 6 and whole["lone"] == 0  # a,b x d,e,f; a,b,c x e,f
    parts = [paths.brandes(g, g.vertices.filter(f"id {op} 'c'"))[0].collect() for op in ("<=", ">")]
    assert {i: sum(r.betweenness for p in parts for r in p if r.id == i) for i in whole} == pytest.approx(whole)


def test_long_chains_are_settled_and_numbered(spark):
    n = 40
    g = graph(spark, [(f"v{i:02}", f"v{i + 1:02}", 1) for i in range(n)])
    got = {r.id: r.hops for r in iterative.bfs(g, "v00").collect()}
    assert got == {f"v{i:02}": i for i in range(n + 1)}
    with pytest.raises(RuntimeError):
        iterative.levels(g, g.vertices.selectExpr("id", "id as source"), rounds=3)
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int").repartition(5)
    assert sorted((r.x, r.n) for r in numbered(df, [F.col("x").desc()], "n").collect()) == [(100 - i, i + 1) for i in reversed(range(101))]
    assert numbered(df.limit(0), [F.col("x")], "n").count() == 0


def test_label_propagation_finds_cliques(spark):
    edges = [(a + x, a + y, 1) for a in "pq" for x, y in itertools.combinations("1234", 2)] + [("p1", "q1", 1)]
    got = {r.id: r.label for r in paths.label_propagation(graph(spark, edges, ["z"]), 6).collect()}
    assert len({got[f"p{i}"] for i in "234"}) == 1 and len({got[f"q{i}"] for i in "234"}) == 1 and got["p2"] != got["q2"] and got["z"] == "z"
