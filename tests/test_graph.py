import itertools
import random

import pytest
from pyspark.sql import functions as F

from proxigraph.operators import iterative as it
from proxigraph.operators import local, pipeline, query, subgraph
from proxigraph.plans.components import components
from proxigraph.plans.graph import Graph
from proxigraph.sources import edge_list

EDGE = "src string, dst string, type string, weight double, label string, ts long, end_ts long"


def graph(spark, edges, vertices=()):
    rows = [(*e, *[None] * (7 - len(e))) for e in edges]
    ids = sorted({x for e in edges for x in e[:2]} | set(vertices))
    return Graph(spark.createDataFrame([(v,) for v in ids], "id string"), spark.createDataFrame(rows, EDGE))


@pytest.fixture(scope="module")
def five(spark):
    return graph(spark, [("A", "B", "f", 1.0), ("B", "C", "c", 2.5), ("C", "D", "f", 0.5), ("B", "D", "s", 3.0)], ["E"])


def ids(df):
    return {r.id for r in df.collect()}


def test_node_queries(five):
    q = query.GraphQueryEngine(five)
    assert ids(q.nodes().with_min_degree(2).results()) == {"B", "C", "D"}
    assert ids(q.nodes().isolated().results()) == {"E"}
    assert ids(q.nodes().leaves().results()) == {"A"}
    assert ids(q.nodes().connected_by_type("s").with_max_degree(2).results()) == {"D"}
    assert ids(q.nodes().matching("[A-C]").results()) == {"A", "B", "C"}
    assert [r.id for r in q.nodes().sorted_by_degree().collect()][0] == "B"
    with pytest.raises(ValueError):
        q.nodes().matching("a" * 501)


def test_edge_queries_and_stats(five):
    q = query.GraphQueryEngine(five)
    assert q.edges().of_type("f").with_min_weight(1).count() == 1
    assert q.edges().between_nodes({"B", "C", "D"}).count() == 3
    s = q.stats().first()
    assert (s.n_nodes, s.n_edges, s.min_degree, s.max_degree) == (5, 4, 0, 3)


@pytest.mark.parametrize("t,on", [(100, True), (150, True), (200, True), (99, False), (201, False)])
def test_interval_edges(spark, t, on):
    g = graph(spark, [("A", "B", "f", 1.0, None, 100, 200)])
    assert subgraph.snapshot(g, t).edges.count() == on
    assert graph(spark, [("A", "B", "f", 1.0)]).edges.filter(query.active_at(t)).count() == 1


@pytest.mark.parametrize("times,window,want", [([], 5, 0), (["10:30:15"], 5, 1), (["10:00", "10:02", "10:04"], 5, 1), (["10:00", "10:02", "10:12", "10:14"], 5, 2), (["10:00", "10:05"], 5, 1), (["08:00", "08:10", "08:12", "08:32"], 5, 3), (["10:00", "10:08"], 5, 2), (["10:00", "10:08"], 10, 1)])
def test_sessionize(spark, times, window, want):
    df = spark.createDataFrame([("p", f"2011-03-01 {t}") for t in times], "pair string, t string").withColumn("ts", F.to_timestamp("t"))
    assert pipeline.sessionize(df, ["pair"], minutes=window).count() == want


def test_time_difference_ignores_milliseconds(spark):
    df = spark.createDataFrame([("10.30:15.900", "9.30:45.000")], "a string, b string")
    assert abs(df.select(pipeline.minutes_between(F.col("a"), F.col("b"))).first()[0] - 59.5) < 1e-5


def test_components_of_paths_hubs_and_rings(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    perm = list(range(5000))
    r.shuffle(perm)
    e = [(perm[a], perm[b]) for a, b in edges]
    got = {x.id: x.component for x in components(spark.createDataFrame(e, "src long, dst long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in e:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in list(up)}


def test_core_truss_triangles_on_random_graph(spark):
    r = random.Random(3)
    pairs = sorted(r.sample(list(itertools.combinations([f"v{i:02}" for i in range(25)], 2)), 80))
    g = graph(spark, [(a, b, "f", 1.0) for a, b in pairs])
    adj = {v: {} for p in pairs for v in p}
    for a, b in pairs:
        adj[a][b] = adj[b][a] = 1.0
    core, left, k = {}, {v: set(n) for v, n in adj.items()}, 0
    while left:
        low = [v for v in left if len(left[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
            for u in left.pop(v):
                if u in left:
                    left[u].discard(v)
    assert {x.id: x.core for x in it.coreness(g).collect()} == core
    tri = {t for t in itertools.combinations(sorted(adj), 3) if all(b in adj[a] for a, b in itertools.combinations(t, 2))}
    assert {tuple(t) for t in g.triangles().collect()} == tri
    e = set(pairs)
    while bad := {p for p in e if sum(1 for v in adj if tuple(sorted((p[0], v))) in e and tuple(sorted((p[1], v))) in e) < 1}:
        e -= bad
    assert {tuple(x) for x in it.truss(g, 3).select("src", "dst").collect()} == e
    assert local.squares(g).first().squares >= 0


def test_spanning_forest_weight(spark):
    g = graph(spark, [("a", "b", "f", 4.0), ("b", "c", "f", 1.0), ("a", "c", "f", 2.0), ("d", "e", "f", 7.0)])
    assert it.spanning_forest(g).agg(F.sum("weight")).first()[0] == 10.0


def test_edge_list_round_trip(spark, tmp_path, five):
    edge_list.write(five.edges, str(tmp_path / "g"))
    g, bad = edge_list.read(spark, str(tmp_path / "g"))
    assert bad.count() == 0 and {(r.src, r.dst, r.weight) for r in g.edges.collect()} == {(r.src, r.dst, r.weight) for r in five.edges.collect()}
    (tmp_path / "bad.txt").write_text("nodes\nz\nedges\nf a b 1.5\nf a\nf a c x\nf a d NaN\n")
    g, bad = edge_list.read(spark, str(tmp_path / "bad.txt"))
    assert g.edges.count() == 1 and ids(g.vertices) == {"a", "b", "z"} and {r.reason for r in bad.collect()} == {"fields", "weight"}
