import random

from pyspark.sql import functions as F
from test_paths import graph

from proxigraph.operators import directed, rounds
from proxigraph.plans.graph import Graph


def sparse(spark, n=26, m=34, seed=3):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample([f"v{i:02}" for i in range(n)], 2))) for _ in range(m)}
    return graph(spark, [(a, b, r.randint(1, 5)) for a, b in sorted(pairs)], ["lone"]), sorted(pairs)


def around(pairs, ids):
    adj = {i: set() for i in ids}
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    return adj


def reach(adj, a, without=None):
    seen, todo = {a}, [a]
    while todo:
        for u in adj[todo.pop()] - {without} - seen:
            seen.add(u)
            todo.append(u)
    return seen


def test_greedy_sets_match_sequential_passes(spark):
    g, pairs = sparse(spark)
    ids = {r.id for r in g.vertices.collect()}
    adj = around(pairs, ids)
    want = set()
    for v in sorted(ids, key=lambda v: (len(adj[v]), v)):
        if not adj[v] & want:
            want.add(v)
    assert {r.id for r in rounds.independent_set(g).collect()} == want
    colour = {}
    for v in sorted(ids, key=lambda v: (-len(adj[v]), v)):
        used = {colour[u] for u in adj[v] if u in colour}
        colour[v] = next(c for c in range(99) if c not in used)
    assert {r.id: r.colour for r in rounds.colouring(g).collect()} == colour
    taken, ends = set(), set()
    for w, a, b in sorted((-r.weight, r.src, r.dst) for r in g.edges.collect()):
        if not {a, b} & ends:
            taken.add((a, b))
            ends |= {a, b}
    assert {tuple(r) for r in rounds.maximal_matching(g).collect()} == taken
    assert {r.id for r in rounds.vertex_cover(g).collect()} == ends and all(a in ends or b in ends for a, b in pairs)


def test_articulation_points_against_removal(spark):
    for seed in (3, 4):
        g, pairs = sparse(spark, 22, 24, seed)
        ids = {r.id for r in g.vertices.collect()}
        adj = around(pairs, ids)
        want = {v for v in ids if adj[v] and len({frozenset(reach(adj, u, v)) for u in adj[v]}) > 1}
        got = rounds.bridges_articulation(g).collect()
        assert {r.a for r in got if r.kind == "articulation"} == want
        cut = {(a, b) for a, b in pairs if b not in reach(around(set(pairs) - {(a, b)}, ids), a)}
        assert {(r.a, r.b) for r in got if r.kind == "bridge"} == cut


def test_empty_graph(spark):
    g = graph(spark, [("a", "b", 1)])
    empty = Graph(g.vertices.limit(0), g.edges.limit(0))
    assert rounds.independent_set(empty).count() == rounds.colouring(empty).count() == rounds.maximal_matching(empty).count() == rounds.bridges_articulation(empty).count() == 0
    assert directed.strong_components(empty).count() == 0


def test_strong_components_and_levels(spark):
    arcs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("e", "g")]
    g = Graph(spark.createDataFrame([(x,) for x in "abcdefgh"], "id string"), spark.createDataFrame(arcs, "src string, dst string"), directed=True)
    assert {r.id: r.scc for r in directed.strong_components(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g", "h": "h"}
    assert {r.scc: (r["size"], r.kind) for r in directed.condensation(g).collect()} == {"a": (3, "intermediate"), "d": (2, "intermediate"), "f": (1, "source"), "g": (1, "sink"), "h": (1, "isolated")}
    assert directed.edges_to_connect(directed.condensation(g)).first().edges_needed == 2
    assert {r.id: r.level for r in directed.topological_levels(g).collect()} == {"f": 0, "h": 0, **dict.fromkeys("abcdeg")}
    assert directed.reciprocity(g).first()[:2] == (8, 2)
    loop = Graph(g.vertices, g.edges.filter(F.col("src") == "x"), directed=True)
    assert directed.reciprocity(loop).first().rate == 0.0


def test_critical_path_is_a_longest_path(spark):
    arcs = [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "e"), ("y", "z")]
    ids = spark.createDataFrame([(v,) for v in "abcdexyz"], "id string")
    g = Graph(ids, spark.createDataFrame(arcs, "src string, dst string"), directed=True)
    assert [r.id for r in directed.critical_path(g).orderBy("step").collect()] == ["a", "b", "d", "e"]
    ring = Graph(ids, spark.createDataFrame([*arcs, ("e", "a")], "src string, dst string"), directed=True)
    assert directed.critical_path(ring).count() == 0 == directed.critical_path(Graph(ids.limit(0), g.edges.limit(0), directed=True)).count()
