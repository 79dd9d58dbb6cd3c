"""Louvain against modularity by its definition and a sequential pass."""

import random

import duckdb
import pytest
from test_paths import graph

from proxigraph.operators import communities as com

KARATE = """1 2,1 3,1 4,1 5,1 6,1 7,1 8,1 9,1 11,1 12,1 13,1 14,1 18,1 20,1 22,1 32,2 3,2 4,2 8,2 14,2 18,2 20,2 22,2 31,3 4,3 8,3 9,3 10,3 14,3 28,3 29,3 33,4 8,4 13,4 14,5 7,5 11,6 7,6 11,6 17,7 17,9 31,9 33,9 34,10 34,14 34,15 33,15 34,16 33,16 34,19 33,19 34,20 34,21 33,21 34,23 33,23 34,24 26,24 28,24 30,24 33,24 34,25 26,25 28,25 32,26 32,27 30,27 34,28 34,29 32,29 34,30 33,30 34,31 33,31 34,32 33,32 34,33 34"""


def karate():
    return [(f"{int(a):02}", f"{int(b):02}", 1.0) for a, b in (x.split() for x in KARATE.split(","))]


def modularity(edges, c, resolution=1.0):
    m = sum(w for _, _, w in edges)
    tot, inner = {}, 0.0
    for a, b, w in edges:
        tot[c[a]] = tot.get(c[a], 0) + w
        tot[c[b]] = tot.get(c[b], 0) + w
        inner += w * (c[a] == c[b])
    return inner / m - resolution * sum(t * t for t in tot.values()) / (4 * m * m)


def sequential(edges):
    """Moves of single vertices in order until none helps, then of whole communities."""
    groups = {v: [v] for e in edges for v in e[:2]}
    c = {v: v for v in groups}
    while True:
        start, changed = dict(c), True
        while changed:
            changed = False
            for k, vs in sorted(groups.items()):
                best = max(sorted({c[x] for a, b, _ in edges for x in (a, b) if a in vs or b in vs}), key=lambda t: round(modularity(edges, {**c, **dict.fromkeys(vs, t)}), 12))
                if modularity(edges, {**c, **dict.fromkeys(vs, best)}) > modularity(edges, c) + 1e-12:
                    c.update(dict.fromkeys(vs, best))
                    changed = True
        groups = {k: [v for v in c if c[v] == k] for k in set(c.values())}
        if c == start:
            return c


def levels_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.level, ({}, set()))[0][r.id] = r.community
        out[r.level][1].add(r.modularity)
    return [out[k] for k in sorted(out)]


def test_karate_reaches_a_sequential_pass(spark):
    edges = karate()
    assert len(edges) == 78
    g = graph(spark, edges)
    levels = levels_of(com.louvain(g, rise=0.0))
    qs = [modularity(edges, c) for c, _ in levels]
    assert qs == sorted(qs) and all(len(q) == 1 and abs(q.pop() - want) < 1e-9 for (_, q), want in zip(levels, qs, strict=True))
    assert qs[-1] >= 0.98 * modularity(edges, sequential(edges))
    last = levels[-1][0]
    assert all(c == min(v for v in last if last[v] == c) for c in last.values())
    got = com.report(g, com.last_level(com.louvain(g, rise=0.0))).orderBy("number").collect()
    assert [r.number for r in got] == list(range(len(set(last.values())))) and [r["size"] for r in got] == sorted((r["size"] for r in got), reverse=True)
    for r in got:
        inside = [e for e in edges if last[e[0]] == last[e[1]] == r.community]
        assert r.internal_edges == len(inside) and r.external_edges == sum((last[a] == r.community) != (last[b] == r.community) for a, b, _ in edges)


def test_weights_loops_isolated_and_resolution(spark):
    r = random.Random(4)
    edges = [(f"v{a:02}", f"v{b:02}", float(r.randint(1, 9) * (20 if a // 6 == b // 6 else 1))) for a in range(24) for b in range(a + 1, 24) if a // 6 == b // 6 or r.random() < 0.5]
    g = graph(spark, [*edges, ("v03", "v03", 2.0)], ["lone"])
    last = com.last_level(com.louvain(g)).collect()
    c = {x.id: x.community for x in last}
    assert c["lone"] == "lone" and len(set(c.values())) == 5 and all(c[f"v{i:02}"] == f"v{i // 6 * 6:02}" for i in range(24))
    fine = {x.id: x.community for x in com.last_level(com.louvain(g, 40.0)).collect()}
    assert len(set(fine.values())) > 5
    with pytest.raises(ValueError):
        com.louvain(g, 0.0)
    none = levels_of(com.louvain(graph(spark, [], ["a", "b"])))
    assert none == [({"a": "a", "b": "b"}, {0.0})]


def test_moves_match_their_sql(spark):
    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("orders", "lineitem", "part"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = sorted(map(tuple, com.QUERIES["louvain_moves"](spark, d).select("id", "community").collect()))
    assert got == sorted(con.sql(com.SQL["louvain_moves"]).fetchall()) and len({c for _, c in got}) < len(got)
