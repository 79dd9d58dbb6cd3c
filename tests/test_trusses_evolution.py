import random

import pytest
from test_paths import graph

from proxigraph.operators import evolution, trusses
from proxigraph.plans.graph import Graph


def peel(pairs):
    """Truss numbers by taking away edges one k after the other."""
    left, out, k = set(pairs), dict.fromkeys(pairs, 2), 3
    while left:
        near = {}
        for a, b in left:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        weak = {(a, b) for a, b in left if len(near[a] & near[b]) < k - 2}
        if weak:
            left -= weak
        else:
            out |= dict.fromkeys(left, k)
            k += 1
    return out


@pytest.mark.parametrize(("n", "m", "seed"), [(14, 50, 1), (20, 110, 2)])
def test_truss_numbers_against_peeling(spark, n, m, seed):
    r = random.Random(seed)
    pairs = sorted({tuple(sorted(r.sample([f"v{i:02}" for i in range(n)], 2))) for _ in range(m)})
    g = graph(spark, [(a, b, 1) for a, b in pairs], ["lone"])
    got = trusses.truss_numbers(g).collect()
    want = peel(pairs)
    assert {(x.src, x.dst): x.truss for x in got} == want and len(got) == len(pairs)
    assert {(x.k, x.edges) for x in trusses.truss_profile(g, trusses.truss_numbers(g)).collect()} == {(k, sum(t >= k for t in want.values())) for k in range(2, max(want.values()) + 1)}


def test_trusses_without_triangles_or_edges(spark):
    g = graph(spark, [("a", "b", 1), ("b", "c", 1)])
    assert [(x.support, x.truss) for x in trusses.truss_numbers(g).collect()] == [(0, 2)] * 2
    assert trusses.truss_numbers(Graph(g.vertices.limit(0), g.edges.limit(0))).count() == 0


def sequential(snaps, match, change, least):
    """Events between snapshots {label: members}, one community after the other."""
    out = []
    for w in range(1, len(snaps)):
        p = {k: v for k, v in snaps[w - 1].items() if len(v) >= least}
        c = {k: v for k, v in snaps[w].items() if len(v) >= least}
        hit = {(x, y) for x in p for y in c if len(p[x] & c[y]) / len(p[x] | c[y]) >= match}
        done_p, done_c = set(), set()
        for x in p:
            to = sorted(y for y in c if (x, y) in hit)
            if len(to) > 1:
                done_p.add(x)
                done_c.update(to)
                out.append((w, "SPLIT", x, ",".join(to), len(p[x]), sum(len(c[y]) for y in to)))
        for y in c:
            of = sorted(x for x in p if (x, y) in hit and x not in done_p)
            if y not in done_c and len(of) > 1:
                done_c.add(y)
                done_p.update(of)
                out.append((w, "MERGE", ",".join(of), y, sum(len(p[x]) for x in of), len(c[y])))
        for x in p:
            to = [y for y in c if (x, y) in hit and y not in done_c]
            if x not in done_p and to:
                y, rate = to[0], (len(c[to[0]]) - len(p[x])) / len(p[x])
                done_p.add(x)
                done_c.add(y)
                out.append((w, "GROWTH" if rate >= change else "CONTRACTION" if rate <= -change else "STABLE", x, y, len(p[x]), len(c[y])))
        out += [(w, "DEATH", x, "", len(p[x]), 0) for x in p if x not in done_p]
        out += [(w, "BIRTH", "", y, 0, len(c[y])) for y in c if y not in done_c]
    return out


def test_events_against_a_sequential_pass(spark):
    r = random.Random(11)
    at, rows, snaps = {f"v{i:02}": i // 5 for i in range(60)}, [], []
    for w in range(5):
        groups = {}
        for v, c in at.items():
            groups.setdefault(c, set()).add(v)
        snaps.append({min(m): m for m in groups.values()})
        rows += [(w, v, label) for label, m in snaps[-1].items() for v in m]
        joined, parted = r.sample(sorted(groups, key=str), 2)
        for v in groups[joined]:
            at[v] = parted
        big = max(groups.values(), key=len)
        for v in sorted(big)[::2]:
            at[v] = 100 + w
        if w == 2:  # one falls apart
            at |= {v: f"single {v}" for v in min(groups.values(), key=lambda m: (len(m) < 3, len(m)))}
        for v in r.sample(sorted(at), 6):
            at[v] = r.choice([*sorted(groups, key=str), 200 + w])
    want = sorted(sequential(snaps, 0.3, 0.2, 2))
    table = spark.createDataFrame([*rows, (0, None, "x"), rows[0]], "w int, id string, label string")
    assert sorted(tuple(x) for x in evolution.events(table).collect()) == want
    assert {"SPLIT", "MERGE", "DEATH", "BIRTH", "STABLE"} <= {x[1] for x in want}
    assert sum(x.n for x in evolution.event_summary(evolution.events(table)).collect()) == len(want)


def test_events_of_one_window_and_none(spark):
    empty = spark.createDataFrame([], "w int, id string, label string")
    one = spark.createDataFrame([(3, "a", "a"), (3, "b", "a")], "w int, id string, label string")
    assert evolution.events(empty).count() == evolution.events(one).count() == 0
    with pytest.raises(ValueError):
        evolution.events(one, match=0)
