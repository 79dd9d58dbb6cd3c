"""Hard negatives against brute force, and rows of every kind."""

import math

import duckdb
import numpy as np
import pytest

from proxigraph.llm import hard_negatives as hn

D = "/root/testdata/sf0.001"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_hand(rows, every=50):
    """``rows``: (vec_id, label, vector), labels as they are."""
    x = {(i, y, tuple(math.floor(256 * float(c)) for c in v)) for i, y, v in rows if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for a in x:
        if a[0] % every:
            continue
        s = sorted(((-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b[1] == a[1]) for b in x if b[0] != a[0]), key=lambda r: r[:2])
        for ps, p, _ in [r for r in s if r[2]][:5]:
            fine = [(ns, n) for ns, n, same in s if not same and 50 * -ps <= 100 * -ns <= 95 * -ps][:3]
            out += [(a[0], p, k + 1, n, -ps, -ns) for k, (ns, n) in enumerate(fine)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def test_whole_table_equals_brute_force_and_sql(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    got = rows_of(hn.op12_hard_negatives(spark, D))
    assert len(got) > 50 and got == by_hand(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{D}/embeddings.parquet'")
    assert sorted(con.sql(f"select {', '.join(NAMES)} from ({hn.SQL['op12_hard_negatives']})").fetchall()) == got


def test_small_blocks_ties_and_skew(spark, monkeypatch):
    """Many blocks of a few rows, a third of them one vector, scores that tie; tasks see the sizes only by the blocks they get."""
    monkeypatch.setattr(hn, "ROWS", 16)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, (6, 7)) / 256
    rows = [(i, int(rng.integers(0, 3)), (base[0] if i % 3 == 0 else base[rng.integers(0, 6)] + rng.integers(-1, 2, 7) / 256).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert rows_of(hn.mine(df, every=20)) == by_hand(rows, 20)


def test_pruning_leaves_pairs_out(spark):
    """Two clusters far apart: brackets rule most pairs out, and no asked-for pair."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 4 // 2, (rng.normal(0, 0.05, 5) + (3 if i % 2 else -3)).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert rows_of(hn.mine(df)) == by_hand(rows)
    x = np.array([[math.floor(256 * c) for c in r[2]] for r in rows], float)
    sq = np.square(x).sum(axis=1)
    m = sq.max()
    pivots = np.column_stack([x[:4], np.sqrt(m - sq[:4])])
    side = lambda last: type("S", (), {"id": np.arange(500), "sq": sq, "d": hn._distances(x, last, pivots)})()
    low, high = hn._bracket(side(np.zeros(500)), slice(0, 500), side(np.sqrt(m - sq)), m)
    s = x @ x.T
    assert (low <= s).all() and (s <= high).all() and (high < s.max(axis=1)[:, None] * 0.9).mean() > 0.4


def test_odd_rows_and_nothing(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), rng.normal(0, 1, 6).tolist()) for i in range(120)]
    odd = [(50, None, rows[0][2]), (200, 1, None), (250, 1, [None] + [0.0] * 5), (300, 1, [float("nan")] * 6), (350, 1, [float("inf")] * 6), (None, 1, rows[1][2]), (400, 1, []), (450, 1, [1.0] * 4)]
    double = [rows[3], (50, 2, rows[4][2]), (7, 1, rows[7][2])]
    full = [r for r in rows + odd + double if not (r[2] is not None and len(r[2]) == 4)]
    kinds = "vec_id long, label int, embedding array<double>, place int, block string, d int, a int, v int, sq int"
    df = spark.createDataFrame([(*r, 1, "b", 2, 3, 4, 5) for r in rows + odd + double], kinds)
    assert rows_of(hn.mine(df)) == by_hand(full)
    df.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = hn.op12_hard_negatives(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == NAMES
    assert hn.mine(df.filter("vec_id = 50")).count() == 0 and hn.mine(df.filter("vec_id = 1")).count() == 0
    with pytest.raises(Exception, match="too large"):
        hn.mine(spark.createDataFrame([(1, 1, [1e9])], "vec_id long, label int, embedding array<double>")).count()


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 2), (rng.integers(-(2**22), 2**22, 4) + 0.5).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert rows_of(hn.mine(df)) == by_hand(rows)
