"""Whitening against numpy's eigenvectors, and rows of every kind."""

import math

import numpy as np
import pytest

from proxigraph.llm import whitening

D = "/root/testdata/sf0.001"


def by_hand(vectors):
    """n, exact deviations, eigenvalues and vectors of the covariance of x."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    c = np.array([[(n * a - t) / n for a, t in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, dev, e[::-1], v[:, ::-1], c


def check(out, vectors, ids):
    n, dev, e, v, c = by_hand(vectors)
    k = max(r.component for r in out)
    got = {(r.vec_id, r.component): r for r in out}
    assert len(got) == len(out) == k * n
    for j in range(k):
        want = c @ v[:, j] / math.sqrt(e[j])
        have = np.array([got[i, j + 1].whitened for i in ids])
        sign = 1 if want @ have > 0 else -1
        assert np.abs(sign * have - want).max() < 1e-6
        assert all(got[i, j + 1].deviation == x and got[i, j + 1].n == n for i, x in zip(ids, dev, strict=True))
        assert abs(got[ids[0], j + 1].explained / (e[j] / e.sum()) - 1) < 1e-9
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9
    return k


def test_whole_table_equals_numpy(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").orderBy("vec_id").collect()
    assert check(whitening.op11_whitening(spark, D).collect(), [r.embedding for r in rows], [r.vec_id for r in rows]) == 8


def table_of(spark, rows, folder, kind="array<float>"):
    spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int, component int, whitened double, v string, id int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(12)], None, 1, 2.0, "x", 3) for i in range(60)]
    odd = [(100, None), (101, [None] + [0.0] * 11), (102, [float("nan")] * 12), (103, [float("inf")] + [0.0] * 11), (104, []), (105, [1.0] * 5)]
    d = table_of(spark, good + good[:1] + [(i, v, 1, None, None, None, None) for i, v in odd], tmp_path / "a")
    out = whitening.op11_whitening(spark, d).collect()
    n, dev, *_ = by_hand([r[1] for r in good + good[:1]])
    assert {r.vec_id for r in out} == set(range(60)) and len(out) == 8 * 61 and {r.n for r in out} == {61}
    assert {r.vec_id: r.deviation for r in out} == dict(zip([r[0] for r in good], dev, strict=False))


def test_few_dimensions_low_rank_and_nothing(spark, tmp_path):
    narrow = [(i, [float(i), float(i * i % 7)], None, None, None, None, None) for i in range(20)]
    out = whitening.op11_whitening(spark, table_of(spark, narrow, tmp_path / "a")).collect()
    assert check(out, [r[1] for r in narrow], [r[0] for r in narrow]) == 2
    line = [(i, [float(i % 5)] * 9, None, None, None, None, None) for i in range(20)]
    assert {r.component for r in whitening.op11_whitening(spark, table_of(spark, line, tmp_path / "b")).collect()} == {1}
    for name, rows in (("c", []), ("d", [(1, [1.0] * 9, None, None, None, None, None)]), ("e", [(1, None, None, None, None, None, None)])):
        out = whitening.op11_whitening(spark, table_of(spark, rows, tmp_path / name))
        assert out.count() == 0 and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark, tmp_path):
    rows = [(i, [float(2**40 + i), float(-(2**39) * (i % 3))], None, None, None, None, None) for i in range(10)]
    out = whitening.op11_whitening(spark, table_of(spark, rows, tmp_path / "a", "array<double>")).collect()
    _, dev, *_ = by_hand([r[1] for r in rows])
    assert {r.vec_id: int(r.deviation_exact) for r in out} == dict(enumerate(dev))
    with pytest.raises(Exception, match="too large"):
        whitening.op11_whitening(spark, table_of(spark, [(1, [2.0**50], None, None, None, None, None), (2, [0.0], None, None, None, None, None)], tmp_path / "b", "array<double>"))


def test_restarts_and_small_blocks_reach_the_same_vectors(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet")
    wide, small = whitening.fit(rows), whitening.fit(rows, k=3, block=3)
    assert small.passes > wide.passes
    assert np.abs(small.basis - wide.basis[:, :3]).max() < 1e-6
    assert small.residuals.max() <= whitening.TOLERANCE * small.values[0]
