"""Queries against their SQL on users that follow each other in one long line."""

import datetime as dt
import math

import duckdb
import pytest
from test_entry import one

import __spark_entry__ as entry


def line(spark, folder, n):
    """Users 0 to n - 1 in turn, on two days."""
    rows = [(d * n + u, dt.datetime(2024, 1, 1 + d, 10, u // 60, u % 60), u) for d in range(2) for u in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name, n", [("bfs_levels", 18), ("voronoi", 18), ("growth_profile", 18), ("distance_percentiles", 20), ("sample_snowball", 60)])
def test_more_than_twelve_hops(spark, tmp_path, name, n):
    d = line(spark, tmp_path, n)
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{d}/events.parquet/*.parquet')")
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(rel.columns)
    want = sorted(tuple(one(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    got = entry.queries()[name](spark, d)
    assert sorted(got.columns) == cols and sorted(tuple(one(r[c]) for c in cols) for r in got.collect()) == want


def of_line(spark, folder, name, n):
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{line(spark, folder, n)}/events.parquet/*.parquet')")
    rel = duck.sql(entry.oracle_sql()[name])
    return [dict(zip(rel.columns, r)) for r in rel.fetchall()]


def place(r):
    return min(int(r["src"][1:]), int(r["dst"][1:]))


def test_sql_of_betweenness_edges(spark, tmp_path):
    got = of_line(spark, tmp_path, "betweenness_edges", 30)
    assert {place(r): r["betweenness"] for r in got} == {i: (i + 1) * (29 - i) for i in range(29)}


def test_sql_of_betweenness(spark, tmp_path):
    got = of_line(spark, tmp_path, "betweenness", 30)
    assert {r["id"]: r["betweenness"] for r in got} == {f"u{i}": i * (29 - i) for i in range(30)}


def weight(i):
    """Importance of the i-th edge of a line of 30: a bridge, by betweenness, by degrees."""
    return round(0.5 + 0.3 * (i + 1) * (29 - i) / 225 + 0.2 * (0.25 if i in (0, 28) else 0), 6)


def test_sql_of_edge_importance(spark, tmp_path):
    got = of_line(spark, tmp_path, "edge_importance", 30)
    assert {place(r): r["importance"] for r in got} == pytest.approx({i: weight(i) for i in range(29)}, abs=1.5e-6)


def test_sql_of_sparsify_importance(spark, tmp_path):
    assert sorted(map(place, of_line(spark, tmp_path, "sparsify_importance", 60))) == list(range(17, 41))


def test_sql_of_spectral_radius(spark, tmp_path):
    assert of_line(spark, tmp_path, "spectral_radius", 14) == [{"radius": round(2 * math.cos(math.pi / 15), 5)}]


def test_sql_of_eigenvector_centrality(spark, tmp_path):
    got = {r["id"]: r["centrality"] for r in of_line(spark, tmp_path, "eigenvector_centrality", 15)}
    assert got == pytest.approx({f"u{i}": math.sin(math.pi * (i + 1) / 16) for i in range(15)}, abs=1.5e-5)
