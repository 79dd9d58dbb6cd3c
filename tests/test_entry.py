import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["relationship_edges", "proximity_scan", "device_match", "sessionize_pair", "ap_intersect_top1", "nodes_by_type", "edges_between", "query_stats", "degree_stats", "rich_club", "nmi", "local_clustering", "squares", "predict_ensemble", "edge_persistence", "graph_diff", "merge_left", "bfs_levels", "export_laplacian", "merge_union", "triangles", "shortest_path_weight", "betweenness", "label_propagation", "strong_components", "topological_levels", "centrality_spearman", "sample_nodes", "mst_users", "similar_above_threshold", "signed_strong_balance", "velocity", "node_lifecycles", "momentum", "export_gexf", "export_dimacs", "csv_escape", "string_lower",
        "louvain_moves", "maximal_cliques", "clique_summary", "pattern_square", "pattern_clique", "all_simple_paths", "k_shortest_paths", "girth", "edge_changes", "voronoi_weighted", "merge_intersection", "change_points", "k_nearest",
        "critical_path", "quotient_attribute", "quotient_khop", "truss_numbers", "truss_profile", "community_events", "shortest_path_waypoints"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return con


def one(v):
    if v is None or v != v:
        return "NULL"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, D)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(got.columns)
    want = sorted(tuple(one(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(one(r[c]) for c in cols) for r in got.collect()) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(entry.oracle_sql().values())


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
