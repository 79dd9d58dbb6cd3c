import json
import os
import subprocess
import sys
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from proxigraph.sources import annotations, edge_list, jdbc

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_jdbc_tables_come_back_in_ranges(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    df = spark.range(200).select(F.col("id").cast("int").alias("node"), F.concat(F.lit("imei"), F.col("id").cast("string")).alias("imei"))
    jdbc.write(df, url, "device_1", "overwrite", **DERBY)
    got = jdbc.read(spark, url, "device_1", "node", parts=4, **DERBY)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert jdbc.read(spark, url, "device_1", **DERBY).filter("node < 5").count() == 5
    jdbc.write(df.limit(0), url, "empty_1", "overwrite", **DERBY)
    assert jdbc.read(spark, url, "empty_1", "node", **DERBY).count() == 0


def test_annotations(spark, tmp_path):
    doc = {"nodeAnnotations": [{"elementId": "a", "elementType": "NODE", "note": "x", "tags": ["p", "q"], "priority": "HIGH", "createdAt": 5, "updatedAt": 0}, {"elementType": "NODE"}],
           "edgeAnnotations": [{"elementId": "a--b--c", "elementType": "EDGE", "priority": "odd"}, {"elementId": "ab", "elementType": "EDGE"}]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "two.json").write_text("no json")
    got = {r.id: r for r in annotations.read(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a", "a--b--c", "ab"}
    assert (got["a"].kind, got["a"].tags, got["a"].priority, got["a"].created_at, got["a"].updated_at) == ("node", ["p", "q"], "HIGH", 5, None)
    assert (got["a--b--c"].src, got["a--b--c"].dst, got["a--b--c"].priority) == ("a", "b--c", None) and got["ab"].kind == "node"


def test_edge_list_in_several_files_loses_no_line(spark, tmp_path):
    edges = spark.range(2000).select(F.format_string("a%04d", "id").alias("src"), F.format_string("b%04d", F.col("id") % 97).alias("dst"), F.lit("f").alias("type"), (F.col("id") / 4).alias("weight"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edge_list.write(edges, str(tmp_path / "g"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "g").glob("part-*"))) > 1
    g, bad = edge_list.read(spark, str(tmp_path / "g"))
    want = {(r.src, r.dst, r.weight) for r in edges.collect()}
    assert bad.count() == 0 and g.edges.count() == 2000 and {(r.src, r.dst, r.weight) for r in g.edges.collect()} == want
    (tmp_path / "g" / "z.txt").write_text("nodes\nlone\nedges\nf a b 2\n")
    g, bad = edge_list.read(spark, str(tmp_path / "g"))
    assert bad.count() == 0 and g.edges.count() == 2001 and g.vertices.filter("id = 'lone'").count() == 1


def test_session_without_a_preset_checkpoint_folder(tmp_path):
    code = """
from pyspark.sql import SparkSession
from proxigraph.plans.shared import materialize, shared_root
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
assert materialize(s.range(5), "t").count() == 5 and shared_root(s) == shared_root(s)
print("fine")
"""
    root = str(Path(__file__).resolve().parent.parent)
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]
