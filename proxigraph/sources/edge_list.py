"""The text format of graphs: ``nodes`` and ``edges`` sections, ``type v1 v2 weight`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.plans.graph import Graph


def read(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """(graph, skipped): every edge of the file, and the lines left out with the reason.

    Lines with fewer than four fields and weights that are no finite numbers are skipped. The
    section of a line is that of the last marker before it in its own file, ``edges`` where there is
    none: every file is read by itself, so a folder may hold the files of ``write`` or several graphs."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.last(F.when(F.col("line").isin("nodes", "edges"), F.col("line")), ignorenulls=True).over(w)
    marked = lines.withColumn("section", F.coalesce(section, F.lit("edges"))).filter((F.col("line") != "") & ~F.col("line").isin("nodes", "edges"))
    part = F.split("line", r"\s+")
    e = marked.filter("section = 'edges'").select("file", "n", "line", part.alias("p")).withColumn("weight", F.expr("try_cast(get(p, 3) as float)"))
    bad = F.when(F.size("p") < 4, "fields").when(F.col("weight").isNull() | F.isnan("weight") | F.col("weight").isin(float("inf"), float("-inf")), "weight")
    good = e.filter(bad.isNull())
    null = lambda t: F.lit(None).cast(t)
    edges = good.select(F.get("p", F.lit(1)).alias("src"), F.get("p", F.lit(2)).alias("dst"), F.get("p", F.lit(0)).alias("type"), F.col("weight").cast("double").alias("weight"), null("string").alias("label"), null("long").alias("ts"), null("long").alias("end_ts"))
    nodes = marked.filter("section = 'nodes'").select(F.col("line").alias("id"))
    return Graph(nodes.unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id"))).distinct(), edges), e.filter(bad.isNotNull()).select("file", "n", "line", bad.alias("reason"))


def write(edges: DataFrame, path: str) -> None:
    """``edges`` header and a line per edge, ordered; a large graph is several files in order of name,
    of which the first has the header."""
    rows = edges.select(F.lit(1).alias("k"), F.concat_ws(" ", "type", "src", "dst", F.col("weight").cast("string")).alias("value"))
    head = edges.sparkSession.createDataFrame([(0, "edges")], "k int, value string")
    head.unionByName(rows).repartitionByRange("k", "value").sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)
