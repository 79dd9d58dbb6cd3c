"""Annotations of vertices and edges from JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ONE = "elementId string, elementType string, note string, tags array<string>, color string, author string, priority string, createdAt bigint, updatedAt bigint"
SCHEMA = f"nodeAnnotations array<struct<{_ONE}>>, edgeAnnotations array<struct<{_ONE}>>"
PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def parse(docs: DataFrame, json: str = "json") -> DataFrame:
    """(kind, id, src, dst, note, tags, color, author, priority, created_at, updated_at), a row for each
    annotation of the JSON texts in column ``json``.

    Edges are named ``src--dst``; one without that form counts as a vertex. Without an id or a type
    an annotation is left out, as is a text that is no JSON. Unknown priorities and times of zero are null.
    """
    x = docs.select(F.from_json(F.col(json), SCHEMA).alias("j"))
    x = x.select(F.explode(F.concat(*[F.coalesce(f"j.{c}Annotations", F.array().cast(f"array<struct<{_ONE}>>")) for c in ("node", "edge")])).alias("a")).select("a.*")
    ends = F.split("elementId", "--", 2)
    edge = (F.col("elementType") != "NODE") & (F.size(ends) == 2)
    time = lambda c: F.when(F.col(c) > 0, F.col(c))
    return x.filter("elementId is not null and elementType is not null").select(
        F.when(edge, "edge").otherwise("node").alias("kind"), F.col("elementId").alias("id"), F.when(edge, F.get(ends, F.lit(0))).alias("src"), F.when(edge, F.get(ends, F.lit(1))).alias("dst"),
        "note", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "color", "author", F.when(F.col("priority").isin(*PRIORITIES), F.col("priority")).alias("priority"), time("createdAt").alias("created_at"), time("updatedAt").alias("updated_at"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of all JSON files of a folder, a document a file."""
    return parse(spark.read.text(path, wholetext=True), "value")
