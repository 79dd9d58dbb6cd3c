"""Intermediate tables in the folder that driver and executors share.

Iterative plans cut their lineage here: a table is written once, as compressed Parquet,
and read back, so a lost executor costs at most the stage that is running.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_roots: dict[str, str] = {}  # by application; the setting itself can only be given at the start


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, given when the session starts. A local session without
    one gets a temporary folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _roots:
        _roots[app] = "file://" + tempfile.mkdtemp(prefix="proxigraph-")
        _made.append((spark, _roots[app]))
    return _roots[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that no one has used; removed when the driver ends."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a plain scan of it (see ``drop``)."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._proxigraph_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Remove a table made by ``materialize`` that no plan reads any more."""
    path = getattr(df, "_proxigraph_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended already
            return


atexit.register(_clean)
