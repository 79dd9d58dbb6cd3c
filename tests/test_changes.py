"""Changes of edges over micro-batches with a restart, against the batch version."""

import datetime as dt

from pyspark.sql import functions as F

from proxigraph.streaming.changes import batch_changes, stream_changes


def test_changes_over_batches_and_a_restart(spark, tmp_path):
    hour = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [
        [("a", "b", hour(0, 5)), ("b", "a", hour(0, 50)), ("c", "d", hour(0, 1)), ("a", "b", hour(1, 3)), (None, "b", hour(1))],
        [("a", "b", hour(2)), ("e", "f", hour(3, 59)), ("c", "d", hour(4, 2)), ("c", "d", hour(5)), ("a", "b", hour(5, 1))],
        [("a", "b", hour(6)), ("e", "f", hour(8)), ("g", "g", hour(9)), ("z", "z", hour(20))],
    ]
    kinds = "src string, dst string, ts timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))

    def run():
        q = stream_changes(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()

    for rows in batches:  # the query starts anew for each
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    full = spark.createDataFrame([r for b in batches for r in b], kinds)
    want = sorted(map(tuple, batch_changes(full).filter(F.col("ts") < F.lit(hour(20))).select("src", "dst", "ts", "change").collect()))
    assert got == want and len(got) == 14 and len(set(got)) == len(got)
