from pyspark.sql import functions as F

from proxigraph.streaming.sessions import stream_sessions


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [("a", "10:00"), ("a", "10:05"), ("a", "10:11"), ("b", "10:00"), ("z", "13:00")]
    df = spark.createDataFrame([(k, f"2011-03-01 {t}:00") for k, t in rows], "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, ["k"]).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.k, r.start_ts.hour, r.start_ts.minute, r.end_ts.minute, r.n) for r in spark.table("sessions").collect())
    assert got == [("a", 10, 0, 5, 2), ("a", 10, 11, 11, 1), ("b", 10, 0, 0, 1)]
