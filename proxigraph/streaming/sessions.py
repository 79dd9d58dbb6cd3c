"""Meetings from a stream of contacts: the batch rule of a gap, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(contacts: DataFrame, keys: list[str], ts: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(keys, start_ts, end_ts, n) of each session of a streaming table; closes when the watermark passes.

    ``end_ts`` is the last contact: the window's own end lies a gap later. A gap of exactly ``gap``
    joins two contacts, as in the batch operator."""
    s = contacts.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n"))
    return s.select(*keys, "start_ts", "end_ts", "n")
