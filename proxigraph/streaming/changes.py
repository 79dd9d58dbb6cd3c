"""Edges that appear and vanish in a stream of graph snapshots, with a state per edge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "src string, dst string, ts timestamp, change string"


def stream_changes(links: DataFrame, step: str = "1 hour", late: str = "0 seconds", src: str = "src", dst: str = "dst", ts: str = "ts") -> DataFrame:
    """(src, dst, ts, change) of a streaming table of links (src, dst, ts): ``new`` at the first of the steps of
    ``step`` in which a link stands, ``lost`` at the first step after them in which it does not.

    Times are cut to the start of their step; links are undirected; rows may come in any order until the
    watermark, ``late`` behind the latest time, has passed their step, and later ones are dropped. A step's changes are
    told when the watermark has passed it, each once, also after a restart from the checkpoint. State is the last
    step told of and the steps not yet told, for a link that stands; nothing for others."""
    width = F.expr(f"interval {step}")
    at = F.window(ts, step)["start"]
    one = links.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(ts).isNotNull()).select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), at.alias("ts"), (at + width).alias("until"))
    ms = int(pd.Timedelta(step).total_seconds() * 1000)

    def tell(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        now = state.getCurrentWatermarkMs()
        got = {int(x.timestamp() * 1000) for b in batches for x in b["ts"]} if not state.hasTimedOut else set()
        # The pandas times are those of the session's zone; steps are told by their start in milliseconds.
        waiting = sorted(set(waiting) | {x for x in got if x + ms > now and (last is None or x > last)})
        out = []
        while True:
            if last is not None and last + ms + ms <= now and (not waiting or waiting[0] > last + ms):
                out.append((last + ms, "lost"))
                last = None
            elif waiting and waiting[0] + ms <= now:
                if last is None:
                    out.append((waiting[0], "new"))
                last = waiting.pop(0)
            else:
                break
        if last is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((last, waiting))
            nexts = [waiting[0] + ms] if waiting else []
            nexts += [last + ms + ms] if last is not None else []
            state.setTimeoutTimestamp(max(min(nexts), now + 1))
        if out:
            yield pd.DataFrame({"src": key[0], "dst": key[1], "ts": pd.to_datetime([t for t, _ in out], unit="ms"), "change": [c for _, c in out]})

    marked = one.withWatermark("ts", late)
    return marked.groupBy("src", "dst").applyInPandasWithState(tell, OUT, "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def batch_changes(links: DataFrame, step: str = "1 hour", src: str = "src", dst: str = "dst", ts: str = "ts") -> DataFrame:
    """The same of a table as a whole; links that stand in the last step of all are not lost."""
    from pyspark.sql import Window

    at = F.window(ts, step)["start"]
    one = links.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(ts).isNotNull()).select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), at.alias("ts")).distinct()
    width, w = F.expr(f"interval {step}"), Window.partitionBy("src", "dst").orderBy("ts")
    last = one.agg(F.max("ts").alias("end"))
    x = one.withColumn("before", F.lag("ts").over(w)).withColumn("after", F.lead("ts").over(w)).join(last)
    new = x.filter(F.col("before").isNull() | (F.col("before") + width < F.col("ts"))).select("src", "dst", "ts", F.lit("new").alias("change"))
    gone = (F.col("after").isNull() | (F.col("after") > F.col("ts") + width)) & (F.col("ts") < F.col("end"))
    return new.unionByName(x.filter(gone).select("src", "dst", (F.col("ts") + width).alias("ts"), F.lit("lost").alias("change")))
