"""What becomes of communities from one snapshot to the next: they split, merge, grow, shrink, stay, end or begin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.operators.subgraph import _K, _WIN, in_windows
from proxigraph.plans.components import components
from proxigraph.plans.graph import Graph, co_part, rounded, sql
from proxigraph.plans.shared import materialize

MATCH, CHANGE, LEAST = 0.3, 0.2, 2  # fixed values: shared members, change of size, smallest community


def window_communities(g: Graph, k: int) -> DataFrame:
    """(w, id, label): connected components of every window's edges, named by their least vertex. All
    windows are searched at once, as one graph whose vertices carry their window."""
    e = in_windows(g, k)
    node = lambda c: F.struct(F.col("w").alias("w"), F.col(c).alias("id"))
    c = components(e.select(node("src").alias("src"), node("dst").alias("dst")))
    return c.select("id.w", "id.id", F.col("component.id").alias("label"))


def events(labels: DataFrame, match: float = MATCH, change: float = CHANGE, least: int = LEAST) -> DataFrame:
    """(w, event, before, after, size_before, size_after): each community of at least ``least`` vertices in
    window w - 1 or w of ``labels`` (w, id, label), once, in one event.

    Two communities match where the Jaccard of their members is at least ``match``. One that matches
    several is SPLIT; several that match one, none of them split, MERGE; a pair is GROWTH or CONTRACTION
    from a change of ``change`` of the size on, else STABLE; DEATH and BIRTH have no partner (one
    whose partner came from a split is a DEATH). ``before`` and ``after`` are lists of labels, sorted: a community
    matches at most 1 / match disjoint others, so the lists are short. Sizes are sums over the lists.
    """
    if not 0 < match <= 1:
        raise ValueError("the match is above 0 and at most 1")
    labels = labels.select("w", "id", "label").filter("id is not null and label is not null").distinct()
    size = materialize(labels.groupBy("w", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= least), "sizes")
    prev = labels.select((F.col("w") + 1).alias("w"), "id", F.col("label").alias("p"))
    shared = labels.withColumnRenamed("label", "c").join(prev, ["w", "id"]).groupBy("w", "p", "c").agg(F.count("*").alias("i"))
    was = size.select((F.col("w") + 1).alias("w"), F.col("label").alias("p"), F.col("n").alias("np"))
    now = size.select("w", F.col("label").alias("c"), F.col("n").alias("nc"))
    m = shared.join(was, ["w", "p"]).join(now, ["w", "c"])
    m = m.filter(F.col("i") / (F.col("np") + F.col("nc") - F.col("i")) >= match)
    m = m.join(m.groupBy("w", "p").agg(F.count("*").alias("out")), ["w", "p"])
    m = m.join(m.groupBy("w", "c").agg(F.max("out").alias("most"), F.count("*").alias("into")), ["w", "c"])
    m = materialize(m, "matches")
    listed = lambda c: F.array_sort(F.collect_set(c))
    one = lambda c: F.array(F.col(c))
    split = m.filter("out >= 2").groupBy("w", "p", "np").agg(listed("c").alias("after"), F.sum("nc").alias("nc")).select("w", F.lit("SPLIT").alias("event"), one("p").alias("before"), "after", "np", "nc")
    merge = m.filter("most = 1 and into >= 2").groupBy("w", "c", "nc").agg(listed("p").alias("before"), F.sum("np").alias("np")).select("w", F.lit("MERGE").alias("event"), "before", one("c").alias("after"), "np", "nc")
    rate = (F.col("nc") - F.col("np")) / F.col("np")
    kind = F.when(rate >= change, "GROWTH").when(rate <= -change, "CONTRACTION").otherwise("STABLE")
    pair = m.filter("most = 1 and into = 1").select("w", kind.alias("event"), one("p").alias("before"), one("c").alias("after"), "np", "nc")
    met = materialize(split.unionByName(merge).unionByName(pair), "events")
    ends = labels.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))  # a row
    none = F.array().cast("array<string>")
    gone = was.join(met.select("w", F.explode("before").alias("p")), ["w", "p"], "left_anti").join(F.broadcast(ends)).filter("w <= hi")
    new = now.join(met.select("w", F.explode("after").alias("c")), ["w", "c"], "left_anti").join(F.broadcast(ends)).filter("w > lo")
    death = gone.select("w", F.lit("DEATH").alias("event"), one("p").alias("before"), none.alias("after"), "np", F.lit(0).cast("long").alias("nc"))
    birth = new.select("w", F.lit("BIRTH").alias("event"), none.alias("before"), one("c").alias("after"), F.lit(0).cast("long").alias("np"), "nc")
    every = met.unionByName(death).unionByName(birth)
    text = lambda c: F.array_join(c, ",")
    return every.select("w", "event", text("before").alias("before"), text("after").alias("after"), F.col("np").alias("size_before"), F.col("nc").alias("size_after"))


def event_summary(found: DataFrame) -> DataFrame:
    """(event, n, share): how often each event occurs over all windows; windows without events add none."""
    n = found.groupBy("event").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("event", "n", rounded(F.col("n") / F.col("t"), "share"))


_MORE = _WIN + f""", ed AS (SELECT w, src AS v, dst AS u FROM ew UNION ALL SELECT w, dst, src FROM ew), wr(w, id, c) AS (SELECT DISTINCT w, v, v FROM ed UNION SELECT wr.w, ed.u, wr.c FROM wr JOIN ed ON ed.w = wr.w AND ed.v = wr.id),
lb AS MATERIALIZED (SELECT w, id, min(c) AS label FROM wr GROUP BY w, id), sz AS MATERIALIZED (SELECT w, label, count(*) AS n FROM lb GROUP BY w, label HAVING count(*) >= {LEAST}),
m0 AS MATERIALIZED (SELECT y.w, x.label AS p, y.label AS c, a.n AS np, b.n AS nc FROM lb x JOIN lb y ON y.id = x.id AND y.w = x.w + 1 JOIN sz a ON a.w = x.w AND a.label = x.label JOIN sz b ON b.w = y.w AND b.label = y.label GROUP BY ALL HAVING count(*) / (a.n + b.n - count(*)) >= {MATCH}),
m1 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY w, p) AS o FROM m0), m2 AS MATERIALIZED (SELECT *, max(o) OVER (PARTITION BY w, c) AS most, count(*) OVER (PARTITION BY w, c) AS k FROM m1),
mt AS MATERIALIZED (SELECT w, 'SPLIT' AS event, p AS before, string_agg(c, ',' ORDER BY c) AS after, np AS size_before, sum(nc)::BIGINT AS size_after FROM m2 WHERE o >= 2 GROUP BY w, p, np
 UNION ALL SELECT w, 'MERGE', string_agg(p, ',' ORDER BY p), c, sum(np)::BIGINT, nc FROM m2 WHERE most = 1 AND k >= 2 GROUP BY w, c, nc
 UNION ALL SELECT w, CASE WHEN (nc - np) / np >= {CHANGE} THEN 'GROWTH' WHEN (nc - np) / np <= -{CHANGE} THEN 'CONTRACTION' ELSE 'STABLE' END, p, c, np, nc FROM m2 WHERE most = 1 AND k = 1),
lim AS (SELECT min(w) AS lo, max(w) AS hi FROM lb),
ev AS (SELECT * FROM mt UNION ALL SELECT w + 1, 'DEATH', label, '', n, 0 FROM sz, lim WHERE w < hi AND (w + 1, label) NOT IN (SELECT (w, unnest(string_split(before, ','))) FROM mt)
 UNION ALL SELECT w, 'BIRTH', '', label, 0, n FROM sz, lim WHERE w > lo AND (w, label) NOT IN (SELECT (w, unnest(string_split(after, ','))) FROM mt))"""

QUERIES = {
    "community_events": lambda s, d: events(materialize(window_communities(co_part(s, d), _K), "window-communities")),
    "community_event_summary": lambda s, d: event_summary(events(materialize(window_communities(co_part(s, d), _K), "window-communities"))),
}
SQL = {
    "community_events": sql("SELECT w::INT AS w, event, before, after, size_before, size_after FROM ev", _MORE),
    "community_event_summary": sql("SELECT event, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ev GROUP BY event", _MORE),
}
