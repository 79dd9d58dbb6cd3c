"""How a graph changes from window to window: velocity, change points, momentum, life of vertices,
communities that stay, join or part. Series have a row per window, so windows over them are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.operators.subgraph import _K, _WIN, growth, in_windows
from proxigraph.plans.graph import Graph, co_part, rounded, sql
from proxigraph.plans.session import table
from proxigraph.streaming.changes import batch_changes

METRICS = ("n", "m", "density")
SLACK, ALARM = 0.5, 3.0  # of the change-point sums
EASY = 1.0  # the alarm of the query: its series of few windows seldom reach 3
JACCARD = 0.3


def velocity(g: Graph, k: int) -> DataFrame:
    """(w, d_n, d_m, d_density, speed): change against the window before, relative to it (to 1 where it
    was 0), and the length of the three."""
    w = Window.orderBy("w")  # a row per window
    x = growth(g, k).withColumns({f"p_{c}": F.lag(c).over(w) for c in METRICS}).filter("p_n is not null")
    d = {c: F.when(F.col(f"p_{c}") == 0, F.col(c)).otherwise((F.col(c) - F.col(f"p_{c}")) / F.abs(F.col(f"p_{c}"))).cast("double") for c in METRICS}
    return x.select("w", *[rounded(d[c], f"d_{c}") for c in METRICS], rounded(F.sqrt(sum((d[c] * d[c] for c in METRICS), F.lit(0.0))), "speed"))


def change_points(g: Graph, k: int, alarm: float = ALARM) -> DataFrame:
    """(w, direction, value): windows where the sum of standardised changes of the edge count, less the
    slack, passes ``alarm``; the sum starts again after an alarm. None below three windows or without spread."""
    w = Window.orderBy("w")
    d = growth(g, k).select("w", (F.col("m") - F.lag("m").over(w)).cast("double").alias("d")).filter("d is not null")
    a = d.agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.sort_array(F.collect_list(F.struct("w", "d"))).alias("x")).filter("sd >= 1e-10 and size(x) >= 2")  # a row per window
    hit = "array<struct<w:int,direction:string,value:double>>"
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast(hit).alias("out"))

    def step(s, x):
        z = (x["d"] - F.col("mean")) / F.col("sd")
        up, down = F.greatest(F.lit(0.0), s["up"] + z - SLACK), F.greatest(F.lit(0.0), s["down"] - z - SLACK)
        one = lambda on, v, name: F.when(on, F.array(F.struct(x["w"].alias("w"), F.lit(name).alias("direction"), v.alias("value")))).otherwise(F.array()).cast(hit)
        return F.struct(F.when(up > alarm, 0.0).otherwise(up).alias("up"), F.when(down > alarm, 0.0).otherwise(down).alias("down"), F.concat(s["out"], one(up > alarm, up, "increase"), one(down > alarm, down, "decrease")).alias("out"))

    return a.select(F.explode(F.aggregate("x", start, step, lambda s: s["out"])).alias("p")).select("p.w", "p.direction", rounded("p.value", "value"))


def momentum(g: Graph, k: int) -> DataFrame:
    """One row: phase by mean and gain of the last three speeds and the change of density."""
    v = velocity(g, k).orderBy(F.desc("w")).limit(3)
    a = v.agg(F.avg("speed").alias("speed"), (F.max_by("speed", "w") - F.min_by("speed", "w")).alias("gain"), F.sum("d_density").alias("density"))
    s, x = F.col("speed"), F.col("gain")
    phase = F.when(s.isNull(), "STAGNANT").when((s > 1.0) & (x > 0.2), "EXPLOSIVE").when((s > 0.3) & (x > 0), "ACCELERATING").when((s > 0.1) & (F.abs(x) < 0.1), "STEADY").when((s > 0.1) & (x < -0.1), "DECELERATING").when(s < 0.05, "STAGNANT").when(F.col("density") < -0.3, "COLLAPSING").otherwise("STEADY")
    return a.select(rounded("speed", "speed", 4), rounded("gain", "gain", 4), phase.alias("phase"))


def lifecycles(g: Graph, k: int) -> DataFrame:
    """(id, slope, volatility, kind) of every vertex that some window has. Importance is degree over
    n - 1 of the window, 0 where it is missing; absent windows need no rows, as sums close the gaps."""
    e = in_windows(g, k)
    d = e.select("w", F.explode(F.array("src", "dst")).alias("id")).groupBy("w", "id").agg(F.count("*").alias("d"))
    n = d.groupBy("w").agg(F.count("*").alias("n"))
    x = d.join(F.broadcast(n), "w").select("id", "w", F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1)).otherwise(0.0).alias("y"))  # n: a row per window
    grid = x.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "y"))).alias("at"))
    ys = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda w: F.coalesce(F.try_element_at("at", w), F.lit(0.0)))
    grid = grid.select("id", ys.alias("y"))
    total = lambda f: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, i: s + f(i))
    sx, sxx = k * (k - 1) / 2, k * (k - 1) * (2 * k - 1) / 6
    slope = (k * total(lambda i: i * F.get("y", i)) - sx * total(lambda i: F.get("y", i))) / (k * sxx - sx * sx)
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), F.lit(0.0), lambda s, i: s + F.abs(F.get("y", i) - F.get("y", i - 1))) / (k - 1)
    z = grid.select("id", slope.alias("s"), moved.alias("v"), (F.get("y", F.lit(0)) > 0).alias("a"), (F.get("y", F.lit(k - 1)) > 0).alias("b"))
    kind = F.when(~F.col("a") & F.col("b"), "NEWCOMER").when(F.col("a") & ~F.col("b"), "DEPARTING").when(F.col("v") > 0.15, "VOLATILE").when(F.col("s") > 0.02, "RISING").when(F.col("s") < -0.02, "DECLINING").otherwise("STABLE")
    return z.select("id", (F.round("s", 4) + 0.0).alias("slope"), rounded("v", "volatility", 4), kind.alias("kind"))


def community_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(before, after, jaccard): communities (id, label) of two snapshots that share at least JACCARD of
    their members; communities of one vertex are left out."""
    size = lambda x, n: x.groupBy("label").agg(F.count("*").alias(n)).filter(F.col(n) > 1)
    x, y = a.select("id", F.col("label").alias("before")), b.select("id", F.col("label").alias("after"))
    i = x.join(y, "id").groupBy("before", "after").agg(F.count("*").alias("i"))
    i = i.join(size(a, "p").withColumnRenamed("label", "before"), "before").join(size(b, "q").withColumnRenamed("label", "after"), "after")
    return i.select("before", "after", rounded(F.col("i") / (F.col("p") + F.col("q") - F.col("i")), "jaccard")).filter(F.col("jaccard") >= JACCARD)


def _snapshots(s, d):
    from proxigraph.operators.iterative import connected
    from proxigraph.operators.subgraph import _half

    g = co_part(s, d)
    return [connected(_half(g, first)).withColumnRenamed("component", "label") for first in (True, False)]


_VEL = _WIN + ", pv AS (SELECT *, lag(n) OVER (ORDER BY w) AS pn, lag(m) OVER (ORDER BY w) AS pm, lag(density) OVER (ORDER BY w) AS pd FROM gr), ve AS (SELECT w, dn, dm, dd, sqrt(dn * dn + dm * dm + dd * dd) AS speed FROM (SELECT w, " + ", ".join(f"CASE WHEN p{p} = 0 THEN {c}::DOUBLE ELSE ({c} - p{p}) / abs(p{p}) END AS d{p}" for c, p in (("n", "n"), ("m", "m"), ("density", "d"))) + " FROM pv WHERE pn IS NOT NULL))"
_CUSUM = _WIN + f""", df AS (SELECT w, (m - lag(m) OVER (ORDER BY w))::DOUBLE AS d FROM gr), st AS (SELECT avg(d) AS mean, stddev_pop(d) AS sd FROM df WHERE d IS NOT NULL),
cs(w, up, down, ru, rd) AS (SELECT (SELECT min(w) FROM gr), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT df.w, greatest(0, ru + (d - mean) / sd - 0.5), greatest(0, rd - (d - mean) / sd - 0.5),
 CASE WHEN greatest(0, ru + (d - mean) / sd - 0.5) > {EASY} THEN 0 ELSE greatest(0, ru + (d - mean) / sd - 0.5) END, CASE WHEN greatest(0, rd - (d - mean) / sd - 0.5) > {EASY} THEN 0 ELSE greatest(0, rd - (d - mean) / sd - 0.5) END FROM cs JOIN df ON df.w = cs.w + 1, st)"""
_LIFE = _WIN + f""", dw AS (SELECT w, id, count(*) AS d FROM (SELECT w, unnest([src, dst]) AS id FROM ew) GROUP BY 1, 2), nw AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
gy AS (SELECT i.id, k.w, coalesce(CASE WHEN n > 1 THEN d / (n - 1) ELSE 0 END, 0) AS y FROM (SELECT DISTINCT id FROM dw) i CROSS JOIN (SELECT unnest(range({_K})) AS w) k LEFT JOIN dw ON dw.id = i.id AND dw.w = k.w LEFT JOIN nw ON nw.w = k.w),
li AS (SELECT id, regr_slope(y, w) AS s, sum(abs(y - p)) / {_K - 1} AS v, max(y) FILTER (w = 0) > 0 AS a, max(y) FILTER (w = {_K - 1}) > 0 AS b FROM (SELECT *, lag(y) OVER (PARTITION BY id ORDER BY w) AS p FROM gy) GROUP BY id)"""
def user_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, ts): users whose events follow each other within a day, at the time of the first."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.date_trunc("day", "ts").alias("day"))
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    nxt = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    return ev.select(name(F.col("user_id")).alias("src"), name(nxt).alias("dst"), "ts").filter("dst is not null")


_CHANGES = """WITH n AS (SELECT 'u' || user_id AS a, 'u' || lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS b, date_trunc('day', ts)::TIMESTAMP AS t FROM events),
o AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst, t FROM n WHERE b IS NOT NULL),
x AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS q, max(t) OVER () AS e FROM o WINDOW w AS (PARTITION BY src, dst ORDER BY t))
SELECT src, dst, strftime(t, '%Y-%m-%d') AS day, 'new' AS change FROM x WHERE p IS NULL OR p + INTERVAL 1 DAY < t
UNION ALL SELECT src, dst, strftime(t + INTERVAL 1 DAY, '%Y-%m-%d'), 'lost' FROM x WHERE (q IS NULL OR q > t + INTERVAL 1 DAY) AND t < e"""

QUERIES = {
    "edge_changes": lambda s, d: batch_changes(user_links(s, d), "1 day").select("src", "dst", F.date_format("ts", "yyyy-MM-dd").alias("day"), "change"),
    "velocity": lambda s, d: velocity(co_part(s, d), _K),
    "change_points": lambda s, d: change_points(co_part(s, d), _K, EASY),
    "momentum": lambda s, d: momentum(co_part(s, d), _K),
    "node_lifecycles": lambda s, d: lifecycles(co_part(s, d), _K),
    "community_matches": lambda s, d: community_matches(*_snapshots(s, d)),
}
_half_components = lambda x: f"r{x}(id, c) AS (SELECT id, id FROM v{x} UNION SELECT q.u, r{x}.c FROM r{x} JOIN (SELECT src AS v, dst AS u FROM e{x} UNION ALL SELECT dst, src FROM e{x}) q ON q.v = r{x}.id), c{x} AS MATERIALIZED (SELECT id, min(c) AS label FROM r{x} GROUP BY id), n{x} AS (SELECT label, count(*) AS n FROM c{x} GROUP BY label HAVING count(*) > 1)"
SQL = {
    "edge_changes": _CHANGES,
    "velocity": sql("SELECT w, round(dn, 6) AS d_n, round(dm, 6) AS d_m, round(dd, 6) AS d_density, round(speed, 6) AS speed FROM ve", _VEL),
    "change_points": sql(f"SELECT w, 'increase' AS direction, round(up, 6) AS value FROM cs WHERE up > {EASY} UNION ALL SELECT w, 'decrease', round(down, 6) FROM cs WHERE down > {EASY}", _CUSUM),
    "momentum": sql("SELECT round(s, 4) AS speed, round(x, 4) AS gain, CASE WHEN s IS NULL THEN 'STAGNANT' WHEN s > 1.0 AND x > 0.2 THEN 'EXPLOSIVE' WHEN s > 0.3 AND x > 0 THEN 'ACCELERATING' WHEN s > 0.1 AND abs(x) < 0.1 THEN 'STEADY' WHEN s > 0.1 AND x < -0.1 THEN 'DECELERATING' WHEN s < 0.05 THEN 'STAGNANT' WHEN de < -0.3 THEN 'COLLAPSING' ELSE 'STEADY' END AS phase FROM (SELECT avg(speed) AS s, arg_max(speed, w) - arg_min(speed, w) AS x, sum(dd) AS de FROM (SELECT * FROM ve ORDER BY w DESC LIMIT 3))", _VEL),
    "node_lifecycles": sql("SELECT id, round(s, 4) + 0.0 AS slope, round(v, 4) AS volatility, CASE WHEN NOT a AND b THEN 'NEWCOMER' WHEN a AND NOT b THEN 'DEPARTING' WHEN v > 0.15 THEN 'VOLATILE' WHEN s > 0.02 THEN 'RISING' WHEN s < -0.02 THEN 'DECLINING' ELSE 'STABLE' END AS kind FROM li", _LIFE),
}


def _matches_sql() -> str:
    from proxigraph.operators.subgraph import _HALF

    return sql("SELECT * FROM (SELECT x.label AS before, y.label AS after, round(count(*) / (max(na.n) + max(nb.n) - count(*)), 6) AS jaccard FROM ca x JOIN cb y USING (id) JOIN na ON na.label = x.label JOIN nb ON nb.label = y.label GROUP BY 1, 2) WHERE jaccard >= 0.3", _HALF + ", " + _half_components("a") + ", " + _half_components("b"))


SQL["community_matches"] = _matches_sql()
