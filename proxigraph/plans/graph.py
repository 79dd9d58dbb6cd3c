"""Graphs as two tables, and the graphs that queries derive from the data tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize

EDGE_COLUMNS = ("src", "dst", "type", "weight", "label", "ts", "end_ts")


@dataclass(frozen=True)
class Graph:
    """``vertices(id)`` and ``edges(src, dst, type, weight, label, ts, end_ts)``.

    Undirected graphs hold one edge per unordered pair with src < dst; vertices may be isolated.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    def canonical(self) -> Graph:
        """One edge per unordered pair, ends in order, loops dropped: of parallel edges the first
        by type, weight and ts, without a window over a pair's edges."""
        e = self.edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *EDGE_COLUMNS[2:])
        rest = F.struct(*EDGE_COLUMNS[2:])
        return Graph(self.vertices, e.groupBy("src", "dst").agg(F.min(rest).alias("x")).select("src", "dst", "x.*"))

    def both(self, *more: str) -> DataFrame:
        """(v, u, *more): every edge from both of its ends."""
        e = self.edges
        return e.select(F.col("src").alias("v"), F.col("dst").alias("u"), *more).unionByName(e.select(F.col("dst").alias("v"), F.col("src").alias("u"), *more))

    def degrees(self) -> DataFrame:
        """(id, degree) of every vertex, 0 for isolated ones."""
        d = self.both().groupBy(F.col("v").alias("id")).agg(F.count("*").alias("d"))
        return self.vertices.join(d, "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))

    def wedges(self) -> DataFrame:
        """(m, a, b): paths a - m - b with a < b, from neighbour pairs of each middle vertex."""
        s = self.both()
        left, right = s.select(F.col("v").alias("m"), F.col("u").alias("a")), s.select(F.col("v").alias("m"), F.col("u").alias("b"))
        return left.join(right, "m").filter(F.col("a") < F.col("b"))

    def triangles(self) -> DataFrame:
        """(a, b, c) with a < b < c. Wedges are opened at the vertex of least degree, so a hub
        never pairs up its neighbours."""
        d = self.both().groupBy(F.col("v").alias("id")).agg(F.count("*").alias("d"))
        key = lambda c: F.struct(F.col(f"{c}_d"), F.col(c))
        e = self.edges.select("src", "dst").join(d.select(F.col("id").alias("src"), F.col("d").alias("src_d")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dst_d")), "dst")
        up = e.select(F.when(key("src") < key("dst"), F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(key("src") < key("dst"), F.col("dst")).otherwise(F.col("src")).alias("y"))
        pair = up.select("x", F.col("y").alias("p")).join(up.select("x", F.col("y").alias("q")), "x").filter(F.col("p") < F.col("q"))
        closed = pair.join(self.edges.select(F.col("src").alias("p"), F.col("dst").alias("q")), ["p", "q"])
        s = F.sort_array(F.array("x", "p", "q"))
        return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


TYPES = ("f", "c", "fs", "s", "sg")


def co_part(spark: SparkSession, sf_dir: str, least: int = 2) -> Graph:
    """Parts that orders have in common: weight is the number of orders, ts and end_ts the first
    and last order date in milliseconds, type a bucket of the keys, label the brand of src."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    part = table(spark, sf_dir, "part")
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long").alias("t"))
    a = lines.join(dates, "l_orderkey").select("l_orderkey", "t", F.col("l_partkey").alias("p"))
    b = lines.select("l_orderkey", F.col("l_partkey").alias("q"))
    pair = a.join(b, "l_orderkey").filter(F.col("p") < F.col("q"))
    e = pair.groupBy("p", "q").agg(F.count("*").alias("w"), F.min("t").alias("ts"), F.max("t").alias("end_ts")).filter(F.col("w") >= least)
    e = e.join(part.select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("label")), "p")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), ((F.col("p") + F.col("q")) % 5).cast("int"))
    edges = e.select(F.least(name("p"), name("q")).alias("src"), F.greatest(name("p"), name("q")).alias("dst"), kind.alias("type"), F.col("w").cast("double").alias("weight"), "label", "ts", "end_ts")
    return Graph(part.select(name("p_partkey").alias("id")), materialize(edges, "co-part"))  # operators read it several times


#: The same graph for DuckDB: CTEs v(id) and e(src, dst, type, weight, label, ts, end_ts), s(v, u, type, weight), d(id, degree).
CO_PART_SQL = """
ol AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
pq AS MATERIALIZED (SELECT a.p, b.p AS q, count(*) AS w, min(epoch_ms(o_orderdate)) AS ts, max(epoch_ms(o_orderdate)) AS end_ts
       FROM ol a JOIN ol b ON a.o = b.o AND a.p < b.p JOIN orders ON o_orderkey = a.o GROUP BY a.p, b.p HAVING count(*) >= 2),
v AS (SELECT 'p' || p_partkey AS id FROM part),
e AS MATERIALIZED (SELECT least('p' || p, 'p' || q) AS src, greatest('p' || p, 'p' || q) AS dst, (['f', 'c', 'fs', 's', 'sg'])[(p + q) % 5 + 1] AS type,
             w::DOUBLE AS weight, p_brand AS label, ts, end_ts FROM pq JOIN part ON p_partkey = p),
s AS (SELECT src AS v, dst AS u, type, weight FROM e UNION ALL SELECT dst, src, type, weight FROM e),
d AS (SELECT id, coalesce(n, 0)::BIGINT AS degree FROM v LEFT JOIN (SELECT v AS x, count(*) AS n FROM s GROUP BY v) ON x = id)"""


def sql(body: str, more: str = "") -> str:
    """DuckDB SQL over the graph's CTEs."""
    return f"WITH RECURSIVE {CO_PART_SQL}{',' if more else ''}\n{more}\n{body}"


def user_seq(spark: SparkSession, sf_dir: str, least: int = 2) -> Graph:
    """Users whose events follow each other directly, at least ``least`` times; undirected.

    Events follow each other within a day: order is found day by day, not in one task."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.date_trunc("day", "ts").alias("day"))
    nxt = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    e = ev.select(F.col("user_id").alias("a"), nxt.alias("b")).filter(F.col("a") != F.col("b"))
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    x, y = name(F.col("a")), name(F.col("b"))
    e = e.select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).filter(F.col("weight") >= least)
    null = lambda t: F.lit(None).cast(t)
    edges = e.select("src", "dst", F.lit("f").alias("type"), "weight", null("string").alias("label"), null("long").alias("ts"), null("long").alias("end_ts"))
    return Graph(table(spark, sf_dir, "events").select(name(F.col("user_id")).alias("id")).distinct(), materialize(edges, "user-seq"))


def user_next(spark: SparkSession, sf_dir: str, least: int = 2) -> Graph:
    """As ``user_seq``, directed: src's event comes directly before dst's, at least ``least`` times."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.date_trunc("day", "ts").alias("day"))
    nxt = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    e = ev.select(name(F.col("user_id")).alias("src"), name(nxt).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).filter(F.col("weight") >= least)
    return Graph(table(spark, sf_dir, "events").select(name(F.col("user_id")).alias("id")).distinct(), materialize(e, "user-next"), directed=True)


USER_SEQ_SQL = """
nx AS (SELECT user_id AS a, lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS b FROM events),
v AS (SELECT DISTINCT 'u' || user_id AS id FROM events),
e AS (SELECT least('u' || a, 'u' || b) AS src, greatest('u' || a, 'u' || b) AS dst, count(*)::DOUBLE AS weight FROM nx WHERE a <> b GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT src AS v, dst AS u, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""


USER_NEXT_SQL = """
nx AS (SELECT user_id AS a, lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS b FROM events),
v AS (SELECT DISTINCT 'u' || user_id AS id FROM events),
e AS (SELECT 'u' || a AS src, 'u' || b AS dst, count(*)::DOUBLE AS weight FROM nx WHERE a <> b GROUP BY 1, 2 HAVING count(*) >= 2)"""


def next_sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {USER_NEXT_SQL}{',' if more else ''}\n{more}\n{body}"


def user_sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {USER_SEQ_SQL}{',' if more else ''}\n{more}\n{body}"


def rounded(c: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)
