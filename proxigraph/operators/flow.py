"""Maximum flow and minimum cut by preflows, maximum matching of bipartite graphs and their least cover.

Flow: residual arcs and excesses are tables. Heights are distances to the sink over arcs with capacity left,
found breadth first; then all vertices with an excess push at once along arcs that lead one level down, until
none can; then heights are taken anew. Vertices that no longer reach the sink keep their excess.

Matching: alternating trees grow from all free vertices of one side at once, level by level, every
vertex in one tree only; each tree that meets a free vertex of the other side gives a path, and as trees share
no vertex all of these are flipped together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.operators.iterative import two_colours
from proxigraph.plans.graph import Graph, user_seq
from proxigraph.plans.session import table
from proxigraph.plans.shared import drop, materialize


def _arcs(g: Graph, turned: bool) -> DataFrame:
    """(v, u, r): capacity left from v to u, both ways for every pair with an edge; loops are left out."""
    e = g.edges.filter("src <> dst").select(F.col("src").alias("v"), F.col("dst").alias("u"), F.col("weight").alias("r"))
    back = e.select(F.col("u").alias("v"), F.col("v").alias("u"), (F.lit(0.0) if g.directed else F.col("r")).alias("r"))
    both = e.unionByName(back)
    if turned:
        both = both.select(F.col("u").alias("v"), F.col("v").alias("u"), "r")
    return both.groupBy("v", "u").agg(F.sum("r").alias("r"))


def _heights(arcs: DataFrame, source: str, sink: str) -> DataFrame:
    """(id, h): arcs with capacity left from a vertex to the sink; those that do not reach it are not listed."""
    spark = arcs.sparkSession
    open_ = materialize(arcs.filter("r > 0").select("v", "u"), "flow-open")
    now = materialize(spark.createDataFrame([(sink, 0)], "id string, h int"), "flow-heights")
    parts, seen = [now], now.select("id")
    while True:
        near = open_.join(now.select(F.col("id").alias("u")), "u").filter(F.col("v") != source).select(F.col("v").alias("id")).distinct()
        now = materialize(near.join(seen, "id", "left_anti").withColumn("h", F.lit(len(parts))), "flow-heights")
        if now.isEmpty():
            return materialize(reduce(DataFrame.unionByName, parts), "flow-heights")
        parts.append(now)
        seen = seen.unionByName(now.select("id"))


def _preflow(arcs: DataFrame, source: str, sink: str, rounds: int) -> tuple[float, DataFrame]:
    """(value, (id)): the greatest flow, and the vertices that can still reach the sink."""
    first = arcs.filter((F.col("v") == source) & (F.col("r") > 0)).select("v", "u", F.col("r").alias("x"))
    arcs, excess = _pushed(arcs, arcs.sparkSession.createDataFrame([], "id string, e double"), materialize(first, "flow-pushes"))
    for _ in range(rounds):
        heights = _heights(arcs, source, sink)
        active = excess.filter((F.col("e") > 0) & (F.col("id") != sink)).join(heights.select("id"), "id", "left_semi")
        if active.isEmpty():
            value = excess.filter(F.col("id") == sink).select("e").first()
            return (value[0] if value else 0.0), heights.select("id")
        down = heights.select(F.col("id").alias("v"), F.col("h").alias("hv"))
        level = heights.select(F.col("id").alias("u"), F.col("h").alias("hu"))
        while True:
            full = excess.filter((F.col("e") > 0) & (F.col("id") != sink)).select(F.col("id").alias("v"), "e")
            way = arcs.filter("r > 0").join(full, "v").join(down, "v").join(level, "u").filter("hv = hu + 1")
            before = F.coalesce(F.sum("r").over(Window.partitionBy("v").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            push = materialize(way.withColumn("x", F.least(F.col("r"), F.col("e") - before)).filter("x > 0").select("v", "u", "x"), "flow-pushes")
            if push.isEmpty():
                break
            old = arcs, excess
            arcs, excess = _pushed(arcs, excess, push)
            for x in old:
                drop(x)
    raise RuntimeError(f"the flow did not settle in {rounds} rounds of heights")


def _pushed(arcs: DataFrame, excess: DataFrame, push: DataFrame) -> tuple[DataFrame, DataFrame]:
    less = push.select("v", "u", (-F.col("x")).alias("r"))
    more = push.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("x").alias("r"))
    new = materialize(arcs.unionByName(less).unionByName(more).groupBy("v", "u").agg(F.sum("r").alias("r")), "flow-arcs")
    e = excess.unionByName(push.select(F.col("v").alias("id"), (-F.col("x")).alias("e"))).unionByName(push.select(F.col("u").alias("id"), F.col("x").alias("e")))
    return new, materialize(e.groupBy("id").agg(F.sum("e").alias("e")), "flow-excess")


def flow(g: Graph, source: str, sink: str, rounds: int = 10_000) -> tuple[float, DataFrame]:
    """(value, (src, dst, weight)): the maximum flow from ``source`` to ``sink``, capacities being weights, and the
    edges of the minimum cut next to the source.

    An undirected edge carries its weight either way; parallel edges add up. An unknown end, or ends that are not
    connected, give 0 and no edges. Equal ends and negative weights are errors. The preflow goes from the sink to
    the source over reversed arcs, so what still reaches the source is its side of the cut."""
    if source == sink:
        raise ValueError("source and sink are the same")
    if not g.edges.filter("weight < 0 OR weight IS NULL OR isnan(weight)").isEmpty():
        raise ValueError("capacities have to be numbers of 0 or more")
    value, side = _preflow(materialize(_arcs(g, True), "flow-arcs"), sink, source, rounds)
    a, b = side.select(F.col("id").alias("src"), F.lit(True).alias("a")), side.select(F.col("id").alias("dst"), F.lit(True).alias("b"))
    e = g.edges.filter("src <> dst").select("src", "dst", "weight").join(a, "src", "left").join(b, "dst", "left")
    crosses = F.col("a").isNotNull() & F.col("b").isNull()
    if not g.directed:
        crosses = crosses | (F.col("a").isNull() & F.col("b").isNotNull())
    return float(value), e.filter(crosses).select("src", "dst", "weight")


def max_flow(g: Graph, source: str, sink: str) -> DataFrame:
    """One row (source, sink, flow, cut, cut_edges): ``cut`` is the capacity of the minimum cut, summed from its edges."""
    value, cut = flow(g, source, sink)
    one = cut.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("cut"), F.count("*").alias("cut_edges"))
    return one.select(F.lit(source).alias("source"), F.lit(sink).alias("sink"), F.lit(value).alias("flow"), "cut", "cut_edges")


def _sides(g: Graph) -> DataFrame:
    """(id, left) of a bipartite graph: vertices at an even distance from the least of their component are left."""
    from proxigraph.operators.iterative import connected, levels

    if not two_colours(g).filter("NOT bipartite").isEmpty():
        raise ValueError("the graph is not bipartite")
    roots = connected(g).select(F.col("component").alias("id"), F.col("component").alias("source")).distinct()
    return levels(g, roots).select("id", (F.col("hops") % 2 == 0).alias("left"))


def matching(g: Graph, sides: DataFrame | None = None, phases: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """((l, r), (id)): a maximum matching of a bipartite graph, and a least vertex cover, as many vertices as
    there are pairs. ``sides`` (id, left) tells the sides; without it they are found, and a graph with an odd cycle is
    an error."""
    spark = g.vertices.sparkSession
    sides = materialize(_sides(g) if sides is None else sides.select("id", "left"), "matching-sides")
    left = sides.filter("left").select(F.col("id").alias("l"))
    links = materialize(g.both().join(left.withColumnRenamed("l", "v"), "v", "left_semi").select(F.col("v").alias("l"), F.col("u").alias("r")).distinct(), "matching-links")
    match = materialize(spark.createDataFrame([], "l string, r string"), "matching")
    for _ in range(phases):
        now = materialize(left.join(match, "l", "left_anti").select("l", F.col("l").alias("root")), "matching-front")
        fronts, reached = [now.select("l")], []
        while True:
            new = links.join(now, "l")
            for old in reached:
                new = new.join(old.select("r"), "r", "left_anti")
            new = materialize(new.groupBy("r").agg(F.min(F.struct("root", "l")).alias("x")).select("r", "x.l", "x.root"), "matching-reached")
            if new.isEmpty():
                z = reduce(DataFrame.unionByName, fronts)
                right = reduce(DataFrame.unionByName, [x.select("r") for x in reached], match.select("r").limit(0))
                cover = match.join(z, "l", "left_anti").select(F.col("l").alias("id")).unionByName(right.select(F.col("r").alias("id")))
                return match, materialize(cover, "cover")
            reached.append(new)
            ends = materialize(new.join(match, "r", "left_anti").groupBy("root").agg(F.min("r").alias("r")), "matching-ends")
            if not ends.isEmpty():
                break
            now = materialize(new.select("r", "root").join(match, "r").select("l", "root"), "matching-front")
            fronts.append(now.select("l"))
            if len(reached) > 24:  # a plan of a few scans
                reached = [materialize(reduce(DataFrame.unionByName, reached), "matching-reached")]
                fronts = [materialize(reduce(DataFrame.unionByName, fronts), "matching-front")]
        tree, at, flips = reduce(DataFrame.unionByName, reached).select("r", "l"), ends.select("r"), []
        while not at.isEmpty():
            step = materialize(tree.join(at, "r").select("l", "r"), "matching-flips")
            flips.append(step)
            at = materialize(match.join(step.select("l"), "l").select("r"), "matching-at")
        flipped = reduce(DataFrame.unionByName, flips)
        match = materialize(match.join(flipped.select("l"), "l", "left_anti").unionByName(flipped), "matching")
    raise RuntimeError(f"the matching did not settle in {phases} phases")


def buyers(spark: SparkSession, sf_dir: str, least: int = 2) -> tuple[Graph, DataFrame]:
    """Customers and parts that they ordered at least ``least`` times: a bipartite graph and its sides."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    pair = lines.join(orders, "l_orderkey").groupBy("o_custkey", "l_partkey").agg(F.count("*").cast("double").alias("weight")).filter(F.col("weight") >= least)
    e = materialize(pair.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "weight"), "buyers")
    sides = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("left")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("left")))).alias("x")).select("x.*").distinct()
    return Graph(sides.select("id"), e), sides


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, part) pairs of a maximum matching."""
    g, sides = buyers(spark, sf_dir)
    return matching(g, sides)[0].select(F.col("l").alias("customer"), F.col("r").alias("part"))


def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, sides = buyers(spark, sf_dir)
    return matching(g, sides)[1]


QUERIES = {
    "max_flow": lambda s, d: max_flow(user_seq(s, d), "u1", "u9"),
    "min_cut": lambda s, d: flow(user_seq(s, d), "u1", "u9")[1],
    "maximum_matching": _matched,
    "koenig_cover": _cover,
}
SQL: dict[str, str] = {}  # brute force over cuts and matchings in tests/test_flow.py
