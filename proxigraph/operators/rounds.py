"""Greedy structures by rounds of joins, and biconnected components from a breadth-first forest.

A greedy pass over vertices in a fixed order gives the same result in rounds in which every vertex
that is first among its undecided neighbours is decided; no task ever sees more than one edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxigraph.operators.iterative import connected, levels
from proxigraph.plans.components import components
from proxigraph.plans.graph import Graph, user_seq, user_sql
from proxigraph.plans.shared import drop, materialize


def independent_set(g: Graph, order: DataFrame | None = None) -> DataFrame:
    """(id): the greedy maximal independent set in order of degree, then id; isolated vertices are in it.
    ``order`` (id, degree) gives other numbers than the degrees to go by."""
    d = materialize(g.degrees() if order is None else g.vertices.select("id").join(order, "id").select("id", "degree"), "mis-degrees")
    s = materialize(g.both(), "mis-links")
    open_, taken = materialize(d.withColumn("k", F.struct("degree", "id")).select("id", "k"), "mis-open"), []
    while not open_.isEmpty():
        near = s.join(open_.select(F.col("id").alias("u"), F.col("k").alias("uk")), "u").groupBy(F.col("v").alias("id")).agg(F.min("uk").alias("first"))
        new = materialize(open_.join(near, "id", "left").filter(F.col("first").isNull() | (F.col("k") < F.col("first"))).select("id"), "mis")
        taken.append(new)
        gone = new.unionByName(s.join(new.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("id"))).distinct()
        rest = materialize(open_.join(gone, "id", "left_anti"), "mis-open")
        drop(open_)
        open_ = rest
    return reduce(DataFrame.unionByName, taken, g.vertices.select("id").limit(0))


def colouring(g: Graph) -> DataFrame:
    """(id, colour): greedy colours from 0, vertices of high degree first, then by id: each takes the
    least colour that no neighbour before it has."""
    d = materialize(g.degrees().select("id", F.struct((-F.col("degree")).alias("d"), "id").alias("k")), "colour-order")
    s = g.both().join(d.select(F.col("id").alias("v"), F.col("k").alias("vk")), "v").join(d.select(F.col("id").alias("u"), F.col("k").alias("uk")), "u")
    s = materialize(s.filter(F.col("uk") < F.col("vk")).select("v", "u"), "colour-links")  # a vertex and those before it
    done, open_ = None, materialize(d.select("id"), "colour-open")
    while not open_.isEmpty():
        wait = s.join(open_.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        now = materialize(open_.join(wait, "id", "left_anti"), "colour-now")
        if done is None:
            new = now.select("id", F.lit(0).alias("colour"))
        else:
            seen = s.join(now.select(F.col("id").alias("v")), "v").join(done.select(F.col("id").alias("u"), "colour"), "u").select("v", "colour").distinct()
            place = F.row_number().over(Window.partitionBy("v").orderBy("colour")) - 1
            full = seen.withColumn("i", place).groupBy("v").agg(F.coalesce(F.min(F.when(F.col("colour") != F.col("i"), F.col("i"))), F.count("*")).cast("int").alias("colour"))
            new = now.join(full.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("colour", F.lit(0)).alias("colour"))
        done = materialize(new if done is None else done.unionByName(new), "coloured")
        rest = materialize(open_.join(now, "id", "left_anti"), "colour-open")
        drop(open_)
        open_ = rest
    return done if done is not None else g.vertices.select("id", F.lit(0).alias("colour")).limit(0)


def maximal_matching(g: Graph) -> DataFrame:
    """(src, dst): the greedy maximal matching in order of falling weight, then ends. The ends are a
    vertex cover at most twice as large as the least."""
    e = materialize(g.edges.select("src", "dst", F.struct((-F.col("weight")).alias("w"), "src", "dst").alias("k")), "match-edges")
    out = []
    while not e.isEmpty():
        best = e.select(F.explode(F.array("src", "dst")).alias("v"), "k").groupBy("v").agg(F.min("k").alias("b"))
        of = lambda c: best.select(F.col("v").alias(c), F.col("b").alias(f"{c}_b"))
        new = materialize(e.join(of("src"), "src").join(of("dst"), "dst").filter((F.col("k") == F.col("src_b")) & (F.col("k") == F.col("dst_b"))).select("src", "dst"), "matched")
        out.append(new)
        gone = new.select(F.explode(F.array("src", "dst")).alias("v"))
        rest = materialize(e.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst", "k"), "match-edges")
        drop(e)
        e = rest
    return reduce(DataFrame.unionByName, out, g.edges.select("src", "dst").limit(0))


def vertex_cover(g: Graph) -> DataFrame:
    return maximal_matching(g).select(F.explode(F.array("src", "dst")).alias("id"))


def dominating_set(g: Graph) -> DataFrame:
    """A maximal independent set dominates all other vertices."""
    return independent_set(g)


def blocks(g: Graph) -> DataFrame:
    """(id, parent, block): the biconnected component of each forest edge id - parent.

    Vertices are numbered in preorder of a breadth-first forest; a subtree is a range of numbers.
    Edges off the forest join vertices of which neither is above the other, so they tie the forest
    edges at both ends, and an edge is tied to its parent edge if something below it has an edge
    that leaves the parent's subtree. Tied edges are the components of that relation.
    """
    root = materialize(connected(g), "block-roots")
    found = levels(g, root.select(F.col("component").alias("id"), F.col("component").alias("source")).distinct()).select("id", "hops")
    near = g.both().join(found.select(F.col("id").alias("v"), (F.col("hops") + 1).alias("hops")), "v").select(F.col("u").alias("id"), "hops", "v")
    tree = materialize(found.join(near, ["id", "hops"], "left").groupBy("id", "hops").agg(F.min("v").alias("parent")), "block-tree")
    depth = tree.agg(F.max("hops")).first()[0] or 0

    def climb(values: DataFrame, folds: dict) -> DataFrame:
        """Columns gathered from the leaves to the roots, a level a round; a fold is an aggregate and
        how its result joins a vertex's own value."""
        now = materialize(tree.join(values, "id", "left").select("id", "hops", "parent", *folds), "block-up")
        for h in range(depth, 0, -1):
            up = now.filter(F.col("hops") == h).groupBy(F.col("parent").alias("id")).agg(*[total(c).alias(f"more_{c}") for c, (total, _) in folds.items()])
            own = [F.when(F.col("hops") == h - 1, pair(F.col(c), F.col(f"more_{c}"))).otherwise(F.col(c)).alias(c) for c, (_, pair) in folds.items()]
            nxt = materialize(now.join(up, "id", "left").select("id", "hops", "parent", *own), "block-up")
            drop(now)
            now = nxt
        return now.select("id", *folds)

    size = climb(tree.select("id", F.lit(1).cast("long").alias("size")), {"size": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))})
    sized = materialize(tree.join(size, "id"), "block-sizes")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = materialize(sized.filter("parent is not null").withColumn("step", before + 1).select("id", "hops", "parent", "size", "step"), "block-steps")
    pre = materialize(sized.filter("parent is null").select("id", "size", F.lit(0).cast("long").alias("pre")), "block-pre")
    layer, done = pre, [pre]
    for h in range(1, depth + 1):
        layer = materialize(step.filter(F.col("hops") == h).join(layer.select(F.col("id").alias("parent"), F.col("pre").alias("p")), "parent").select("id", "size", (F.col("p") + F.col("step")).alias("pre")), "block-pre")
        done.append(layer)
    num = materialize(reduce(DataFrame.unionByName, done), "block-numbers")
    stem = step.select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
    off = materialize(g.edges.select("src", "dst").join(stem, ["src", "dst"], "left_anti"), "block-off")
    reach = Graph(g.vertices, off).both().join(num.select(F.col("id").alias("u"), "pre"), "u").groupBy(F.col("v").alias("id")).agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"))
    own = num.join(reach, "id", "left").select("id", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi"))
    ends = climb(own, {"lo": (F.min, F.least), "hi": (F.max, F.greatest)})
    at = step.select("id", "parent").join(ends, "id").join(num.select(F.col("id").alias("parent"), F.col("pre").alias("pp"), F.col("size").alias("ps")), "parent")
    # roots have no edge above them: only parents that have one are tied
    tied = at.filter((F.col("lo") < F.col("pp")) | (F.col("hi") >= F.col("pp") + F.col("ps"))).select(F.col("id").alias("src"), F.col("parent").alias("dst")).join(step.select(F.col("id").alias("dst")), "dst", "left_semi")
    c = components(off.unionByName(tied.select("src", "dst")))
    return step.select("id", "parent").join(c, "id", "left").select("id", "parent", F.coalesce("component", "id").alias("block"))


def _cut_vertices(b: DataFrame) -> DataFrame:
    each = b.select("id", "block").unionByName(b.select(F.col("parent").alias("id"), "block"))
    return each.groupBy("id").agg(F.count_distinct("block").alias("n")).filter("n > 1").select("id")


def articulation_points(g: Graph) -> DataFrame:
    """(id): vertices whose loss parts their component: their forest edges lie in several blocks."""
    return _cut_vertices(materialize(blocks(g), "blocks"))


def bridges_articulation(g: Graph) -> DataFrame:
    """(kind, a, b): bridges, the blocks of one forest edge that nothing is tied to, by their ends;
    articulation points with b null."""
    b = materialize(blocks(g), "blocks")
    lone = b.groupBy("block").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("parent").alias("parent")).filter("n = 1")
    cut = _cut_vertices(b).select(F.lit("articulation").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    return lone.select(F.lit("bridge").alias("kind"), F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b")).unionByName(cut)


_four = lambda q: q.replace("count(*) >= 2", "count(*) >= 4")
_CUTS = "cut(a, b, id) AS (SELECT src, dst, src FROM e UNION SELECT cut.a, cut.b, s.u FROM cut JOIN s ON s.v = cut.id AND NOT (s.v = cut.a AND s.u = cut.b) AND NOT (s.v = cut.b AND s.u = cut.a)), off(x, id) AS (SELECT v, min(u) FROM s GROUP BY v UNION SELECT off.x, s.u FROM off JOIN s ON s.v = off.id AND s.u <> off.x)"
QUERIES = {
    "bridges_articulation": lambda s, d: bridges_articulation(user_seq(s, d, 4)),
    "independent_set": lambda s, d: independent_set(user_seq(s, d)),
    "dominating_set": lambda s, d: dominating_set(user_seq(s, d)),
    "vertex_cover": lambda s, d: vertex_cover(user_seq(s, d)),
    "colouring": lambda s, d: colouring(user_seq(s, d, 4)),
}
SQL = {
    "bridges_articulation": _four(user_sql("SELECT 'bridge' AS kind, src AS a, dst AS b FROM e WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.a = e.src AND cut.b = e.dst AND cut.id = e.dst) UNION ALL SELECT DISTINCT 'articulation', s.v, NULL FROM s WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.x = s.v AND off.id = s.u)", _CUTS)),
}
