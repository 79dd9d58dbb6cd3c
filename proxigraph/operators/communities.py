"""Louvain communities: local moves in rounds of joins, contraction, level by level.

In a round every node looks for the community around it whose gain in modularity is greatest. Many
moves at once may spoil each other, so a round first tries those of half of the nodes (which half
changes with the round); if modularity does not rise by that, it makes only moves of which each is the
best of both communities it touches: no community takes part in two of them, so their gains add up. Modularity
never falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.plans.graph import Graph, co_part, rounded, sql, user_seq
from proxigraph.plans.shared import drop, materialize

LEAST = 1e-9  # gain, in units of a node's degree, below which no node moves


def _gains(nodes: DataFrame, links: DataFrame, m2: float, resolution: float) -> DataFrame:
    """(v, c, to, gain): for each node the best other community around it, of equals the least, if there is a
    gain. ``gain`` is the rise of modularity times m2 squared over 2."""
    total = nodes.groupBy("c").agg(F.sum("degree").alias("total"))
    own = nodes.join(total, "c").select(F.col("id").alias("v"), "c", "degree", (F.col("total") - F.col("degree")).alias("rest"))
    around = links.join(nodes.select(F.col("id").alias("u"), F.col("c").alias("to")), "u").groupBy("v", "to").agg(F.sum("w").alias("k"))
    seen = around.join(own, "v")
    inner = seen.filter("to = c").select("v", F.col("k").alias("k0"))
    other = seen.filter("to <> c").join(inner, "v", "left").join(total.select(F.col("c").alias("to"), F.col("total").alias("to_total")), "to")
    gain = (F.col("k") - F.coalesce("k0", F.lit(0.0))) * m2 - resolution * F.col("degree") * (F.col("to_total") - F.col("rest"))
    fine = other.withColumn("gain", gain).filter(F.col("gain") > LEAST * m2 * F.col("degree"))
    best = fine.groupBy("v", "c").agg(F.min(F.struct((-F.col("gain")).alias("x"), "to")).alias("b"))
    return best.select("v", "c", F.col("b.to").alias("to"), (-F.col("b.x")).alias("gain"))


def _apart(moves: DataFrame) -> DataFrame:
    """Those moves that are the best, by gain and then node, of both communities they touch."""
    rank = F.struct((-F.col("gain")).alias("x"), "v")
    best = moves.select(F.explode(F.array("c", "to")).alias("k"), rank.alias("r")).groupBy("k").agg(F.min("r").alias("r")).select("k", F.col("r.v").alias("v"))
    twice = best.groupBy("v").agg(F.count("*").alias("n")).filter("n = 2").select("v")
    return moves.join(twice, "v", "left_semi")


def _moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    to = moves.select(F.col("v").alias("id"), "to")
    return materialize(nodes.join(to, "id", "left").select("id", "degree", "loop", F.coalesce("to", "c").alias("c")), "louvain")


def _quality(nodes: DataFrame, links: DataFrame, m2: float, resolution: float) -> float:
    """Modularity of the communities in ``nodes``, in one job."""
    c = nodes.select("id", "c")
    zero = F.lit(0.0)
    same = links.join(c.toDF("v", "cv"), "v").join(c.toDF("u", "cu"), "u").filter("cv = cu").agg(F.sum("w").alias("x"), zero.alias("y"))
    loops = nodes.agg(F.sum("loop").alias("x"), zero.alias("y"))
    square = nodes.groupBy("c").agg(F.sum("degree").alias("t")).agg(zero.alias("x"), F.sum(F.col("t") * F.col("t")).alias("y"))
    inner, squares = same.unionByName(loops).unionByName(square).agg(F.sum("x"), F.sum("y")).first()
    return (inner or 0.0) / m2 - resolution * (squares or 0.0) / (m2 * m2)


def _start(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): every vertex a community of its own."""
    links = materialize(g.both("weight").filter("v <> u").groupBy("v", "u").agg(F.sum("weight").alias("w")), "louvain-links")
    loop = g.edges.filter("src = dst").groupBy(F.col("src").alias("id")).agg((2 * F.sum("weight")).alias("loop"))
    degree = links.groupBy(F.col("v").alias("id")).agg(F.sum("w").alias("d"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    nodes = g.vertices.distinct().join(degree, "id", "left").join(loop, "id", "left").select("id", (zero("d") + zero("loop")).alias("degree"), zero("loop").alias("loop"), F.col("id").alias("c"))
    return materialize(nodes, "louvain"), links


def _contracted(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of communities: weights between them, inner weight as loops."""
    c = nodes.select("id", "c")
    between = materialize(links.join(c.toDF("v", "cv"), "v").join(c.toDF("u", "cu"), "u").groupBy("cv", "cu").agg(F.sum("w").alias("w")), "louvain-between")
    inner = between.filter("cv = cu").select(F.col("cv").alias("c"), F.col("w").alias("inner"))
    new = nodes.groupBy("c").agg(F.sum("degree").alias("degree"), F.sum("loop").alias("loop")).join(inner, "c", "left")
    new = new.select(F.col("c").alias("id"), "degree", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop"), "c")
    return materialize(new, "louvain"), materialize(between.filter("cv <> cu").toDF("v", "u", "w"), "louvain-links")


def louvain(g: Graph, resolution: float = 1.0, rise: float = 1e-3, rounds: int = 1000) -> DataFrame:
    """(id, level, community, modularity): the community of each vertex at each level, named by its least
    vertex, and the modularity of the level as a whole. The last level is the result.

    Weights are summed over parallel edges and must not be negative; loops count twice; vertices without edges
    are communities of their own. A graph without edges has one level of modularity 0. A level ends with a round
    that raises modularity by less than ``rise``, with 0 when no node has anything to gain; RuntimeError if it
    does not in so many ``rounds``."""
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    spark = g.vertices.sparkSession
    if not g.edges.filter("weight < 0").isEmpty():
        raise ValueError("negative weight")
    nodes, links = _start(g)
    m2 = nodes.agg(F.sum("degree")).first()[0] or 0.0
    members, out, level = materialize(nodes.select("id", F.col("id").alias("c")), "louvain-members"), None, 0
    if m2 == 0:
        return members.select("id", F.lit(0).alias("level"), F.col("c").alias("community"), F.lit(0.0).alias("modularity"))
    q = _quality(nodes, links, m2, resolution)
    while True:
        moved = False
        for r in range(rounds):
            moves = materialize(_gains(nodes, links, m2, resolution), "louvain-moves")
            if moves.isEmpty():
                break
            half = moves.filter(F.xxhash64("v", F.lit(level), F.lit(r)) % 2 == 0)
            for some in (half, _apart(moves)):
                new = _moved(nodes, some)
                better = _quality(new, links, m2, resolution)
                if better > q:
                    break
                drop(new)
            else:  # gains within the rounding of sums
                break
            drop(nodes)
            drop(moves)
            small = better - q < rise
            nodes, q, moved = new, better, True
            if small:
                break
        else:
            raise RuntimeError(f"level {level} did not settle in {rounds} rounds")
        if not moved and level:
            break
        joined = members.join(nodes.select(F.col("id").alias("c"), F.col("c").alias("to")), "c").select("id", F.col("to").alias("c"))
        members = materialize(joined, "louvain-members")
        named = members.groupBy("c").agg(F.min("id").alias("community"))
        part = materialize(members.join(named, "c").select("id", F.lit(level).alias("level"), "community", F.lit(q).alias("modularity")), "louvain-levels")
        out = part if out is None else out.unionByName(part)
        if not moved:
            break
        nodes, links = _contracted(nodes, links)
        level += 1
    return out


def last_level(levels: DataFrame) -> DataFrame:
    top = levels.agg(F.max("level")).first()[0]
    return levels.filter(F.col("level") == (top or 0)).select("id", "community")


def report(g: Graph, members: DataFrame) -> DataFrame:
    """(number, community, size, internal_edges, external_edges, internal_weight, density): communities of
    ``members`` (id, community) by falling size, then name, numbered from 0."""
    from proxigraph.plans.numbering import numbered

    at = lambda end, name: members.select(F.col("id").alias(end), F.col("community").alias(name))
    e = materialize(g.edges.join(at("src", "a"), "src").join(at("dst", "b"), "dst").select("a", "b", "weight"), "community-edges")
    inner = e.filter("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("internal_edges"), F.sum("weight").alias("internal_weight"))
    outer = e.filter("a <> b").select(F.explode(F.array("a", "b")).alias("community")).groupBy("community").agg(F.count("*").alias("external_edges"))
    n = members.groupBy("community").agg(F.count("*").alias("size")).join(inner, "community", "left").join(outer, "community", "left")
    pairs = F.col("size") * (F.col("size") - 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    x = n.select("community", "size", zero("internal_edges"), zero("external_edges"), F.coalesce("internal_weight", F.lit(0.0)).alias("internal_weight"))
    x = x.withColumn("density", F.when(pairs > 0, 2.0 * F.col("internal_edges") / pairs).otherwise(0.0))
    return numbered(x, [F.desc("size"), F.col("community")], "place").withColumn("number", F.col("place") - 1).drop("place")


def moves(g: Graph, rounds: int) -> DataFrame:
    """(id, community) after so many rounds of moves that touch no community twice, from single vertices."""
    nodes, links = _start(g)
    m2 = nodes.agg(F.sum("degree")).first()[0] or 0.0
    for _ in range(rounds):
        nodes = _moved(nodes, _apart(materialize(_gains(nodes, links, m2, 1.0), "louvain-moves")))
    return nodes.select("id", F.col("c").alias("community"))


def _csv(g: Graph) -> DataFrame:
    """(line): node,community_id,community_size, the community's number in ``report``."""
    members = last_level(louvain(g))
    return members.join(report(g, members), "community").select(F.concat_ws(",", "id", F.col("number").cast("string"), F.col("size").cast("string")).alias("line"))


def _moves_sql(k: int) -> str:
    """Unrolled rounds of ``moves``."""
    out = ["mm AS MATERIALIZED (SELECT sum(weight) AS m2 FROM s)", "n0 AS MATERIALIZED (SELECT v.id, coalesce(sum(weight), 0) AS degree, v.id AS c FROM v LEFT JOIN s ON s.v = v.id GROUP BY v.id)"]
    for i in range(k):
        out += [
            f"t{i} AS MATERIALIZED (SELECT c, sum(degree) AS total FROM n{i} GROUP BY c)",
            f"a{i} AS MATERIALIZED (SELECT s.v, n.c AS t, sum(weight) AS k FROM s JOIN n{i} n ON n.id = s.u GROUP BY 1, 2)",
            f"g{i} AS MATERIALIZED (SELECT a.v, n.c, a.t, (a.k - coalesce(o.k, 0)) * m2 - n.degree * (y.total - (x.total - n.degree)) AS gain, n.degree * m2 * 1e-9 AS least FROM a{i} a JOIN n{i} n ON n.id = a.v AND n.c <> a.t JOIN t{i} x ON x.c = n.c JOIN t{i} y ON y.c = a.t LEFT JOIN a{i} o ON o.v = a.v AND o.t = n.c, mm)",
            f"b{i} AS MATERIALIZED (SELECT v, c, t, gain FROM g{i} WHERE gain > least QUALIFY row_number() OVER (PARTITION BY v ORDER BY gain DESC, t) = 1)",
            f"w{i} AS MATERIALIZED (SELECT v FROM (SELECT k, arg_min(v, (-gain, v)) AS v FROM (SELECT c AS k, v, gain FROM b{i} UNION ALL SELECT t, v, gain FROM b{i}) GROUP BY k) GROUP BY v HAVING count(*) = 2)",
            f"n{i + 1} AS MATERIALIZED (SELECT n.id, n.degree, coalesce(b.t, n.c) AS c FROM n{i} n LEFT JOIN (SELECT * FROM b{i} JOIN w{i} USING (v)) b ON b.v = n.id)",
        ]
    return ", ".join(out)


QUERIES = {
    "louvain": lambda s, d: louvain(user_seq(s, d)).select("id", "level", "community", rounded("modularity", "modularity")),
    "louvain_csv": lambda s, d: _csv(user_seq(s, d)),
    "louvain_moves": lambda s, d: moves(co_part(s, d), 3),
}
SQL = {"louvain_moves": sql("SELECT id, c AS community FROM n3", _moves_sql(3))}  # whole levels: tests/test_communities.py
