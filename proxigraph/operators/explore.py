"""Simple paths, the k shortest of them, and patterns.

Paths are rows with the vertices they have visited; a round extends all of them by an edge. Distances to the
target tell which can still be within the bound, so others are never made.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.operators.iterative import levels
from proxigraph.operators.paths import weighted_distances
from proxigraph.plans.graph import Graph, co_part, sql, user_seq, user_sql
from proxigraph.plans.shared import materialize


def _steps(g: Graph) -> DataFrame:
    """(v, u, weight): the lightest edge of each pair, from both ends."""
    return materialize(g.both("weight").filter("v <> u").groupBy("v", "u").agg(F.min("weight").alias("weight")), "path-steps")


def _extended(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """Paths (at, path, weight) with one more vertex, none twice."""
    more = paths.join(steps.select(F.col("v").alias("at"), "u", F.col("weight").alias("w")), "at").filter(~F.array_contains("path", F.col("u")))
    return more.select(F.col("u").alias("at"), F.concat("path", F.array("u")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"))


def _start(g: Graph, source: str) -> DataFrame:
    return g.vertices.filter(F.col("id") == source).distinct().select(F.col("id").alias("at"), F.array("id").alias("path"), F.lit(0.0).alias("weight"))


def simple_paths(g: Graph, source: str, target: str, depth: int = 20, most: int | None = None) -> DataFrame:
    """(path, hops, weight, cut): all simple paths of at most ``depth`` edges between two vertices.

    With ``most``, the first so many by weight, hops and vertices, and ``cut`` says whether there are more.
    Their number can grow exponentially with the depth. Equal ends, or an unknown one, give no rows; of parallel
    edges the lightest counts."""
    steps = _steps(g)
    far = materialize(levels(g, g.vertices.filter(F.col("id") == target).select("id", F.col("id").alias("source")), most=depth).select(F.col("id").alias("at"), "hops"), "path-far")
    now, found = _start(g, source if source != target else ""), []
    for d in range(1, depth + 1):
        near = far.filter(F.col("hops") <= depth - d).select("at")
        now = materialize(_extended(now, steps).join(near, "at", "left_semi"), "paths")
        if now.isEmpty():
            break
        found.append(now.filter(F.col("at") == target))
        now = now.filter(F.col("at") != target)
    none = g.vertices.sparkSession.createDataFrame([], "at string, path array<string>, weight double")
    out = reduce(DataFrame.unionByName, found, none).select("path", (F.size("path") - 1).alias("hops"), "weight")
    if most is None:
        return out.withColumn("cut", F.lit(False))
    out = materialize(out, "paths")
    return out.orderBy("weight", "hops", "path").limit(most).withColumn("cut", F.lit(out.count() > most))


def k_shortest(g: Graph, source: str, target: str, k: int, rounds: int = 10_000) -> DataFrame:
    """(place, path, hops, weight): the ``k`` simple paths of least weight, of equals those with fewer edges and
    then lesser vertices; fewer where there are not so many.

    A path waits while its weight and the distance left exceed the bound; when those within it have all come
    to an end and are fewer than k, the bound rises to the weight that as many waiting paths may reach. Equal
    ends, an unknown one and ends that are not connected give no rows; negative weights are an error."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = g.vertices.sparkSession
    left = materialize(weighted_distances(g, target).select(F.col("id").alias("at"), F.col("total").alias("rest")), "path-rest")
    steps, empty = _steps(g), spark.createDataFrame([], "at string, path array<string>, weight double, least double")
    sized = lambda paths: paths.join(left, "at").withColumn("least", F.col("weight") + F.col("rest")).drop("rest")
    waiting, done, have = materialize(sized(_start(g, source if source != target else "")), "paths-waiting"), empty, 0
    for _ in range(rounds):
        bound = waiting.select("least").orderBy("least").limit(k - have).agg(F.max("least")).first()[0] if have < k else None
        if bound is None:
            first = done.select("path", (F.size("path") - 1).alias("hops"), "weight").orderBy("weight", "hops", "path").limit(k).collect()  # k rows
            return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(first)], "place int, path array<string>, hops int, weight double")
        slack = 1e-9 * max(1.0, abs(bound))
        now, wait = waiting.filter(F.col("least") <= bound + slack), [waiting.filter(F.col("least") > bound + slack)]
        while True:
            new = materialize(sized(_extended(now, steps)), "paths")
            if new.isEmpty():
                break
            done = done.unionByName(new.filter((F.col("at") == target) & (F.col("least") <= bound + slack)))
            wait.append(new.filter(F.col("least") > bound + slack))
            now = new.filter((F.col("at") != target) & (F.col("least") <= bound + slack))
        waiting, done = materialize(reduce(DataFrame.unionByName, wait), "paths-waiting"), materialize(done, "paths-done")
        # A waiting path that has reached the target stands for itself only.
        have = done.count()
        ended = waiting.filter(F.col("at") == target)
        if have < k and not ended.isEmpty():
            low = waiting.filter(F.col("at") != target).agg(F.min("least")).first()[0]
            ready = ended if low is None else ended.filter(F.col("least") <= low)
            done = materialize(done.unionByName(ready), "paths-done")
            waiting = materialize(waiting.filter(F.col("at") != target).unionByName(ended.join(ready.select("path"), "path", "left_anti").select(*waiting.columns)), "paths-waiting")
            have = done.count()
    raise RuntimeError(f"the paths did not settle in {rounds} rounds")


@dataclass(frozen=True)
class Pattern:
    """A small connected graph without loops: ``edges`` are (a, b) or (a, b, type) by names of its vertices."""

    edges: tuple[tuple[str, ...], ...]

    def links(self) -> dict[frozenset, str | None]:
        return {frozenset(e[:2]): e[2] if len(e) > 2 else None for e in self.edges}

    def order(self) -> list[str]:
        """Vertices so that each is next to one before it: of those, the one with most links back, then of highest degree."""
        names = sorted({x for e in self.edges for x in e[:2]})
        links = self.links()
        near = {v: {u for u in names if frozenset((u, v)) in links} for v in names}
        out = [max(names, key=lambda v: (len(near[v]), [-ord(c) for c in v]))]
        while len(out) < len(names):
            rest = [v for v in names if v not in out and near[v] & set(out)]
            if not rest:
                raise ValueError("the pattern is not connected")
            out.append(max(rest, key=lambda v: (len(near[v] & set(out)), len(near[v]))))
        return out

    def before(self) -> list[tuple[str, str]]:
        """(a, b): a's vertex has to come before b's, so that each occurrence is found once (of its images
        under the pattern's symmetries, one)."""
        names, links = self.order(), self.links()
        same = [dict(zip(names, p, strict=True)) for p in itertools.permutations(names)]
        same = [m for m in same if {frozenset(m[x] for x in k): t for k, t in links.items()} == links]
        out = []
        while len(same) > 1:
            orbit = {v: {m[v] for m in same} for v in names}
            v = max(names, key=lambda x: len(orbit[x]))
            out += [(v, u) for u in sorted(orbit[v] - {v})]
            same = [m for m in same if m[v] == v]
        return out


TRIANGLE = Pattern((("a", "b"), ("b", "c"), ("a", "c")))
SQUARE = Pattern((("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")))
DIAMOND = Pattern((("a", "b"), ("b", "c"), ("a", "c"), ("b", "d"), ("c", "d")))
CLIQUE = Pattern((("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")))


def occurrences(g: Graph, pattern: Pattern) -> DataFrame:
    """A column for each vertex of the pattern, a row for each occurrence: different vertices, an edge (of the
    type, if told) for each of the pattern's, others allowed. Joins go vertex by vertex; of symmetric vertices the one
    of lower degree, then lesser id, comes first, and vertices of too low a degree are left out."""
    need = {v: sum(v in k for k in pattern.links()) for v in pattern.order()}
    both = materialize(g.both("type").filter("v <> u").distinct(), "pattern-links")
    degree = both.select("v", "u").distinct().groupBy("v").agg(F.count("*").alias("d"))
    links = both.join(degree, "v").join(degree.select(F.col("v").alias("u"), F.col("d").alias("e")), "u")
    links = materialize(links.select("v", "u", "type", F.struct(F.col("d").alias("k"), F.col("v").alias("i")).alias("kv"), F.struct(F.col("e").alias("k"), F.col("u").alias("i")).alias("ku")), "pattern-links")

    def of(kind: str | None, a: str, b: str) -> DataFrame:
        x = links if kind is None else links.filter(F.col("type") == kind)
        x = x.filter((F.col("kv.k") >= need[a]) & (F.col("ku.k") >= need[b]))
        return x.select(F.col("v").alias(a), F.col("u").alias(b), F.col("kv").alias(f"k_{a}"), F.col("ku").alias(f"k_{b}")).distinct()

    order, known, before = pattern.order(), pattern.links(), pattern.before()
    out, placed = None, order[:1]
    for v in order[1:]:
        back = [u for u in placed if frozenset((u, v)) in known]
        step = of(known[frozenset((back[0], v))], back[0], v)
        out = step if out is None else out.join(step.drop(f"k_{back[0]}"), back[0])
        for u in [u for u in placed if u not in back]:
            out = out.filter(F.col(u) != F.col(v))
        placed = [*placed, v]
        for a, b in before:
            if a in placed and b in placed and v in (a, b):
                out = out.filter(F.col(f"k_{a}") < F.col(f"k_{b}"))
        for u in back[1:]:
            out = out.join(of(known[frozenset((u, v))], u, v).select(u, v), [u, v], "left_semi").filter(F.col(u) != F.col(v))
    return out.select(*sorted(order))


def matches(g: Graph, pattern: Pattern) -> DataFrame:
    """(nodes, occurrences): every set of vertices in which the pattern occurs, and how often."""
    found = occurrences(g, pattern)
    return found.groupBy(F.array_sort(F.array(*found.columns)).alias("nodes")).agg(F.count("*").alias("occurrences"))


def _rows(df: DataFrame) -> DataFrame:
    return df.withColumn("nodes", F.array_join("nodes", ","))


def _matches_sql(pattern: Pattern, over=sql) -> str:
    """All mappings by a join of the edges, over the number of the pattern's symmetries."""
    names, links = sorted({x for e in pattern.edges for x in e[:2]}), pattern.links()
    same = sum({frozenset(dict(zip(names, p, strict=True))[x] for x in k): t for k, t in links.items()} == links for p in itertools.permutations(names))
    joins, seen = [], {}
    for i, e in enumerate(pattern.edges):
        on = [f"s{i}.v = {seen[e[0]]}"] if e[0] in seen else []
        on += [f"s{i}.u = {seen[e[1]]}"] if e[1] in seen else []
        on += [f"s{i}.type = '{e[2]}'"] if len(e) > 2 else []
        seen.setdefault(e[0], f"s{i}.v")
        seen.setdefault(e[1], f"s{i}.u")
        joins.append(f"s s{i}" if not i else f"JOIN s s{i} ON {' AND '.join(on)}")
    first = f"s0.type = '{pattern.edges[0][2]}' AND " if len(pattern.edges[0]) > 2 else ""
    apart = " AND ".join(f"{seen[a]} <> {seen[b]}" for a, b in itertools.combinations(names, 2))
    return over(f"SELECT array_to_string(list_sort([{', '.join(seen[x] for x in names)}]), ',') AS nodes, count(*) // {same} AS occurrences FROM {' '.join(joins)} WHERE {first}{apart} GROUP BY 1")


TYPED = Pattern((("a", "b", "f"), ("b", "c", "c"), ("c", "d", "s")))
_ALL = "sp(tip, path, weight) AS (SELECT 'u1', ['u1'], 0.0::DOUBLE UNION ALL SELECT s.u, list_append(path, s.u), sp.weight + s.weight FROM sp JOIN s ON s.v = sp.tip WHERE sp.tip <> 'u9' AND NOT list_contains(path, s.u) AND len(path) <= {d} AND sp.weight + s.weight <= {w})"

#: The fifth weight among paths of one or two edges: no longer path is among the first five.
_NEAR = "near AS MATERIALIZED (SELECT coalesce(max(w), 1e9) AS w FROM (SELECT w, row_number() OVER (ORDER BY w) AS k FROM (SELECT weight AS w FROM s WHERE v = 'u1' AND u = 'u9' UNION ALL SELECT a.weight + b.weight FROM s a JOIN s b ON b.v = a.u WHERE a.v = 'u1' AND b.u = 'u9')) WHERE k = 5), "

QUERIES = {
    "all_simple_paths": lambda s, d: simple_paths(user_seq(s, d), "u1", "u9", 3).withColumn("path", F.array_join("path", ",")),
    "k_shortest_paths": lambda s, d: k_shortest(user_seq(s, d), "u1", "u9", 5).withColumn("path", F.array_join("path", ",")),
    "pattern_square": lambda s, d: _rows(matches(co_part(s, d), SQUARE)),
    "pattern_diamond": lambda s, d: _rows(matches(user_seq(s, d), DIAMOND)).groupBy("occurrences").agg(F.count("*").alias("sets")),
    "pattern_clique": lambda s, d: _rows(matches(user_seq(s, d), CLIQUE)),
    "pattern_typed_path": lambda s, d: _rows(matches(co_part(s, d), TYPED)),
}
SQL = {
    "all_simple_paths": user_sql("SELECT array_to_string(path, ',') AS path, (len(path) - 1)::INT AS hops, weight, false AS cut FROM sp WHERE tip = 'u9'", _ALL.format(d=3, w=1e9)),
    "k_shortest_paths": user_sql("SELECT row_number() OVER (ORDER BY weight, len(path), path)::INT AS place, array_to_string(path, ',') AS path, (len(path) - 1)::INT AS hops, weight FROM sp WHERE tip = 'u9' QUALIFY place <= 5", _NEAR + _ALL.format(d=6, w='(SELECT w FROM near)')),
    "pattern_square": _matches_sql(SQUARE),
    "pattern_typed_path": _matches_sql(TYPED),
    "pattern_diamond": "SELECT occurrences, count(*) AS sets FROM (" + _matches_sql(DIAMOND, user_sql) + ") GROUP BY 1",
    "pattern_clique": _matches_sql(CLIQUE, user_sql),
}
