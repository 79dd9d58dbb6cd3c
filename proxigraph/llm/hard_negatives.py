"""Hard negatives by a pivot table.

Vectors get one more entry, sqrt(m - |x|^2) with m the largest squared norm, anchors a zero: then
inner products fall as Euclidean distances grow, |q' - x'|^2 = |q|^2 + m - 2 q.x. Every row's distances to
a few pivots are stored with it. The triangle inequality over them brackets the distance of an anchor
and a row, and so their score; only rows whose bracket reaches what is asked for are checked exactly.

Rows lie in blocks by label and nearest pivot, anchors in blocks of their own. Whole pairs of blocks are
brought together, those whose brackets are out of reach are dropped before rows move. Scores are integers,
exact in doubles below 2^53 and in 64 bits above.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.llm.whitening import _dimension, integers
from proxigraph.plans.numbering import numbered
from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LEAST, MOST = 50, 95  # percent of the positive's score that a negative's has to lie between
EVERY = 50  # anchors are rows whose id is divisible by it
PIVOTS, SAMPLE = 8, 1024  # pivots, and the rows among which they are looked for; results do not depend on them
ROWS, ANCHORS, CHUNK = 4096, 1024, 128  # of a block of rows, of anchors, and anchors that a task handles at once


def _prepared(rows: DataFrame, dimension: int, scale: int) -> DataFrame:
    """(vec_id, label, v, sq) of usable rows: v are little-endian 32-bit integers, sq the squared norm."""

    def run(batches):
        for b in batches:
            at, x = integers(b["v"], dimension, scale, 0)
            if len(x) and (np.abs(x).max() >= 1 << 31 or np.square(x.astype(float)).sum(axis=1).max() >= 2.0**62):
                raise OverflowError("an entry is too large for exact scores")
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(at), b["label"].take(at), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array(np.square(x).sum(axis=1))], names=["vec_id", "label", "v", "sq"])

    return rows.mapInArrow(run, "vec_id long, label long, v binary, sq long")


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimension)


def _pivots(rows: DataFrame, dimension: int, m: int) -> np.ndarray:
    """(pivots x dimension + 1): rows far from each other, in augmented space."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").select("v", "sq").limit(SAMPLE).toArrow()
    x = _matrix(some["v"], dimension).astype(float)
    x = np.column_stack([x, np.sqrt(np.maximum(0, m - some["sq"].to_numpy().astype(float)))])
    chosen, near = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < PIVOTS and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows x pivots) of vectors with ``last`` as their additional entry."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(np.square(x - p[:-1]).sum(axis=1) + np.square(last - p[-1]))
    return out


def _with_pivots(rows: DataFrame, dimension: int, m: int, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``d``, distances to the pivots, ``q``, the same as an anchor, and ``cell``, the nearest pivot."""

    def run(batches):
        for b in batches:
            x = _matrix(b["v"], dimension).astype(float)
            last = np.sqrt(np.maximum(0, m - b["sq"].to_numpy().astype(float)))
            d, q = _distances(x, last, pivots), _distances(x, np.zeros(len(x)), pivots)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), len(pivots)).cast(pa.list_(pa.float64())) for a in (d, q)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists, pa.array(d.argmin(axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32))], names=[*b.schema.names, "d", "q", "cell"])

    return rows.mapInArrow(run, "vec_id long, label long, v binary, sq long, d array<double>, q array<double>, cell int")


class _Side:
    """A block in a task."""

    def __init__(self, t: pa.Table, dimension: int, distances: str):
        self.x, self.id, self.label = _matrix(t["v"], dimension), t["vec_id"].to_numpy(), t["label"].to_numpy()
        self.sq, self.place = t["sq"].to_numpy().astype(float), t["place"].to_numpy()
        self.d = np.array(t[distances].to_pylist()).reshape(len(self.x), -1)


def _bracket(a: _Side, rows: slice, b: _Side, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of some anchors and a block."""
    near, far = np.zeros((len(a.id[rows]), len(b.id))), np.full((len(a.id[rows]), len(b.id)), np.inf)
    for j in range(b.d.shape[1]):
        p, q = a.d[rows, j][:, None], b.d[:, j][None, :]
        np.maximum(near, np.abs(p - q), out=near)
        np.minimum(far, p + q, out=far)
    top = a.sq[rows][:, None] + m
    slack = 1 + 1e-9 * top  # for the rounding of distances
    return (top - far * far) / 2 - slack, (top - near * near) / 2 + slack


def _scores(a: _Side, rows: slice, b: _Side, asked: np.ndarray, exact: bool) -> np.ndarray:
    """Scores of the pairs ``asked`` for, the least integer for all others."""
    out = np.full(asked.shape, np.iinfo(np.int64).min)
    kind = float if exact else np.int64
    if asked.mean() > 1 / 16:
        return np.where(asked, (a.x[rows].astype(kind) @ b.x.astype(kind).T).astype(np.int64), out)
    i, j = asked.nonzero()
    q = a.x[rows].astype(np.int64)
    for k in range(0, len(i), 1 << 14):
        x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        out[x, y] = np.einsum("ij,ij->i", q[x], b.x[y].astype(np.int64))
    return out


def _first(scores: np.ndarray, b: _Side, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the first ``k`` of each anchor by score, then id, then place."""
    none = np.iinfo(np.int64).min
    least = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(scores), none)
    i, j = ((scores >= least[:, None]) & (scores > none)).nonzero()
    order = np.lexsort((b.place[j], b.id[j], -scores[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def _meet(rows: DataFrame, anchors: DataFrame, units: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` on each unit (block, ab): its rows and its anchors."""
    units = materialize(units, "negatives-units")
    left = rows.join(units.toDF("ub", "ua"), F.col("block") == F.col("ub")).groupBy("ub", "ua")
    right = anchors.join(units.toDF("vb", "va"), F.col("ab") == F.col("va")).groupBy("vb", "va")
    return left.cogroup(right).applyInArrow(fn, schema)


def _bounds(blocks: DataFrame, key: str, d: str, n: int, prefix: str, *more: Column) -> DataFrame:
    """A row per block: least and greatest distance to each pivot, label and squared norm."""
    per = [f(F.get(d, F.lit(p))).alias(f"{prefix}{name}{p}") for p in range(n) for name, f in (("lo", F.min), ("hi", F.max))]
    return blocks.groupBy(key).agg(*per, F.min("label").alias(f"{prefix}l0"), F.max("label").alias(f"{prefix}l1"), F.min("sq").alias(f"{prefix}s0"), F.max("sq").alias(f"{prefix}s1"), *more)


def _within_reach(rows: DataFrame, anchors: DataFrame, n: int, m: int) -> DataFrame:
    """(block, ab) whose brackets reach the windows of any of the block's anchors and that have different labels."""
    a = materialize(_bounds(anchors, "ab", "q", n, "a", F.min(F.array_min("low")).alias("low"), F.max(F.array_max("high")).alias("high")), "negatives-anchor-blocks")
    b = _bounds(rows, "block", "d", n, "b")
    last = a.agg(F.max("ab")).first()[0]
    pairs = b.withColumn("ab", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).join(a, "ab")
    zero = F.lit(0.0)
    near = F.greatest(zero, *[x for p in range(n) for x in (F.col(f"alo{p}") - F.col(f"bhi{p}"), F.col(f"blo{p}") - F.col(f"ahi{p}"))])
    far = F.least(F.lit(float("inf")), *[F.col(f"ahi{p}") + F.col(f"bhi{p}") for p in range(n)])
    upper = (F.col("as1") + m - near * near) / 2 + 1 + 1e-9 * (F.col("as1") + m)
    lower = (F.col("as0") + m - far * far) / 2 - 1 - 1e-9 * (F.col("as1") + m)
    one_label = (F.col("al0") == F.col("al1")) & (F.col("bl0") == F.col("bl1")) & (F.col("al0") == F.col("bl0"))
    return pairs.filter((upper >= F.col("low")) & (lower <= F.col("high")) & ~one_label).select("block", "ab")


def mine(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by ``every``; their positives the first rows of the same label and
    another id, their negatives for each the first of other labels whose score lies between ``least`` and ``most``
    percent of the positive's. Rows with a null id or label, or a vector that is null, holds null or non-finite
    entries or has another length than most, take no part. Equal rows count once; rows of one id that differ are
    rows of their own. Entries that 32 bits or scores that 62 bits do not hold are an error."""
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).filter("vec_id is not null and label is not null")
    spark, d = rows.sparkSession, _dimension(src)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if d == 0:
        return empty
    base = materialize(_prepared(src, d, scale).distinct(), "negatives-rows")
    m = base.agg(F.max("sq")).first()[0]
    exact, pivots = m < 1 << 53, _pivots(base, d, m)
    n = len(pivots)
    order = [F.col(c) for c in ("label", "cell", "vec_id", "v")]
    placed = numbered(_with_pivots(base, d, m, pivots), order, "place").withColumn("block", F.floor((F.col("place") - 1) / ROWS))
    placed = materialize(placed, "negatives-placed")
    anchors = numbered(placed.filter(F.col("vec_id") % every == 0).drop("block", "d"), [F.col("place")], "at")
    anchors = materialize(anchors.withColumn("ab", F.floor((F.col("at") - 1) / ANCHORS)).drop("at", "cell"), "negatives-anchors")
    if anchors.isEmpty():
        return empty
    body = placed.drop("q", "cell")

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        b, a, out = _Side(left, d, "d"), _Side(right, d, "q"), []
        for k in range(0, len(a.id), CHUNK):
            own = slice(k, k + CHUNK)
            low, high = _bracket(a, own, b, m)
            fine = (a.label[own][:, None] == b.label) & (a.id[own][:, None] != b.id)
            low[~fine] = -np.inf
            if positives < low.shape[1]:  # as many have at least this score
                fine &= high >= np.partition(low, -positives, axis=1)[:, -positives][:, None]
            if not fine.any():
                continue
            s = _scores(a, own, b, fine, exact)
            i, j = _first(s, b, positives)
            out.append((a.place[own][i], b.place[j], b.id[j], s[i, j]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(4)]
        return pa.table(dict(zip(("a", "place", "positive_id", "positive_score"), cols, strict=True)))

    same = placed.select("label", "block").distinct().join(anchors.select("label", "ab").distinct(), "label").select("block", "ab").distinct()
    found = _meet(body, anchors, same, first, "a long, place long, positive_id long, positive_score long")
    by = Window.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id", "place")
    share = lambda f, percent: f(F.col("positive_score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")  # noqa: E731  exact
    low, high = share(F.ceil, least), share(F.floor, most)
    chosen = materialize(found.withColumn("i", F.row_number().over(by)).filter(F.col("i") <= positives).withColumns({"low": low, "high": high}), "negatives-positives")
    windows = chosen.filter("low <= high").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("w"))  # at most ``positives``
    windows = windows.select("a", F.col("w.i").alias("i"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    asking = materialize(anchors.join(windows, anchors.place == windows.a).drop("a"), "negatives-asking")
    if asking.isEmpty():
        return empty

    def between(left: pa.Table, right: pa.Table) -> pa.Table:
        b, a, out = _Side(left, d, "d"), _Side(right, d, "q"), []
        none = np.iinfo(np.int64).min
        kinds, lows, highs = (right[c].to_pylist() for c in ("i", "low", "high"))
        wide = max(map(len, kinds))
        fill = lambda x, v: np.array([r + [v] * (wide - len(r)) for r in x], np.int64)
        kinds, lows, highs = fill(kinds, 0), fill(lows, np.iinfo(np.int64).max), fill(highs, none + 1)
        for k in range(0, len(a.id), CHUNK):
            own = slice(k, k + CHUNK)
            low, high = _bracket(a, own, b, m)
            fine = (a.label[own][:, None] != b.label) & (high >= lows[own].min(axis=1)[:, None]) & (low <= highs[own].max(axis=1)[:, None])
            if not fine.any():
                continue
            s = _scores(a, own, b, fine, exact)
            for w in range(wide):
                i, j = _first(np.where((s >= lows[own, w][:, None]) & (s <= highs[own, w][:, None]), s, none), b, negatives)
                out.append((a.place[own][i], kinds[own, w][i], b.place[j], b.id[j], s[i, j]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(5)]
        return pa.table(dict(zip(("a", "i", "place", "negative_id", "negative_score"), cols, strict=True)))

    hard = _meet(body, asking, _within_reach(body, asking, n, m), between, "a long, i long, place long, negative_id long, negative_score long")
    by = Window.partitionBy("a", "i").orderBy(F.desc("negative_score"), "negative_id", "place")
    ranked = hard.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives).drop("place")
    named = chosen.join(anchors.select(F.col("place").alias("a"), F.col("vec_id").alias("anchor_id")), "a")
    out = ranked.join(named.select("a", "i", "anchor_id", "positive_id", "positive_score"), ["a", "i"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings; every seventh id takes the next label. See ``mine`` for nulls, repeated
    rows and odd vectors; ties go by the smaller vec_id; an empty table gives no rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {
    "op12_hard_negatives": """
WITH x AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM x a JOIN x b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, k::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 3"""
}
