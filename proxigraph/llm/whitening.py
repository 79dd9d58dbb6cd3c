"""Embedding whitening: leading principal components by block subspace iteration, matrix-free.

The covariance is never formed. Each Spark pass multiplies it with a block of directions: every
task centres its rows exactly (integers), adds up Xᵀ(XQ) of its share, and the shares are summed
by row of the product. The driver holds the directions only, dimension x a few blocks: QR makes
a block orthonormal to those before it, Rayleigh-Ritz finds the best vectors of their span, and the
residuals are the next block. When the residuals of all k vectors are below TOLERANCE of the
largest eigenvalue, a pass of its own multiplies the k vectors afresh and certifies them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.plans.session import table

COMPONENTS, BLOCK, BLOCKS = 8, 16, 6  # vectors asked for, directions of a pass, blocks that the span may hold
TOLERANCE, PASSES = 1e-12, 200
SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 52  # entries from here on have no exact integer
SLICE = 1 << 20  # entries that a task handles at once


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` finds: ``basis`` has a unit vector per column, ``values`` their eigenvalues,
    falling; ``residuals`` are norms of V b - e b as certified by the last pass."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    @property
    def dimension(self) -> int:
        return len(self.sums)


def integers(column: pa.Array, dimension: int, factor: int = SCALE, shift: int = SHIFT) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the usable vectors of a batch, by index, and floor(factor * c) + shift of their entries.

    Usable: of this dimension, without null or non-finite entries. Entries so large that their
    integer is not exact are an error."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dimension)
    if not len(at):
        return at, np.zeros((0, dimension), np.int64)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    c = flat.reshape(len(at), dimension)
    ok = np.isfinite(c).all(axis=1)
    scaled = np.floor(factor * c[ok])
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise OverflowError("an entry is too large for an exact integer")
    return at[ok], scaled.astype(np.int64) + shift


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: int64 where it fits, Python integers where not."""
    if not len(x) or (n * int(np.abs(x).max()) < 1 << 62 and max(map(abs, sums.tolist())) < 1 << 62):
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _squares(dev: np.ndarray) -> pa.Array:
    """Sums of squares by row, exact, as decimals."""
    if dev.dtype != object and (not len(dev) or dev.shape[1] * int(np.abs(dev).max()) ** 2 < 1 << 63):
        return pa.array(np.einsum("ij,ij->i", dev, dev)).cast(pa.decimal128(38, 0))
    from decimal import Decimal

    wide = dev.astype(object)
    return pa.array([Decimal(int(s)) for s in (wide * wide).sum(axis=1)], pa.decimal128(38, 0))


def _slices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    step = max(1, SLICE // dimension)
    for big in batches:
        for i in range(0, big.num_rows, step):
            b = big.slice(i, step)
            yield b, *integers(b["v"], dimension)


def _gather(rows: DataFrame, dimension: int, width: int, share: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """(length x width): the sum over all usable vectors of what ``share`` gives for a slice of them."""
    names = [f"y{j}" for j in range(width)]

    def run(batches):
        total = np.zeros((length, width))
        for _, _, x in _slices(batches, dimension):
            if len(x):
                total += share(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), *[pa.array(total[:, j]) for j in range(width)]], names=["i", *names])

    got = rows.select("v").mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((length, width))
    for r in got.collect():  # a row per dimension
        out[r[0]] = r[1:]
    return out


def _dimension(rows: DataFrame) -> int:
    """The most common length of usable vectors (of equals the greatest), 0 without any."""
    x = F.col("v")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    top = rows.filter(x.isNotNull() & fine).groupBy(F.size(x).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top.d if top else 0


def _sums(rows: DataFrame, dimension: int) -> tuple[int, np.ndarray]:
    """Count and exact sums of x by dimension."""

    def run(batches):
        n, total = 0, [0] * dimension
        for _, _, x in _slices(batches, dimension):
            n += len(x)
            part = x.sum(axis=0) if not len(x) or int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int64()), pa.array([str(s) for s in [n, *total]])], names=["i", "s"])

    got = rows.select("v").mapInArrow(run, "i long, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r.i: int(r.s) for r in got}
    return by.get(-1, 0), np.array([by.get(i, 0) for i in range(dimension)], object)


def _orthonormal(block: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Directions of ``block`` beyond the span of ``to``, orthonormal; fewer where it lies within."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - to @ (to.T @ block)
    if not block.shape[1]:
        return block
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    q = q - to @ (to.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def fit(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, passes: int = PASSES) -> Whitening | None:
    """The leading ``k`` components of all usable vectors; None without any.

    There are fewer than k where the covariance has a lower rank: directions whose eigenvalue is below
    ``tolerance`` of the largest are none. RuntimeError if so many ``passes`` do not certify them."""
    rows = rows.select(F.col(vector).alias("v"))
    d = _dimension(rows)
    if d == 0:
        return None
    n, sums = _sums(rows, d)

    def times(q: np.ndarray) -> np.ndarray:
        def share(x: np.ndarray) -> np.ndarray:
            c = deviations(x, n, sums).astype(float) / n
            return c.T @ (c @ q)

        return _gather(rows, d, q.shape[1], share, d) / n

    def spread(x: np.ndarray) -> np.ndarray:
        c = deviations(x, n, sums).astype(float) / n
        return np.array([[np.einsum("ij,ij->", c, c)]])

    trace = float(_gather(rows, d, 1, spread, 1)[0, 0]) / n
    if trace == 0:
        return Whitening(n, tuple(sums), np.zeros((d, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    k, width = min(k, d), min(d, max(block, k))
    span, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = _orthonormal(np.random.default_rng(7).standard_normal((d, width)), span)
    for done in range(1, passes + 1):
        span, image = np.hstack([span, new]), np.hstack([image, times(new)])
        values, turn = np.linalg.eigh((span.T @ image + image.T @ span) / 2)
        values, vectors, image_of = values[::-1], span @ turn[:, ::-1], image @ turn[:, ::-1]
        rest = (image_of - vectors * values)[:, :width]
        real = int((values[:k] > tolerance * max(values[0], 0)).sum())
        new = _orthonormal(rest, span) if span.shape[1] < d else np.zeros((d, 0))
        if new.shape[1] and np.linalg.norm(rest[:, :k], axis=0).max() > tolerance * values[0] / 4:
            if span.shape[1] + new.shape[1] > BLOCKS * width:  # go on from the better half of the span
                keep = BLOCKS * width // 2
                span, r = np.linalg.qr(vectors[:, :keep])
                image = np.linalg.solve(r.T, image_of[:, :keep].T).T
            continue
        basis = np.linalg.qr(vectors[:, :real])[0]
        fresh = times(basis)
        values, turn = np.linalg.eigh((basis.T @ fresh + fresh.T @ basis) / 2)
        values, basis, fresh = values[::-1], basis @ turn[:, ::-1], fresh @ turn[:, ::-1]
        left = np.linalg.norm(fresh - basis * values, axis=0)
        if left.max(initial=0) <= tolerance * values[0]:
            sign = np.where(basis[np.abs(basis).argmax(axis=0), np.arange(real)] < 0, -1.0, 1.0)
            return Whitening(n, tuple(sums), basis * sign, values, trace, left, done + 1)
        span, image, new = basis, fresh, _orthonormal(np.hstack([fresh - basis * values, rest]), basis)
        if not new.shape[1]:
            break
    raise RuntimeError("the passes did not certify the components")


def _whitened(x: np.ndarray, fitted: Whitening) -> tuple[np.ndarray, np.ndarray]:
    dev = deviations(x, fitted.n, np.array(fitted.sums, object))
    return dev, (dev.astype(float) / fitted.n) @ (fitted.basis / np.sqrt(fitted.values))


def identity_error(rows: DataFrame, fitted: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured in a
    pass over all of them."""
    k = len(fitted.values)

    def share(x: np.ndarray) -> np.ndarray:
        w = _whitened(x, fitted)[1]
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = _gather(rows.select(F.col(vector).alias("v")), fitted.dimension, k, share, k + 1) / fitted.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def transform(rows: DataFrame, fitted: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, deviation, whitened): a row per usable vector and component, from 1.
    ``deviation`` is the sum of (n x - S)^2, an exact decimal."""
    k, d = len(fitted.values), fitted.dimension

    def run(batches):
        for b, at, x in _slices(batches, d):
            dev, w = _whitened(x, fitted)
            ids = b["id"].take(pa.array(np.repeat(at, k)))
            total = _squares(dev).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), total, pa.array(w.reshape(-1))], names=["vec_id", "component", "deviation", "whitened"])

    mine = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    return mine.mapInArrow(run, "vec_id long, component int, deviation decimal(38,0), whitened double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened.

    Vectors that are null or hold null or non-finite entries are dropped, and so are those of another
    length than most; a null vec_id stays one. Repeated rows count as often as they stand there. An empty
    table, and one whose vectors are all equal, give no rows; a covariance of a rank below 8 gives as many
    components. ``deviation`` is null where it exceeds a long, ``deviation_exact`` holds it there too."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = fit(rows)
    if fitted is None or not len(fitted.values):
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
        return spark.createDataFrame([], kinds)
    error = identity_error(rows, fitted)
    share = F.get(F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values]), F.col("component") - 1)
    return transform(rows, fitted).select(
        "vec_id", "component", F.lit(fitted.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )


QUERIES = {"op11_whitening": op11_whitening}
SQL: dict[str, str] = {}  # eigenvectors are beyond SQL; tests/llm/test_whitening.py compares with numpy
