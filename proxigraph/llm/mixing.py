"""Mixing sources to target weights by Pfair scheduling.

Each source has blocks of documents, of one size for tables of every size. With weight w its
k-th block (from 0) is released at slot floor(k / w) and due by slot ceil((k + 1) / w); in every
slot the released block with the earliest deadline is taken. Times come from the exact rational
weights. Slots are filled in windows of a fixed number of them, and how far each source has come at
a window's ends follows from the weights alone (``served``), so tasks fill windows side by side and
no list of blocks is held anywhere.

While a source lasts, after t slots it has been served between w * t - 1 and w * t + 1
blocks, exclusive, at every size and for any number of sources. A source that runs out
leaves its slots empty; the others keep their proportions, so the mix holds all documents
once. With ``slots`` weights are rounded to multiples of 1 / ``slots`` instead, and the
schedule of that period is repeated.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.llm.arrow import free_name
from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize

BLOCK = 32  # documents in a block
MAX_BLOCKS: int | None = None  # if set, blocks grow so that there are no more, besides one that a source may leave unfilled
WINDOW = 1 << 14  # slots that are filled at once, at least
TASKS = 1 << 12  # tasks that fill windows, at most
SLOTS = 1000  # slots in a period of rounded weights
MAX_BUCKETS = 1 << 26


def shares(weights: dict[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Weights as slots of a period, by largest remainders, one each at least; ties by name."""
    if not 0 < len(weights) <= slots or min(weights.values()) <= 0:
        raise ValueError(f"1 to {slots} positive weights are needed")
    total = sum(Fraction(w) for w in weights.values())
    want = {s: Fraction(w) / total * slots for s, w in weights.items()}
    got = {s: max(1, math.floor(x)) for s, x in want.items()}
    by_rest = sorted(want, key=lambda s: (got[s] - want[s], s))
    while (left := slots - sum(got.values())) > 0:
        for s in by_rest[:left]:
            got[s] += 1
    while sum(got.values()) > slots:
        got[max((s for s in got if got[s] > 1), key=lambda s: (got[s] - want[s], s))] -= 1
    return got


def schedule(share: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, k, slot) for one period: earliest deadline first among released blocks."""
    slots = sum(share.values())
    release: dict[int, list[tuple[int, str, int]]] = {}
    for s, n in share.items():
        for k in range(n):
            release.setdefault(k * slots // n, []).append((-((k + 1) * -slots // n), s, k))
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(slots):
        for x in release.get(t, ()):
            heapq.heappush(ready, x)
        due, s, k = heapq.heappop(ready)
        if t >= due:
            raise AssertionError("a block missed its deadline")
        out.append((s, k, t))
    return out


def parts(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """The exact weights as whole numbers, and their sum."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("positive weights are needed")
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(x.denominator for x in exact.values()))
    part = {s: int(x * common) for s, x in exact.items()}
    return part, sum(part.values())


def _release(k: int, part: int, whole: int) -> int:
    return k * whole // part


def _due(k: int, part: int, whole: int) -> int:
    return -((k + 1) * -whole // part)


def served(part: dict[str, int], whole: int, t: int) -> dict[str, int]:
    """Blocks of each source in the first ``t`` slots: its share of them, rounded up or down.

    Of the blocks begun by then and due later, those rounded up fill unit bins of the shares' sums, in the order of
    deadlines and in that of releases at once (a flow of units). So, of those due after any slot, no more are done by
    ``t`` than the slots up to there spare, and, of those released before any slot, no more are left than the slots
    from there on spare: both sides can be filled in time, whatever the other does."""
    done = {s: p * t // whole for s, p in part.items()}
    rest = {s: p * t % whole for s, p in part.items() if p * t % whole}
    by_due = sorted(rest, key=lambda s: (_due(done[s], part[s], whole), s))
    by_release = sorted(rest, key=lambda s: (_release(done[s], part[s], whole), s))
    go: dict[tuple, dict[tuple, None]] = {("to",): {}}  # edges left, in a fixed order
    for order, step in ((by_due, 0), (by_release, 3)):
        at = 0
        for s in order:
            for j in range(at // whole, -(-(at + rest[s]) // whole)):
                for a, b in ((("from",), (0, j)), ((0, j), (1, s)), ((1, s), (2, s))) if step == 0 else (((2, s), (3, j)), ((3, j), ("to",))):
                    go.setdefault(a, {})[b] = None
                    go.setdefault(b, {})
            at += rest[s]
    for _ in range(sum(rest.values()) // whole):
        back: dict[tuple, tuple] = {("from",): ("from",)}
        todo = [("from",)]
        while ("to",) not in back:
            a = todo.pop()
            new = [b for b in go[a] if b not in back]
            back.update(dict.fromkeys(new, a))
            todo += new
        b = ("to",)
        while b != ("from",):
            a = back[b]
            del go[a][b]
            go[b][a] = None
            b = a
    return {s: n + (s in rest and (1, s) in go[2, s]) for s, n in done.items()}


def windows(part: dict[str, int], whole: int, blocks: dict[str, int]) -> tuple[int, int]:
    """Slots of a window and the number of windows. No block may be open at the ends of two windows."""
    width = max(WINDOW, 2 - -whole // min(part.values()))
    return width, -(-max(_due(blocks.get(s, 0) - 1, p, whole) for s, p in part.items()) // width)


def window(part: dict[str, int], whole: int, blocks: dict[str, int], start: int, stop: int) -> Iterator[tuple[str, int, int]]:
    """(source, k, slot) of the blocks in slots ``start`` to ``stop``: earliest deadline first, ties by name.

    A block waits for the one before it, so only the next block of each source is held.
    """
    at, end = served(part, whole, start), served(part, whole, stop)
    end = {s: min(n, blocks.get(s, 0)) for s, n in end.items()}
    waiting = [(_release(at[s], p, whole), s) for s, p in part.items() if at[s] < end[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    t = start
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (min(stop, _due(at[s], part[s], whole)), s))
        due, s = heapq.heappop(ready)
        if t >= due:
            raise AssertionError("a block missed its deadline")
        yield s, at[s], t
        t += 1
        at[s] += 1
        if at[s] < end[s]:
            heapq.heappush(waiting, (_release(at[s], part[s], whole), s))


def exact_slots(weights: dict[str, float], blocks: dict[str, int]) -> dict[str, list[int]]:
    """The slot of each of a source's blocks at the exact weights, window after window."""
    part, whole = parts(weights)
    width, n = windows(part, whole, blocks)
    out: dict[str, list[int]] = {s: [] for s in weights}
    for i in range(n):
        for s, _, t in window(part, whole, blocks, i * width, (i + 1) * width):
            out[s].append(t)
    return out


def _schedule(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int], names: list[str]) -> DataFrame:
    """``exact_slots`` as a table (source, block, slot) named ``names``: a window a row of the tasks' input."""
    part, whole = parts(weights)
    width, n = windows(part, whole, blocks)
    schema = pa.schema([(names[0], pa.string()), (names[1], pa.int64()), (names[2], pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b["id"].to_pylist():
                rows = window(part, whole, blocks, i * width, (i + 1) * width)
                while some := list(itertools.islice(rows, WINDOW)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return spark.range(0, n, 1, max(1, min(n, TASKS))).mapInArrow(run, f"`{names[0]}` string, `{names[1]}` long, `{names[2]}` long")


def tempered(counts: DataFrame, power: float = 0.5) -> dict[str, float]:
    """Target weights in proportion to count ** power. ``counts``: (source, n), a row per source."""
    return {r[0]: float(r[1]) ** power for r in counts.collect()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, slots: int | None = None, rows_per_bucket: int = 1000, prefix: str = "mix_") -> DataFrame:
    """``docs`` with mix_source, mix_block, mix_slot and mix_position, to be read in order of the last.

    Within a source documents go by the md5 of their id and a hash of the row: a fixed shuffle in
    which rows of one id, or without any, lie apart; rows equal in all columns may stand in either
    order. A null source is the source ''. Without ``weights`` they are tempered counts; a source without a weight is an error.
    An empty table gives an empty mix. Columns of ``docs`` that are named like the four added ones
    give way to them; another ``prefix`` keeps them.

    Ranks come from counts of buckets of the md5 and a rank within the bucket, so a source with
    most of the rows is spread over as many tasks as any. One shuffle moves the documents.
    """
    n = docs.count()
    if MAX_BLOCKS:
        block = max(block, -(-n // MAX_BLOCKS))
    bits = min(MAX_BUCKETS.bit_length() - 1, max(0, math.ceil(math.log2(max(1, n / rows_per_bucket)))))
    src = F.coalesce(F.col(source).cast("string"), F.lit(""))
    names = [prefix + c for c in ("source", "block", "slot", "position")]
    kept = [c for c in docs.columns if c.lower() not in [x.lower() for x in names]]
    of, by, bin_, ahead, at, rank_, slot_, slots_, nth = (free_name(f"mix_{c}", docs.columns) for c in ("of", "order", "bin", "ahead", "at", "rank", "slot_of", "slots", "nth"))
    bucket = F.shiftright(F.conv(F.substring(by, 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")
    order = F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.xxhash64(*[docs[c] for c in kept]).cast("string")).cast("binary"))
    keyed = docs.select(*[docs[c] for c in kept], src.alias(of), order.alias(by)).withColumn(bin_, bucket)
    sizes = materialize(keyed.groupBy(of, bin_).agg(F.count("*").alias("n")), "mix-sizes")
    if weights is None:
        weights = tempered(sizes.groupBy(of).agg(F.sum("n").alias("n")))
    if not weights:
        weights = {"": 1.0}
    before = sizes.withColumn(ahead, F.coalesce(F.sum("n").over(Window.partitionBy(of).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.floor(F.col(ahead) / block).cast("long")
    each = before.select(of, bin_, ahead, F.explode(F.sequence(first, F.floor((F.col(ahead) + F.col("n") - 1) / block).cast("long"))).alias(nth))
    if slots is None:
        blocks = {r[0]: -(-r[1] // block) for r in sizes.groupBy(of).agg(F.sum("n").alias("n")).collect()}
        each = each.join(_schedule(docs.sparkSession, weights, blocks, [of, nth, slot_]), [of, nth], "left")
    else:
        period = schedule(shares(weights, slots))
        own = {s: [t for _, t in sorted((k, t) for x, k, t in period if x == s)] for s in weights}
        plan = pa.table({of: pa.array(own, pa.string()), slots_: pa.array(own.values(), pa.list_(pa.int64()))})
        each = each.join(F.broadcast(docs.sparkSession.createDataFrame(plan)), of, "left")  # ``slots`` numbers in all
        share = F.size(slots_).cast("long")
        each = each.withColumn(slot_, F.when(F.col(slots_).isNotNull(), F.floor(F.col(nth) / share).cast("long") * slots + F.get(slots_, (F.col(nth) % share).cast("int"))))
    # the slots of a bucket's blocks: as many as its rows fill
    before = each.groupBy(of, bin_, ahead).agg(F.sort_array(F.collect_list(F.struct(nth, slot_))).alias(slots_))
    local = F.row_number().over(Window.partitionBy(of, bin_).orderBy(by))
    out = keyed.withColumn(at, local).join(before.hint("merge"), [of, bin_]).withColumn(rank_, F.col(ahead) + F.col(at) - 1)
    b = F.floor(F.col(rank_) / block).cast("long")
    slot = F.get(slots_, (b - first).cast("int"))[slot_]
    slot = F.coalesce(slot, F.raise_error(F.concat(F.lit("no weight for source "), of)).cast("long"))
    made = (F.col(of), b, slot, slot * block + F.col(rank_) % block)
    return out.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(x) for c, x in zip(made, names, strict=True)])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix by the square roots of the sources' counts; see ``mix`` for
    nulls, ties and repeated rows. Texts only count for the shuffle within a source."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "mix_source", "mix_block", "mix_slot", "mix_position")


QUERIES = {"op7_mixing": op7_mixing}
SQL: dict[str, str] = {}
