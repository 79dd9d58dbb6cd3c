"""SimHash near-duplicates: links between fingerprints by tiled comparison.

Only distinct fingerprints are compared. Two 64-bit ones that differ in at most ``radius`` bits
agree on one of ``radius + 1`` bands of bits (pigeonhole), so every pair meets in a band's bucket.
Every bucket is sorted by population count and cut into tiles; a pair of tiles whose counts differ
by more than the radius is skipped, the others are compared by exclusive-or and bit counts.
A bucket too large for one task is dealt out as pairs of tiles. Tasks return a spanning
forest of the links they find, never all pairs.

Texts of which a fifth of the shingles differ are some ten bits of 64 apart, too many for bands.
``similar`` takes WORDS * 64 bits and meets pairs in tables of sampled bits instead, as many as find all
but MISSED of the pairs at the limit. Bits only propose: whole groups of proposed texts are brought
together, and a link is one whose sets of shingles have the similarity asked for.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm.arrow import free_name, map_arrow, texts
from proxigraph.plans.components import components
from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize

RADIUS = 3
TILE = 1024
BUCKET = 8192  # fingerprints of a bucket that one task compares by itself
SHINGLE = 3
HELD = 1 << 16  # rows of whole buckets that a task compares at once
WORDS, MISSED, MEET = 4, 0.03, 1024  # of ``similar``: words of a fingerprint, share not met, documents that meet by chance
SPREAD = 2.5  # standard deviations beyond the mean distance at the limit up to which texts are proposed
SCAN = 1024  # texts that a task of ``similar`` hashes at once
UNIT = 16 << 20  # characters of a proposed group that one task checks by itself
_LANES = np.uint64(0x0101010101010101)


def _hashes(docs: list[str], shingle: int) -> tuple[list[np.ndarray], list[int]]:
    """Hashes of the shingles of each whole text, repeats included, and how many there are."""
    import xxhash

    digest, hashes, lengths = xxhash.xxh64_intdigest, [], []
    for t in docs:
        words = t.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and blanks only
        if len(words) > shingle:
            flat = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: len(words) - shingle].tolist()]
            got = [digest(flat[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        else:
            got = [digest(b" ".join(words), 42)] if words else []
        hashes.append(np.array(got, np.uint64))
        lengths.append(len(got))
    return hashes, lengths


def fingerprints(docs: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit SimHash of each whole text; no words gives zero."""
    return _majority(*_hashes(docs, shingle))


def wide_fingerprints(docs: list[str], shingle: int, words: int = WORDS) -> np.ndarray:
    """(texts x words): SimHash of 64 bits a word; the others' bits come from hashes of the hashes."""
    return _wide(*_hashes(docs, shingle), words)


def _wide(hashes: list[np.ndarray], lengths: list[int], words: int = WORDS) -> np.ndarray:
    out = [_majority(hashes, lengths)]
    for _ in range(1, words):
        hashes = [(h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) for h in hashes]
        hashes = [(h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) for h in hashes]
        out.append(_majority([h ^ (h >> np.uint64(31)) for h in hashes], lengths))
    return np.stack(out, axis=1)


def _majority(hashes: list[np.ndarray], lengths: list[int]) -> np.ndarray:
    """Bits set in over half of each run of hashes. Eight bytes of a word count eight bits at a
    time; runs are cut so that no byte overflows."""
    n = np.array(lengths, np.int64)
    out = np.zeros(len(n), np.uint64)
    if not n.sum():
        return out
    flat = np.concatenate(hashes)
    cuts = np.concatenate([np.arange(a, a + c, 255) for a, c in zip(np.cumsum(n) - n, n, strict=True) if c])
    owner = np.repeat(np.flatnonzero(n), (n[n > 0] + 254) // 255)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    docs = owner[first]
    for j in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(j)) & _LANES, cuts)
        for byte in range(8):
            part = ((lanes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            on = 2 * np.add.reduceat(part, first) > n[docs]
            out[docs] |= on.astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def with_fingerprint(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``fp`` (the fingerprint as a signed long)."""
    mine = free_name("text", keep)
    src = docs.select(*keep, F.col(text).alias(mine))
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(b: pa.RecordBatch) -> dict:
        return {c: b[c] for c in keep} | {"fp": pa.array(fingerprints(texts(b[mine])).view(np.int64))}

    return map_arrow(src, run, schema)


class _Forest:
    """Union-find over 0..n-1 that takes arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if np.array_equal(nxt, r):
                return r
            r = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            on = x != y
            if not on.any():
                return
            a, b, hi, lo = a[on], b[on], np.maximum(x, y)[on], np.minimum(x, y)[on]
            np.minimum.at(self.up, hi, lo)


def _tiles(forest: _Forest, fp: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[int, int]:
    """Link all close pairs of two index lists (or of one with itself), both by population count.
    Returns how many pairs of tiles were compared, and how many skipped."""
    done = skipped = 0
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        lo, hi = counts[a[0]] - radius, counts[a[-1]] + radius
        for j in range(i if right is left else 0, len(right), TILE):
            b = right[j : j + TILE]
            if counts[b[0]] > hi or counts[b[-1]] < lo:
                skipped += 1
                continue
            done += 1
            far = np.zeros((len(a), len(b)), np.uint16)
            for w in range(fp.shape[1]):
                far += np.bitwise_count(fp[a, w][:, None] ^ fp[b, w][None, :])
            x, y = np.nonzero(far <= radius)
            forest.link(a[x], b[y])
    return done, skipped


def _links(key: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, row) within each bucket; ``fp``: rows x words."""
    counts = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.lexsort((counts, key))
    key, fp, side, counts = key[order], fp[order], side[order], counts[order]
    forest = _Forest(len(fp))
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    index = np.arange(len(key))
    for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        own = index[s : s + n]
        if side[s : s + n].any():
            _tiles(forest, fp, counts, own[side[own] == 1], own[side[own] == 2], radius)
        else:
            _tiles(forest, fp, counts, own, own, radius)
    root = forest.roots(index)
    on = np.flatnonzero(root != index)
    return order[on], order[root[on]]


def _compare(dealt: DataFrame, words: int, radius: int, bucket: int) -> DataFrame:
    """(a, b): spanning links between the ids of ``dealt`` (id, f0.., key): those of one key that
    are at most ``radius`` bits apart."""
    fp = [f"f{w}" for w in range(words)]
    large = dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket)
    # A large bucket is cut into tiles of its own by population count and hash; close pairs of tiles are dealt out.
    pop = F.floor(sum((F.bit_count(c) for c in fp), F.lit(0)) / (radius + 1)).cast("int")
    tiles = dealt.join(large, "key").withColumns({"pop": pop, "parts": F.ceil(F.col("n") / bucket).cast("int")})
    tiles = tiles.withColumn("tile", F.struct("pop", F.pmod(F.hash(*fp), F.col("parts")).alias("p")))
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    met = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.transform(each, lambda p: F.struct((F.col("pop") + d).alias("pop"), p.alias("p")))))
    pair = lambda a, b: F.xxhash64("key", a["pop"], a["p"], b["pop"], b["p"])
    spread = tiles.select("id", *fp, "key", "tile", F.explode(met).alias("m")).select(
        "id", *fp, F.when(F.col("tile") <= F.col("m"), pair(F.col("tile"), F.col("m"))).otherwise(pair(F.col("m"), F.col("tile"))).alias("key"),
        F.when(F.col("tile") == F.col("m"), 0).when(F.col("tile") < F.col("m"), 1).otherwise(2).alias("side"),
    )
    small = dealt.join(large, "key", "left_anti").select("id", *fp, "key", F.lit(0).alias("side"))
    work = small.unionByName(spread).repartition("key").sortWithinPartitions("key")

    def links(t: pa.Table) -> pa.RecordBatch:
        a, b = _links(t["key"].to_numpy(), np.stack([t[c].to_numpy().view(np.uint64) for c in fp], axis=1), t["side"].to_numpy(), radius)
        ids = t["id"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < HELD:
                continue
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut:
                yield links(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
        if n:
            yield links(pa.Table.from_batches(held))

    return work.mapInArrow(run, "a long, b long")


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column ``fp`` that span every group."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    masks = [(((1 << int(b - a)) - 1) << int(a), int(a), i) for i, (a, b) in enumerate(itertools.pairwise(edges))]
    key = F.array(*[F.xxhash64(F.lit(i), F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")), s)) for m, s, i in masks])
    return _compare(distinct.select(F.col("fp").alias("id"), F.col("fp").alias("f0"), F.explode(key).alias("key")), 1, radius, bucket)


def bits_apart(similarity: float, words: int = WORDS) -> int:
    """Up to how many bits two texts of this Jaccard similarity differ in, SPREAD standard deviations above the
    mean: the share of differing bits is the angle of the shingle counts over pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(64 * words * p + SPREAD * math.sqrt(64 * words * p * (1 - p)))


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have this Jaccard similarity, in integers of a millionth."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _verified(sets: list[np.ndarray], fp: np.ndarray, side: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links that span the groups of alike texts: pairs at most ``radius`` bits apart, of one unit or, where sides
    are told, of different sides. A pair whose groups are one already is not looked at."""
    n, out = len(sets), []
    group, size = np.arange(n), np.array([len(x) for x in sets])
    for i in range(n):
        far = np.zeros(n - i - 1, np.uint16)
        for w in range(fp.shape[1]):
            far += np.bitwise_count(fp[i + 1 :, w] ^ fp[i, w])
        small, large = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        fine = (far <= radius) & (small >= similarity * large - 1e-6)
        if side[i]:
            fine &= side[i + 1 :] != side[i]
        todo = fine.nonzero()[0] + i + 1
        todo = todo[np.argsort(far[todo - i - 1], kind="stable")]
        while len(todo := todo[group[todo] != group[i]]):
            j, todo = int(todo[0]), todo[1:]
            if _alike(sets[i], sets[j], similarity):
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def _check(texts_of: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """(a, b): verified links between the ids of ``texts_of`` (id, d0, text, f0.., c0, unit, side)."""
    fp = [f"f{w}" for w in range(WORDS)]

    def unit(t: pa.Table) -> tuple[list[int], list[int]]:
        import xxhash

        hashes, _ = _hashes(texts(t["text"].combine_chunks()), shingle)
        sets = [np.unique(h) for h in hashes]
        told = t["d0"].to_pylist()
        own = [k for k, x in enumerate(sets) if _signed(xxhash.xxh64_intdigest(x.tobytes(), 7)) == told[k]]  # an id may have other texts
        ids, grid = t["id"].to_numpy(), np.stack([t[c].to_numpy().view(np.uint64) for c in fp], axis=1)
        got = _verified([sets[k] for k in own], grid[own], t["side"].to_numpy()[own], radius, similarity)
        return [int(ids[own[i]]) for i, _ in got], [int(ids[own[j]]) for _, j in got]

    def run(batches):
        held, key = [], None

        def flush() -> pa.RecordBatch:
            a, b = unit(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            keys = b["unit"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and keys[i] != key:
                    yield flush()
                    held = []
                key = keys[i]
                held.append(b.slice(i, j - i))
        if held:
            yield flush()

    return texts_of.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sampled_bits(n: int, similarity: float, words: int = WORDS) -> np.ndarray:
    """(tables x bits): positions that the tables for ``n`` fingerprints take, drawn from a fixed seed."""
    bits = max(12, math.ceil(math.log2(max(1, n) / MEET)))
    met = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** bits
    draw = np.random.default_rng(20)
    return np.stack([draw.permutation(64 * words)[:bits] for _ in range(math.ceil(math.log(MISSED) / math.log(1 - met)))])


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, bucket: int = BUCKET, unit: int = UNIT) -> DataFrame:
    """(doc_id, component_id) of documents in groups of two or more; component_id is the least doc_id.

    Documents link where the Jaccard similarity of their sets of shingles reaches ``similarity``, checked on the
    whole texts of every proposed group. Pairs at the limit are proposed with a chance of 1 - MISSED or more,
    those above it more surely; nothing below it links. Texts of equal sets, and texts without words, always
    link. Null ids are left out; rows of one id are one document. A proposed group of over ``unit`` characters is
    checked as pairs of its parts, so its work grows with the square of the parts.
    """
    src = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fp = [f"f{w}" for w in range(WORDS)]
    kinds = ", ".join(f"{c} long" for c in fp)

    def scan(b: pa.RecordBatch) -> dict:
        import xxhash

        hashes, lengths = _hashes(texts(b["text"]), shingle)
        got = _wide(hashes, lengths).view(np.int64)
        sets = [np.unique(h).tobytes() for h in hashes]
        d0, d1 = ([_signed(xxhash.xxh64_intdigest(x, seed)) for x in sets] for seed in (7, 8))
        return {"doc_id": b["doc_id"], "d0": d0, "d1": d1, "chars": [len(t or "") for t in b["text"].to_pylist()]} | {c: pa.array(got[:, w]) for w, c in enumerate(fp)}

    rows = materialize(map_arrow(src, scan, f"doc_id long, d0 long, d1 long, chars long, {kinds}", SCAN), "simhash-wide")
    least = rows.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "chars", *fp)).alias("x"))  # texts of one set are one
    own = materialize(least.select("d0", "d1", F.col("x.doc_id").alias("id"), "x.chars", *[f"x.{c}" for c in fp]), "simhash-reps")
    at, radius = sampled_bits(own.count(), similarity), bits_apart(similarity)

    def deal(batches):
        for big in batches:
            for i in range(0, big.num_rows, 4096):
                b = big.slice(i, 4096)
                grid = np.stack([b[c].to_numpy().view(np.uint64) for c in fp], axis=1)
                for k, some in enumerate(at):
                    key = np.full(len(grid), k, np.int64)
                    for x in some.tolist():
                        key = key << 1 | (grid[:, x // 64] >> np.uint64(x % 64) & np.uint64(1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([b["id"], *[b[c] for c in fp], pa.array(key)], names=["id", *fp, "key"])

    dealt = own.select("id", *fp).mapInArrow(deal, f"id long, {kinds}, key long")
    proposed = _compare(dealt, WORDS, radius, bucket)
    met = own.join(components(proposed.toDF("src", "dst")), "id")
    parts = met.groupBy("component").agg(F.ceil(F.sum("chars") / unit).cast("long").alias("parts"))
    held = materialize(met.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("id", "d0"), "parts")), "simhash-proposed")
    # A small group is one unit; of a large one, every part meets every part: part p of n is in units (p, q) and (q, p).
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q")
    place = held.select("id", "d0", *fp, "component", "part", other)
    first, last = F.least("part", "q"), F.greatest("part", "q")
    side = F.when(F.col("part") == F.col("q"), 0).when(F.col("part") < F.col("q"), 1).otherwise(2)
    units = place.select("id", "d0", *fp, F.xxhash64("component", first, last).alias("unit"), side.alias("side"))
    links = _check(units.join(src.withColumnRenamed("doc_id", "id"), "id"), shingle, radius, similarity)
    same = rows.join(own.select("d0", "d1", "id"), ["d0", "d1"]).filter(F.col("doc_id") != F.col("id")).select("id", "doc_id")
    comp = components(links.toDF("src", "dst").unionByName(same.toDF("src", "dst")))
    return comp.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``.

    component_id is the least doc_id that links reach. Texts without words have fingerprint
    zero and link like any other. Rows that share a doc_id count as one document; rows whose
    doc_id is null get the component of their fingerprint, null if none has an id.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(with_fingerprint(src, "text", ["doc_id"]), "simhash-rows")
    own = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    links = materialize(link_fingerprints(own.select("fp"), radius).distinct(), "simhash-links")
    rep = lambda c: own.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep"))
    edges = links.join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_rep").alias("src"), F.col("b_rep").alias("dst"))
    reps = rows.join(own, "fp").filter(F.col("doc_id") != F.col("rep")).select("doc_id", "rep")
    several = rows.join(own, "fp").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter(F.col("lo") != F.col("hi"))
    edges = edges.unionByName(reps.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")))
    comp = components(edges).groupBy("id").agg(F.min("component").alias("component"))
    least = own.join(comp, own.rep == comp.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(least, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its group (see ``similar``); a row without id
    is its own group. Of repeated rows with that id all stay. Texts are not shuffled by fingerprint.
    """
    near = similar(docs, text, doc_id, shingle, similarity)
    key = free_name("gone", docs.columns)
    gone = near.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone[key], "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of documents, links at 3 bits or fewer; see
    ``near_duplicates`` for nulls, texts without words, repeated rows and an empty table."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
