"""Removal of repeated byte strings by a hash-compared sort of sparse suffixes.

A byte goes if a string of ``WINDOW`` bytes that covers it starts anywhere else as well.

1. Every window has an anchor: of the ``GRAM``-byte strings inside it the one with the least
   hash, the leftmost of equals. Equal windows have equal anchors at equal places. Windows that
   share an anchor form a run; a run is described by two hashes, of its anchor and its bytes.
2. Runs whose bytes occur twice are removed whole: one aggregation, combined before the shuffle.
3. Only where one anchor has runs of different bytes must windows be compared. One run of
   each kind is fetched, and the suffixes that start at their anchors are sorted by mergesort:
   prefix polynomial hashes and binary search give the common extension of two suffixes in
   logarithmic time. Windows that begin ``o`` bytes before the anchor are equal where the
   extension reaches ``WINDOW - o`` and the ``o`` bytes on the left have one hash. What the hashes
   call equal is compared byte by byte.
4. An anchor with more than ``GROUP`` different runs does not go to one task: the digests of
   its windows are counted by an aggregation instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize

WINDOW, GRAM = 200, 32
SPAN = WINDOW - GRAM + 1  # places for an anchor in a window
GROUP, CHUNK = 4096, 4096  # runs of one anchor, and of all anchors, sorted at once
_SLICE = 900_000  # bytes handled at once; positions in a slice fit 20 bits
_U = np.uint64
_P1, _P2, _B1, _B2 = _U(2147483647), _U(2147483629), _U(1000003), _U(998244353)


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes; GRAM is a power of two, so halves combine."""
    h, size = _BYTE[buf], 1
    while size < GRAM:
        h = h[:-size] * _U(0xA24BAED4963EE407 + 2 * size) + h[size:]
        size *= 2
    return _mixed(h)


def _least(key: np.ndarray) -> np.ndarray:
    """Minimum of every SPAN neighbours."""
    pad = np.concatenate([key, np.full(-len(key) % SPAN, ~_U(0))]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()[: len(key)]
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()[: len(key)]
    return np.minimum(behind[: len(key) - SPAN + 1], ahead[SPAN - 1 :])


def _pieces(docs: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Documents, long ones in parts that share WINDOW - 1 bytes, gathered up to _SLICE bytes."""
    parts, owner, start, n = [], [], [], 0
    for d, raw in enumerate(docs):
        for a in range(0, max(1, len(raw) - WINDOW + 1), _SLICE):
            part = raw[a : a + _SLICE + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            if parts and n + len(part) > _SLICE + WINDOW:
                yield parts, owner, start
                parts, owner, start, n = [], [], [], 0
            parts.append(part)
            owner.append(d)
            start.append(a)
            n += len(part)
    if parts:
        yield parts, owner, start


def runs(docs: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: doc, start of the first window, number of windows, place
    of the anchor after that start, hash of the anchor, hash of the run's bytes."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    out: dict[str, list] = {k: [] for k in ("doc", "start", "count", "off", "h", "c")}
    for parts, owner, first in _pieces(docs):
        raw = b"".join(parts)
        buf = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        h = _gram_hashes(buf)
        low = _U((1 << 20) - 1)
        least = _least((h & ~low) | np.arange(len(h), dtype=np.uint64))
        part = np.searchsorted(ends, np.arange(len(least)), side="right")
        w = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[np.minimum(part, len(ends) - 1)])
        anchor = (least[w] & low).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (w[1:] != w[:-1] + 1)])
        a, b, p = w[cut], w[np.r_[cut[1:], len(w)] - 1] + WINDOW, anchor[cut]
        begin = np.r_[0, ends[:-1]]
        part = part[a]
        out["doc"].append(np.array(owner)[part])
        out["start"].append(a - begin[part] + np.array(first)[part])
        out["count"].append(b - a - WINDOW + 1)
        out["off"].append(p - a)
        out["h"].append(h[p].view(np.int64))
        out["c"].append(np.array([digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64).view(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


class _Suffixes:
    """Runs of one chunk, laid out so that all anchors stand in one column."""

    def __init__(self, data: list[bytes], off: np.ndarray, group: np.ndarray):
        self.n, self.at = len(data), SPAN - 1
        width = self.at + max(len(d) - int(o) for d, o in zip(data, off, strict=True))
        self.m = np.zeros((self.n, max(width, self.at + WINDOW)), np.uint8)
        for i, (d, o) in enumerate(zip(data, off.tolist(), strict=True)):
            self.m[i, self.at - o : self.at - o + len(d)] = np.frombuffer(d, np.uint8)
        self.right = np.minimum(WINDOW, np.array([len(d) for d in data]) - off)
        w = self.m.shape[1]
        self.p1, self.p2 = np.zeros((self.n, w + 1), np.uint64), np.zeros((self.n, w + 1), np.uint64)
        self.w1, self.w2 = np.ones(w + 1, np.uint64), np.ones(w + 1, np.uint64)
        for j in range(w):
            v = self.m[:, j].astype(np.uint64) + _U(1)
            self.p1[:, j + 1] = (self.p1[:, j] * _B1 + v) % _P1
            self.p2[:, j + 1] = (self.p2[:, j] * _B2 + v) % _P2
            self.w1[j + 1], self.w2[j + 1] = self.w1[j] * _B1 % _P1, self.w2[j] * _B2 % _P2
        self.group = group
        self.order = self._sorted()

    def hash(self, x, a, b) -> np.ndarray:
        """Of bytes [a, b) in rows x."""
        n = b - a
        h1 = (self.p1[x, b] + _P1 * _P1 - self.p1[x, a] * self.w1[n] % _P1) % _P1
        h2 = (self.p2[x, b] + _P2 * _P2 - self.p2[x, a] * self.w2[n] % _P2) % _P2
        return (h1 << _U(32)) | h2

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common bytes to the right of the anchors, at most WINDOW, by binary search on hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.right[x], self.right[y])
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.hash(x, self.at, self.at + mid) == self.hash(y, self.at, self.at + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def _less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        e = self.extension(x, y)
        end = (e >= self.right[x]) | (e >= self.right[y])
        at = np.minimum(self.at + e, self.m.shape[1] - 1)
        tie = np.where(self.right[x] == self.right[y], or_equal, self.right[x] < self.right[y])
        return np.where(end, tie, self.m[x, at] < self.m[y, at])

    def _sorted(self) -> np.ndarray:
        """Mergesort of all groups at once: each suffix finds its rank in the neighbouring run."""
        first = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
        size = np.diff(np.r_[first, self.n])
        base, total = np.repeat(first, size), np.repeat(size, size)
        order = np.arange(self.n)
        w = 1
        while w < size.max():
            slot = np.flatnonzero(total > w)
            j = slot - base[slot]
            run = j // w
            lo0 = (run ^ 1) * w
            lo, hi = np.minimum(lo0, total[slot]), np.minimum(lo0 + w, total[slot])
            x, start = order[slot], lo.copy()
            while (todo := np.flatnonzero(lo < hi)).size:
                mid = (lo[todo] + hi[todo]) // 2
                y = order[base[slot[todo]] + mid]
                under = self._less(y, x[todo], (run[todo] & 1) == 1)  # equals of the left run go first
                lo[todo], hi[todo] = np.where(under, mid + 1, lo[todo]), np.where(under, hi[todo], mid)
            new = base[slot] + (run & ~1) * w + (j - run * w) + (lo - start)
            merged = order.copy()
            merged[new] = x
            order, w = merged, 2 * w
        return order

    def repeated(self, off: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(runs x SPAN) booleans: the window at place t of a run equals one of another run."""
        o_, g_ = off[self.order], self.group[self.order]
        c_ = count[self.order]
        lcp = np.zeros(self.n, np.int64)
        on = np.flatnonzero(g_[1:] == g_[:-1]) + 1
        lcp[on] = self.extension(self.order[on - 1], self.order[on])
        lcp[np.r_[0, np.flatnonzero(g_[1:] != g_[:-1]) + 1]] = -1
        out = np.zeros((self.n, SPAN), bool)
        for o in range(SPAN):
            some = np.flatnonzero((o <= o_) & (o > o_ - c_))
            if len(some) < 2:
                continue
            kind = np.cumsum((lcp < WINDOW - o) | (lcp < 0))[some]
            x = self.order[some]
            twice = np.bincount(kind)[kind] > 1
            kind, x = kind[twice], x[twice]
            left = self.hash(x, np.full(len(x), self.at - o), np.full(len(x), self.at))
            by = np.lexsort((left, kind))
            kind, left, x = kind[by], left[by], x[by]
            same = np.flatnonzero((kind[1:] == kind[:-1]) & (left[1:] == left[:-1]))
            if not len(same):
                continue
            a, b = x[same], x[same + 1]
            rows = slice(self.at - o, self.at - o + WINDOW)
            if all((self.m[a[i : i + 4096], rows] == self.m[b[i : i + 4096], rows]).all() for i in range(0, len(a), 4096)):
                out[a, off[a] - o] = out[b, off[b] - o] = True
            else:  # two strings have one hash: take the bytes themselves
                seen: dict[tuple, int] = {}
                for i in x.tolist():
                    k = (self.group[i], self.m[i, rows].tobytes())
                    if (other := seen.setdefault(k, i)) != i:
                        out[i, off[i] - o] = out[other, off[other] - o] = True
        return out


def _resolve(t: pa.Table) -> pa.RecordBatch:
    """Removed stretches of the runs that occur once, for whole groups of one anchor."""
    h, c, off, count = (t[k].to_numpy() for k in ("h", "c", "off", "count"))
    keep = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])  # a run may be sent twice
    t = t.take(pa.array(keep))
    h, off, count = h[keep], off[keep].astype(np.int64), count[keep].astype(np.int64)
    hit = _Suffixes(t["data"].to_pylist(), off, h).repeated(off, count)
    hit[~t["single"].to_numpy(zero_copy_only=False)] = False
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    start = t["start"].to_numpy()[row]
    return pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(pa.array(row)), t["th"].combine_chunks().take(pa.array(row)), pa.array((start + a).astype(np.int32)), pa.array((start + b - 1 + WINDOW).astype(np.int32))], names=["doc_id", "th", "a", "b"])


def _resolve_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0
    for big in batches:
        for i in range(0, big.num_rows, CHUNK):
            held.append(big.slice(i, CHUNK))
            n += held[-1].num_rows
            if n < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            if h[0] == h[-1]:
                continue  # still one anchor
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
            yield _resolve(t.slice(0, cut))
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield _resolve(pa.Table.from_batches(held))


_KEY = ["doc_id", "th"]


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(source, spans): ``source`` has id, doc_id, th (a hash of the text) and text; ``spans`` one row
    for each (doc_id, th) from which bytes go, with a list of stretches (a, b) that may overlap.

    Null text: empty. ``id`` is the row's own; doc_id, a key of these two tables only, has -1 where it
    is null, as rows of one text lose the same bytes anyway. Repeated rows repeat each other's bytes.
    """
    own = F.col(doc_id).cast("long")
    src = docs.select(own.alias("id"), F.coalesce(own, F.lit(-1)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.withColumn("th", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = runs([x.encode("utf-8", "surrogatepass") for x in b["text"].to_pylist()])
            doc = pa.array(r["doc"], pa.int64())
            pack = (r["start"] << 16) | (r["count"] << 8) | r["off"]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(doc), b["th"].take(doc), pa.array(pack, pa.int64()), pa.array(r["h"]), pa.array(r["c"])], names=["doc_id", "th", "pack", "h", "c"])

    all_runs = src.select("doc_id", "th", "text").mapInArrow(cut, "doc_id long, th long, pack long, h long, c long")
    twice = all_runs.groupBy("h").agg(F.count("*").alias("n_h"), (F.min("c") != F.max("c")).alias("mixed")).filter("n_h > 1")
    met = materialize(all_runs.join(twice, "h"), "suffix-met")  # most anchors stand once and go here
    kinds = materialize(met.filter("mixed").groupBy("h", "c").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")), "suffix-kinds")
    # Both sides are tables of their own, so that a join on an anchor with very many kinds can be split.
    about = materialize(kinds.join(materialize(kinds.groupBy("h").agg(F.count("*").alias("kinds")), "suffix-anchors"), "h"), "suffix-about")
    met = met.filter("mixed").join(about, ["h", "c"]).filter((F.col("n") > 1) | (F.col("doc_id") == F.col("rep"))).select(*_KEY, "pack", "h", "c", "n", "rep", "kinds").unionByName(
        met.filter("not mixed").select(*_KEY, "pack", "h", "c", F.col("n_h").alias("n")), allowMissingColumns=True)
    rows = F.struct("pack", "h", "c", (F.col("n") == 1).alias("single"), "kinds")
    send = F.col("kinds").isNotNull() & (F.col("doc_id") == F.col("rep"))
    per_doc = met.groupBy(*_KEY).agg(F.collect_list(F.when(F.col("n") > 1, F.col("pack"))).alias("whole"), F.collect_list(F.when(send, rows)).alias("send"))
    per_doc = materialize(per_doc, "suffix-runs")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "th", "start", "count", "off", "h", "c", "single", "kinds", "data")
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for i, th, t, rows in zip(*(b[k].to_pylist() for k in ("doc_id", "th", "text", "send")), strict=True):
                raw, seen = t.encode("utf-8", "surrogatepass"), set()
                for r in rows:
                    if (r["h"], r["c"]) not in seen:
                        seen.add((r["h"], r["c"]))
                        start, count, off = r["pack"] >> 16, r["pack"] >> 8 & 255, r["pack"] & 255
                        for k, v in zip(names, (i, th, start, count, off, r["h"], r["c"], r["single"], r["kinds"], raw[start : start + count - 1 + WINDOW]), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, types, strict=True)], names=list(names))

    schema = "doc_id long, th long, start int, count short, off short, h long, c long, single boolean, kinds long, data binary"
    wanted = src.select("doc_id", "th", "text").join(per_doc.filter(F.size("send") > 0).select(*_KEY, "send"), _KEY)
    sent = materialize(wanted.mapInArrow(fetch, schema), "suffix-sent")
    span = "doc_id long, th long, a int, b int"
    usual = sent.filter(F.col("kinds") <= group).repartition("h").sortWithinPartitions("h", "c").mapInArrow(_resolve_groups, span)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for big in batches:
            for i in range(0, big.num_rows, 2048):
                b = big.slice(i, 2048)
                out: list[list] = [[], [], [], [], [], []]
                for d, th, start, count, single, data in zip(*(b[k].to_pylist() for k in ("doc_id", "th", "start", "count", "single", "data")), strict=True):
                    for t in range(count):
                        w = xxhash.xxh3_128_digest(data[t : t + WINDOW])
                        for col, v in zip(out, (int.from_bytes(w[:8], "big", signed=True), int.from_bytes(w[8:], "big", signed=True), d, th, start + t, single), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["x", "y", "doc_id", "th", "a", "single"])

    hot = sent.filter(F.col("kinds") > group).dropDuplicates(["h", "c"]).mapInArrow(windows, "x long, y long, doc_id long, th long, a int, single boolean")
    twice = hot.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1")
    far = hot.filter("single").join(twice, ["x", "y"]).select(*_KEY, "a", (F.col("a") + WINDOW).alias("b"))
    some = materialize(usual.unionByName(far), "suffix-spans")
    whole = per_doc.filter(F.size("whole") > 0).select(*_KEY, F.explode("whole").alias("p"))
    start = F.shiftright("p", 16).cast("int")
    whole = whole.select(*_KEY, start.alias("a"), (start + F.shiftright("p", 8).bitwiseAND(255).cast("int") - 1 + WINDOW).alias("b"))
    return src, some.unionByName(whole).groupBy(*_KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _kept(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What stays, and how many maximal stretches went."""
    if not spans:
        return raw, 0
    out, at, n, end = [], 0, 0, -1
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if a > end:
            n += 1
            out.append(raw[at:a])
        end = max(end, b)
        at = max(at, b)
    return b"".join([*out, raw[at:]]), n


def _applied(docs: DataFrame, text: str, doc_id: str, make, schema: str) -> DataFrame:
    src, spans = find_repeats(docs, text, doc_id)
    return src.join(spans, _KEY, "left").mapInArrow(make, schema)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kept): for each row of ``docs``, repeated or without an id, the bytes that stay, which
    may cut characters. Null text: no bytes. Other columns are not read; an empty table gives none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [_kept(t.encode("utf-8", "surrogatepass"), s)[0] for t, s in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return _applied(docs, text, doc_id, make, "doc_id long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row of documents once strings that stand elsewhere too are gone; see
    ``find_repeats`` and ``deduplicate`` for nulls and repeated rows. No text: nothing to remove."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for t, s in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                kept, n = _kept(raw, s)
                for k, v in zip(out, (len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items())], names=["doc_id", *out])

    return _applied(table(spark, sf_dir, "documents"), "text", "doc_id", make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
SQL: dict[str, str] = {}
