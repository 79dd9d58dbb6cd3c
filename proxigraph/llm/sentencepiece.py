"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into chunks wherever no piece joins two neighbouring characters. Each distinct
chunk is encoded once. Its substrings of bounded length are exploded and equi-joined to the
piece table; the edges found are grouped by chunk and folded by a higher-order aggregate:

* unigram models: Viterbi, the best total score over positions;
* BPE models: the path of highest total score is not what merging gives, so the fold replays
  the merges on a bit mask of boundaries, best rank first (``regular`` says why one pass does).

Chunk tables go back to the documents by shard, a range of rows of one input file: a task
reads the tables of its shards from the shared folder, so texts are never shuffled and no
task holds more than the chunks of one shard. Characters without a piece become byte pieces.
Inside tasks chunks stay Arrow arrays and ids numpy arrays, never lists of Python objects.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from proxigraph.llm.arrow import trim
from proxigraph.plans.session import table
from proxigraph.plans.shared import drop, fresh_path, materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SHARD_ROWS = 8192
SLICE_CHARS = 500_000  # characters that a task handles at once, one text at least
MASK = 62  # characters of a chunk whose boundaries fit a long
LONG = 256  # longer chunks are not put into tables but encoded where they occur


@dataclass(frozen=True)
class Pieces:
    """The piece table. ``ids`` and ``score`` of ordinary pieces, ids of the 256 byte pieces."""

    ids: dict[str, int]
    score: dict[str, float]
    byte_ids: tuple[int, ...]
    unknown: int
    text: tuple[bytes | None, ...]  # what each id decodes to; None: nothing
    bpe: bool
    longest: int
    pairs: frozenset[str]  # two characters that stand side by side in a piece
    odd: frozenset[str]  # BPE pieces that one pass of merges by rank would not find

    @cached_property
    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """A class for each code point (0: in no piece of two or more), and which classes a piece joins."""
        seen = {c: k for k, c in enumerate(sorted({c for p in self.pairs for c in p}), 1)}
        kind = np.zeros(0x110000, np.uint16)
        kind[[ord(c) for c in seen]] = list(seen.values())
        joined = np.zeros((len(seen) + 1, len(seen) + 1), bool)
        for p in self.pairs:
            joined[seen[p[0]], seen[p[1]]] = True
        return kind, joined

    @cached_property
    def single(self) -> np.ndarray:
        """The id of each one-character piece by code point, else -1."""
        out = np.full(0x110000, -1, np.int32)
        one = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        out[list(one)] = list(one.values())
        return out


def replay(chunk: str, score: dict[str, float]) -> list[tuple[float, int, int]]:
    """Merges that BPE does on ``chunk``, in order: (score, start, end). The plain definition."""
    cut = list(range(len(chunk) + 1))
    out = []
    while True:
        found = [(-score[p], cut[i]) for i in range(len(cut) - 2) if (p := chunk[cut[i] : cut[i + 2]]) in score]
        if not found:
            return out
        _, s = min(found)
        i = cut.index(s)
        out.append((score[chunk[s : cut[i + 2]]], s, cut[i + 2]))
        del cut[i + 1]


def regular(piece: str, score: dict[str, float]) -> bool | None:
    """Whether merging the piece alone goes through ever lower scores; None: it is never formed.

    Before a piece is formed no merge crosses its ends, so inside it the merges run as if it
    stood alone. If that order falls for every piece, taking all edges once by score is exact.
    """
    got = replay(piece, score)
    if not got or got[-1][1:] != (0, len(piece)):
        return None
    s = [x[0] for x in got]
    return all(a > b for a, b in zip(s, s[1:], strict=False))


@lru_cache(maxsize=4)
def load(model: str = MODEL) -> Pieces:
    """Read a model file that SentencePiece can open; the driver does so once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for probe in ("a", " a  b ", "\ta\n", "\ufb01 \uff21 e\u0301"):
        if sp.decode(sp.encode(probe)) != probe or sp.encode("")  or sp.encode(probe, out_type=str)[0][:1] != SPACE:
            raise ValueError(f"{model} normalises texts or has no dummy prefix or byte pieces")
    ids, score, text, byte_ids = {}, {}, [], [-1] * 256
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            text.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unused(i):
            text.append(None)
        elif sp.is_unknown(i):
            text.append(" ⁇ ".encode())
        else:
            ids[p], score[p] = i, sp.get_score(i)
            text.append(p.encode())
    return make(ids, score, tuple(byte_ids), sp.unk_id(), tuple(text))


def make(ids: dict[str, int], score: dict[str, float], byte_ids: tuple[int, ...], unknown: int, text: tuple, bpe: bool | None = None) -> Pieces:
    """A table of one's own; BPE models are told by whole-numbered scores unless ``bpe`` says."""
    if bpe is None:
        bpe = all(s == int(s) for s in score.values())
    longer = [p for p in ids if len(p) > 1]
    odd: frozenset[str] = frozenset()
    if bpe:
        kinds = {p: regular(p, score) for p in longer}
        for p, k in kinds.items():
            if k is None:
                del ids[p]  # no merge ever forms it
        odd = frozenset(p for p, k in kinds.items() if k is False)
    pairs = frozenset(p[i : i + 2] for p in longer for i in range(len(p) - 1))
    return Pieces(ids, score, byte_ids, unknown, text, bpe, max(map(len, ids), default=1), pairs, odd)


def cut(column: pa.Array, pieces: Pieces) -> tuple[pa.Array, np.ndarray]:
    """All chunks of a column of texts, in order, and how many each text has. Texts get the dummy
    prefix, blanks become the space sign; '' and null have no chunks."""
    text = pc.fill_null(column, "")
    t = pc.replace_substring(pc.binary_join_element_wise(pc.if_else(pc.equal(text, ""), "", SPACE), text, ""), " ", SPACE)
    ends = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1].astype(np.int64)
    if not len(t) or ends[0] == ends[-1]:
        return pa.array([], pa.string()), np.zeros(len(t), np.int64)
    codes, at, _ = _characters(t)
    kind, joined = pieces.kinds
    k = kind[codes]
    first = np.r_[True, ~joined[k[:-1], k[1:]]]
    first[np.searchsorted(at, ends[:-1][ends[1:] > ends[:-1]] - ends[0])] = True
    starts = at[first]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts + ends[0], ends[-1]).astype(np.int32)), t.buffers()[2])
    return words, np.diff(np.searchsorted(starts, ends - ends[0]))


def _characters(t: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings of a column, where each begins in the column's bytes, the bytes."""
    off = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int32)
    data = np.frombuffer(t.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return codes, np.flatnonzero((data & 0xC0) != 0x80), data


def assemble(words: pa.Array, edges: tuple[np.ndarray, ...], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, how many each has). ``edges``: word, start, end, id of pieces on the words'
    paths; characters under none are pieces of their own or become byte pieces."""
    codes, at, data = _characters(words)
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    begin = np.searchsorted(at, off - off[0])
    size = np.diff(np.append(at, len(data)))
    value = pieces.single[codes]
    bare = value < 0
    byte_ids = np.array(pieces.byte_ids, np.int32)
    whole = byte_ids.min() >= 0
    count = np.where(bare & whole, size, 1)
    word, s, e, i = edges
    place = begin[word] + s
    value[place], bare[place], count[place] = i, False, 1
    under = np.zeros(len(codes) + 1, np.int32)
    np.add.at(under, place + 1, 1)
    np.add.at(under, place + e - s, -1)
    inside = np.cumsum(under[:-1]) > 0
    count[inside], bare[inside] = 0, False
    value[bare] = pieces.unknown
    out = np.repeat(value, count)
    ends = np.r_[0, np.cumsum(count)]
    if whole:
        for k in range(4):
            some = np.flatnonzero(bare & (size > k))
            out[ends[some] + k] = byte_ids[data[at[some] + k]]
    return out, np.diff(ends[begin])


def fold_words(words: pa.Array, which: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, ...]:
    """Edges (word, start, end, id) of the words at ``which`` by ``fold_long``."""
    got = [(k, *x) for k, w in zip(which.tolist(), words.take(pa.array(which, pa.int64())).to_pylist(), strict=True) for x in fold_long(w, pieces)]
    return tuple(np.array(got, np.int64).reshape(-1, 4).T)


def fold_long(chunk: str, pieces: Pieces) -> list[tuple[int, int, int]]:
    """The pieces of a chunk too long for a mask, or one with an odd piece: merges by a heap (BPE)
    or Viterbi over a list, linear in the text but for the heap."""
    import heapq

    n = len(chunk)
    if not pieces.bpe:
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        low = min(pieces.score.values(), default=0.0) - 10
        for i in range(n):
            for j in range(i + 1, min(n, i + pieces.longest) + 1):
                s = pieces.score.get(chunk[i:j]) if chunk[i:j] in pieces.ids else (low if j == i + 1 else None)
                if s is not None and best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, i
        out = []
        while n:
            if n - back[n] > 1:
                out.append((back[n], n, pieces.ids[chunk[back[n] : n]]))
            n = back[n]
        return out[::-1]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(s: int) -> None:
        m = nxt[s] if 0 <= s < n else n
        if m < n and (p := chunk[s : nxt[m]]) in pieces.ids:
            heapq.heappush(heap, (-pieces.score[p], s, nxt[m]))

    for s in range(n):
        offer(s)
    while heap:
        _, s, e = heapq.heappop(heap)
        if nxt[s] < 0 or nxt[s] >= n or nxt[nxt[s]] != e or nxt[s] == e:
            continue
        m = nxt[s]
        nxt[s], nxt[m] = e, -1
        if e < n:
            prv[e] = s
        offer(s)
        if prv[s] >= 0:
            offer(prv[s])
    out, s = [], 0
    while s < n:
        if nxt[s] - s > 1:
            out.append((s, nxt[s], pieces.ids[chunk[s : nxt[s]]]))
        s = nxt[s]
    return out


_START, _END, _RANK = 26, 20, 32  # bits of a packed edge: rank, start, end, id
_ODD = 1 << 19  # the highest bit of an id says that the piece is odd
_ID_MASK = _ODD - 1


def _merge_fold(edges: Column, n: Column) -> tuple:
    """The mask of boundaries that the merges leave, and a function from it to the pieces: edges
    are taken once by rank, then start; one is merged when its ends are boundaries and just one
    boundary lies between. Boundaries are bits of a long; edges are longs too, so sorting them
    is sorting numbers."""
    shifted = lambda x, i: F.call_function("shiftleft", F.lit(x).cast("long"), i)
    field = lambda x, k: F.shiftright(x, k).bitwiseAND(63).cast("int")
    inside = lambda x: shifted(1, field(x, _END)) - shifted(2, field(x, _START))
    ends = lambda m, x: (F.getbit(m, field(x, _START)) == 1) & (F.getbit(m, field(x, _END)) == 1)
    mask = F.aggregate(edges, F.bitwise_not(shifted(-1, n + 1)), lambda m, x: F.when(ends(m, x) & (F.bit_count(m.bitwiseAND(inside(x))) == 1), m.bitwiseAND(F.bitwise_not(inside(x)))).otherwise(m))
    return mask, lambda m: F.filter(edges, lambda x: ends(m, x) & (m.bitwiseAND(inside(x)) == 0))


def _viterbi_fold(edges: Column, n: Column, low: float) -> tuple:
    """Best path by total score; a character without a piece costs ``low``. Edges come by start."""
    step = "struct<score:double,back:int,id:int>"
    state = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i * low).alias("score"), (i - 1).alias("back"), F.lit(-1).alias("id")).cast(step))

    def take(best, x):
        s = F.get(best, x["s"])["score"] + x["score"]
        # all places from e on can at worst go on with unknown characters
        return F.when(s > F.get(best, x["e"])["score"], F.transform(best, lambda b, i: F.when(i == x["e"], F.struct(s.alias("score"), x["s"].alias("back"), x["id"].alias("id")).cast(step)).when((i > x["e"]) & (s + (i - x["e"]) * low > b["score"]), F.struct((s + (i - x["e"]) * low).alias("score"), (i - 1).alias("back"), F.lit(-1).alias("id")).cast(step)).otherwise(b))).otherwise(best)

    best = F.aggregate(edges, state, take)

    def walk(best):
        init = F.struct(n.alias("at"), F.array().cast("array<struct<s:int,e:int,id:int>>").alias("path"))
        return F.aggregate(F.sequence(F.lit(1), n), init, lambda st, _: F.when(st["at"] <= 0, st).otherwise(F.struct(F.get(best, st["at"])["back"].alias("at"), F.when(F.get(best, st["at"])["id"] < 0, st["path"]).otherwise(F.concat(F.array(F.struct(F.get(best, st["at"])["back"].alias("s"), st["at"].alias("e"), F.get(best, st["at"])["id"].alias("id"))), st["path"])).alias("path"))), lambda st: st["path"])

    return best, walk


def encode_chunks(words: DataFrame, pieces: Pieces, by: tuple[str, ...] = ("chunk",), n: Column | None = None) -> DataFrame:
    """(*by, path, odd): the pieces of each chunk, those of one character left out for BPE.

    ``words`` has distinct chunks of at most MASK characters, each with its own ``by``, and is
    partitioned by a subset of it, so that the group needs no shuffle of its own; ``n`` is the
    chunk's length, from ``by`` alone. Chunks without any edge give no row. ``odd``: the fold does
    not hold for this chunk, use ``fold_long``.
    """
    spark = words.sparkSession
    if len(pieces.text) > _ODD:
        raise ValueError(f"more than {_ODD} pieces")
    rows = [(p, i, -float(pieces.score[p])) for p, i in pieces.ids.items() if len(p) > 1 or not pieces.bpe]
    if pieces.bpe:
        rank = {c: k for k, c in enumerate(sorted({r[2] for r in rows}))}
        rows = [(p, (rank[c] << _RANK) | i | (_ODD if p in pieces.odd else 0), c) for p, i, c in rows]
    lookup = spark.createDataFrame(rows or [("", -1, 0.0)], "piece string, id long, cost double")
    length, n = F.length("chunk"), F.length("chunk") if n is None else n
    first = 2 if pieces.bpe else 1
    places = F.flatten(F.transform(F.sequence(F.lit(0), length - first), lambda s: F.transform(F.sequence(F.lit(first), F.least(F.lit(pieces.longest), length - s)), lambda k: F.struct(s.alias("s"), k.alias("k"), F.substring(F.col("chunk"), s + 1, k).alias("piece")))))
    sub = words.filter(length >= first).select(*by, F.explode(places).alias("x")).select(*by, "x.*")
    edges = sub.join(F.broadcast(lookup), "piece")  # the vocabulary: its size is the model's
    if pieces.bpe:
        packed = F.col("id").bitwiseOR(F.shiftleft(F.col("s").cast("long"), _START)).bitwiseOR(F.shiftleft((F.col("s") + F.col("k")).cast("long"), _END))
        grouped = edges.groupBy(*by).agg(F.sort_array(F.collect_list(packed)).alias("edges"))
        state, path = _merge_fold(F.col("edges"), n)
        odd = F.exists("edges", lambda x: x.bitwiseAND(_ODD) != 0)
        return grouped.withColumn("state", state).select(*by, path(F.col("state")).alias("path"), odd.alias("odd"))
    one = F.struct(F.col("s"), (F.col("s") + F.col("k")).alias("e"), (-F.col("cost")).alias("score"), F.col("id").cast("int").alias("id"))
    ordered = edges.groupBy(*by).agg(F.sort_array(F.collect_list(one)).alias("edges"))
    state, walk = _viterbi_fold(F.col("edges"), n, min(pieces.score.values(), default=0.0) - 10)
    packed = lambda x: x["id"].cast("long").bitwiseOR(F.shiftleft(x["s"].cast("long"), _START)).bitwiseOR(F.shiftleft(x["e"].cast("long"), _END))
    return ordered.withColumn("state", state).select(*by, F.transform(walk(F.col("state")), packed).alias("path"), F.lit(False).alias("odd"))


def unpack_path(path) -> list[tuple[int, int, int]]:
    """(start, end, id) of packed edges, by start."""
    return sorted((x >> _START & 63, x >> _END & 63, x & _ID_MASK) for x in path)


_ZSTD = "zstd"


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_ZSTD, asbytes=True)


def _unpack(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=n, codec=_ZSTD, asbytes=True) if n else b""


def _runs(shards: pa.Array, text: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, length) of stretches of one shard, of at most SLICE_CHARS bytes or one text."""
    code = shards.dictionary_encode().indices.to_numpy()
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]).tolist() if len(code) else []
    for a, b in zip(cuts, [*cuts[1:], len(code)], strict=True):
        while a < b:
            k = max(a + 1, min(b, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE_CHARS, side="right"))))
            yield a, k - a
            a = k


def _blob(words: list[str]) -> bytes:
    return _pack(" ".join(sorted(words)).encode("utf-8"))  # no chunk has a blank


def _of_blob(blob: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([_unpack(blob).decode("utf-8")], pa.string()), " ").flatten()


class _Distinct:
    """Distinct strings of arrays that come one by one; sorted at the end, so always the same."""

    def __init__(self):
        self.got, self.new, self.n = pa.array([], pa.string()), [], 0

    def add(self, words: pa.Array) -> None:
        self.new.append(words)
        self.n += len(words)
        if self.n > 100_000 + 2 * len(self.got):
            self._fold()

    def _fold(self) -> None:
        self.got, self.new, self.n = pc.unique(pa.concat_arrays([self.got, *self.new])), [], 0

    def done(self) -> pa.Array:
        self._fold()
        return self.got.take(pc.sort_indices(self.got))


def _shard_file(shard: str) -> str:
    return hashlib.sha1(shard.encode()).hexdigest() + ".arrow"


def _fs(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _sharded(docs: DataFrame) -> DataFrame:
    """``docs`` with __shard; what is not a plain scan of files is written to the shared folder first."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    name = plan.getClass().getSimpleName()
    while name in ("Project", "Filter") and plan.children().size() == 1:
        plan = plan.children().apply(0)
        name = plan.getClass().getSimpleName()
    if name == "LogicalRelation":
        try:
            return docs.withColumn("__shard", _place())
        except AnalysisException:  # a relation without files
            pass
    return materialize(docs, "sp-docs").withColumn("__shard", _place())


def _place() -> Column:
    return F.concat_ws("#", F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / SHARD_ROWS))


def encode(docs: DataFrame, text: str = "text", model: str | Pieces = MODEL, keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>): what SentencePiece gives for each whole text.

    Null and empty texts have no ids. Rows, their other columns (or only ``keep``) and repeated
    rows stay. ``digest`` adds decoded_sha256, of the text that the ids decode to, in the same pass.
    """
    pieces = load(model) if isinstance(model, str) else model
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c != "ids" and not (digest and c == "decoded_sha256")]
    read = [*kept, text] if text not in kept else kept
    src = _sharded(docs.select(*[docs[c] for c in read]))
    shared = spark.sparkContext.broadcast(pieces)
    parts = max(12, math.ceil(math.sqrt(docs.count()) / 3))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        p = shared.value

        def send(shard: str, words: pa.Array) -> pa.RecordBatch:
            deal: list[list[str]] = [[] for _ in range(parts)]
            for w in words.filter(pc.less_equal(pc.utf8_length(words), LONG)).to_pylist():
                deal[xxhash.xxh32_intdigest(w) % parts].append(w)
            some = [(k, _blob(d)) for k, d in enumerate(deal) if d]
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(some), pa.string()), pa.array([k for k, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], names=["shard", "part", "chunks"])

        shard, words = None, _Distinct()
        for big in batches:
            for at in _runs(big["__shard"], big["text"]):
                b = big.slice(*at)
                if (name := b["__shard"][0].as_py()) != shard:
                    if shard is not None:
                        yield send(shard, words.done())
                        trim()
                    shard, words = name, _Distinct()
                words.add(pc.unique(cut(b["text"], p)[0]))
        if shard is not None:
            yield send(shard, words.done())
        trim()

    asked = materialize(src.select("__shard", F.col(text).alias("text")).mapInArrow(ask, "shard string, part int, chunks binary"), "sp-asked")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct chunks of each part that need a lattice; key: number in the part, length."""

        def rows(part: int, words: pa.Array) -> Iterator[pa.RecordBatch]:
            n = pc.utf8_length(words).to_numpy()
            some = np.flatnonzero((n <= MASK) & (n > 1 if p.bpe else n > 0))
            for i in range(0, len(some), 20_000):
                at = some[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at << 6 | n[at]), words.take(pa.array(at))], names=["part", "key", "chunk"])

        p, part, words = shared.value, -1, _Distinct()
        for b in batches:
            for k, blob in zip(b["part"].to_pylist(), b["chunks"], strict=True):
                if k != part:
                    yield from rows(part, words.done())
                    part, words = k, _Distinct()
                words.add(_of_blob(blob.as_py()))
        yield from rows(part, words.done())
        del words
        trim()

    words = asked.select("part", "chunks").repartition("part").sortWithinPartitions("part").mapInArrow(spell, "part int, key long, chunk string")
    paths = encode_chunks(words.repartition("part"), pieces, ("part", "key"), F.col("key").bitwiseAND(63).cast("int"))

    wide = np.uint16 if len(pieces.text) < 1 << 16 else np.int32  # ids in the tables of chunks

    def answer(asked_t: pa.Table, paths_t: pa.Table) -> pa.Table:
        p, blobs = shared.value, asked_t["chunks"]
        distinct = _Distinct()
        for b in blobs:
            distinct.add(_of_blob(b.as_py()))
        words = distinct.done()
        usual = paths_t.filter(pc.invert(paths_t["odd"])).combine_chunks()
        path = usual["path"].combine_chunks() if usual.num_rows else pa.array([], pa.list_(pa.int64()))
        packed = path.flatten().to_numpy(zero_copy_only=False)
        word = np.repeat(usual["key"].to_numpy() >> 6, pc.list_value_length(path).to_numpy(zero_copy_only=False))
        other = np.r_[paths_t.filter(paths_t["odd"])["key"].to_numpy() >> 6, np.flatnonzero(pc.utf8_length(words).to_numpy() > MASK)]
        own = (word, packed >> _START & 63, packed >> _END & 63, packed & _ID_MASK)
        ids, sizes = assemble(words, tuple(np.r_[a, b] for a, b in zip(own, fold_words(words, other, p), strict=True)), p)
        ids, starts = ids.astype(wide), np.cumsum(sizes) - sizes
        out: dict[str, list] = {"sizes": [], "ids": []}
        held: list[pa.Array] = []
        for k, b in enumerate(blobs):  # looked up many at once, as a look-up hashes all words of the part
            held.append(_of_blob(b.as_py()))
            if k + 1 < len(blobs) and sum(map(len, held)) < 100_000 + 2 * len(words):
                continue
            code = pc.index_in(pa.concat_arrays(held), value_set=words).to_numpy()
            for one in np.split(code, np.cumsum([len(x) for x in held])[:-1]):
                n = sizes[one]
                out["sizes"].append(_pack(n.astype(np.uint16).tobytes()))
                out["ids"].append(_pack(ids[_ranges(starts[one], n)].tobytes()))
            held = []
        made = pa.table({"shard": asked_t["shard"], "chunks": blobs} | {k: pa.array(v, pa.binary()) for k, v in out.items()})
        del words, usual, path, packed, out, held
        trim()
        return made

    schema = "shard string, chunks binary, sizes binary, ids binary"
    answers = asked.groupBy("part").cogroup(paths.groupBy("part")).applyInArrow(answer, schema)
    folder = fresh_path(spark, "sp-tables")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        shard, out, sink, temp, names = None, None, None, "", []

        def done() -> None:
            out.close()
            sink.close()
            fs.move(temp, f"{root}/{_shard_file(shard)}")  # a repeated task writes the same again
            names.append(shard)

        for b in batches:
            at = b["shard"].to_pylist()
            i = 0
            while i < len(at):
                j = i
                while j < len(at) and at[j] == at[i]:
                    j += 1
                if at[i] != shard:
                    if out is not None:
                        done()
                    shard, temp = at[i], f"{root}/{uuid.uuid4().hex}.tmp"
                    sink = fs.open_output_stream(temp, compression=None)
                    out = pa.ipc.new_stream(sink, b.schema)
                out.write_batch(b.slice(i, j - i))
                i = j
        if out is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["shard"])

    answers.repartition("shard").sortWithinPartitions("shard").mapInArrow(store, "shard string").agg(F.count("*")).collect()
    drop(asked)

    at_text = read.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, (fs, root) = shared.value, _fs(folder)
        shard, tables = None, None

        def open_shard(name: str):
            words, sizes, ids = [pa.array([], pa.string())], [np.zeros(0, np.uint16)], [np.zeros(0, wide)]
            file = f"{root}/{_shard_file(name)}"
            if fs.get_file_info(file).is_file:
                with fs.open_input_stream(file, compression=None) as f:
                    for b in pa.ipc.open_stream(f):
                        for c, s, i in zip(*(b[k].to_pylist() for k in ("chunks", "sizes", "ids")), strict=True):
                            words.append(_of_blob(c))
                            sizes.append(np.frombuffer(_unpack(s), np.uint16))
                            ids.append(np.frombuffer(_unpack(i), wide))
            n = np.concatenate(sizes).astype(np.int64)
            return pa.concat_arrays(words), n, np.concatenate(ids).astype(np.int32), np.cumsum(n) - n

        for big in batches:
            for at in _runs(big["__shard"], big.column(at_text)):
                b = big.slice(*at)
                if (name := b["__shard"][0].as_py()) != shard:
                    shard, tables = name, None
                    tables = open_shard(name)
                words, sizes, ids, starts = tables
                values, per_doc = cut(b.column(at_text), p)
                values = values.dictionary_encode()
                found = pc.index_in(values.dictionary, value_set=words)
                if found.null_count:  # chunks beyond LONG: encoded here
                    extra = values.dictionary.filter(found.is_null())
                    if pc.min(pc.utf8_length(extra)).as_py() <= LONG:
                        raise RuntimeError(f"no table entry for a chunk of {shard}")
                    more, n_more = assemble(extra, fold_words(extra, np.arange(len(extra)), p), p)
                    code = found.to_numpy(zero_copy_only=False)
                    code = np.where(np.isnan(code), len(sizes) + np.cumsum(np.isnan(code)) - 1, code).astype(np.int64)
                    sizes, ids = np.r_[sizes, n_more], np.r_[ids, more]
                    starts = np.cumsum(sizes) - sizes
                else:
                    code = found.to_numpy(zero_copy_only=False).astype(np.int64)
                code = code[values.indices.to_numpy()]
                n = sizes[code]
                offsets = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(per_doc)]].astype(np.int32)
                flat = ids[_ranges(starts[code], n)]
                out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if digest:
                    out.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decode_ids(flat, offsets, p)]))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *out], names=names)
        tables = None
        trim()

    names = [*kept, "ids"] + ["decoded_sha256"] * digest
    out_schema = docs.select(*kept).schema.add("ids", ArrayType(IntegerType()))
    return src.select(*read, "__shard").mapInArrow(apply, out_schema.add("decoded_sha256", "string") if digest else out_schema)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the lengths ``n``."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)


def decode_ids(flat: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> list[str]:
    """Texts of lists of ids: piece bytes are gathered by numpy into one buffer."""
    table_ = [x or b"" for x in pieces.text]
    size = np.array([len(x) for x in table_])
    data = np.frombuffer(b"".join(table_), np.uint8)
    start = np.cumsum(size) - size
    n = size[flat]
    ends = np.cumsum(n)
    buf = data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[flat] - (ends - n), n)].tobytes()
    cut = np.r_[0, ends][offsets]
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        t = buf[a:b].decode("utf-8", "replace").replace(SPACE, " ")
        out.append(t[1:] if t.startswith(" ") else t)
    return out


def decode(encoded: DataFrame, ids: str = "ids", into: str = "decoded", model: str | Pieces = MODEL) -> DataFrame:
    """``encoded`` with the text of its ids; null ids give a null text."""
    pieces = load(model) if isinstance(model, str) else model
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    kept = [c for c in encoded.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                col = b[ids]
                got = decode_ids(*_lists(col), shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t if ok else None for t, ok in zip(got, col.is_valid().to_pylist(), strict=True)], pa.string())], names=[*kept, into])

    return encoded.select(*[encoded[c] for c in kept]).mapInArrow(run, encoded.select(*kept).schema.add(into, "string"))


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)]


def unigram(pieces: Pieces) -> Pieces:
    """The same pieces as a unigram model: by Zipf's law the score of a piece is minus the log of its
    place in the table plus its length's share, so that longer pieces are worth their characters."""
    place = {p: k for k, p in enumerate(sorted(pieces.ids, key=pieces.ids.get), 1)}
    return make(dict(pieces.ids), {p: -math.log(k + 10) - 1.0 / len(p) for p, k in place.items()}, pieces.byte_ids, pieces.unknown, pieces.text, bpe=False)


def sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the Viterbi fold: a row each with the number of pieces and what they decode to."""
    got = encode(table(spark, sf_dir, "documents"), model=unigram(load(MODEL)), keep=["doc_id"], digest=True)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every row of documents and the digest of the text they decode to: the text itself, with
    the space sign as a blank. Null and empty texts have no ids; repeated rows stay; none give none."""
    got = encode(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "sentencepiece_unigram": sentencepiece_unigram}
SQL: dict[str, str] = {}
