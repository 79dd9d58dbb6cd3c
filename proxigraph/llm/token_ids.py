"""Token ids as binary files: documents in ascending doc_id order, ids range-coded in blocks.

A file is ``RCIDS002`` and a row of segments. A segment holds whole documents: its magic, the number of
documents, of ids and of blocks, the lengths of its tables, and a CRC-32 of all that and the tables; a
zlib table of documents (doc_id, whether it is null, number of ids), one of blocks (ids, bytes,
CRC-32 of the payload, CRC-32 of the ids) and one of the ids and their frequencies; then the payloads (see
``range_coder``). Numbers are little-endian. Every task sorts a range of documents and writes one file; the table of
segments that it returns is written before it is used, so files of repeated tasks are never read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.llm.range_coder import BLOCK, LANES, Orders, decode, encode
from proxigraph.llm.word_table import WordTable
from proxigraph.plans.session import table
from proxigraph.plans.shared import fresh_path, materialize

END = 2  # the id that ends a document
MAGIC, SEGMENT = b"RCIDS002", b"SEGM"
HEAD = struct.Struct("<4sIQIIIII")  # magic, documents, ids, blocks, bytes of the three tables, CRC-32 of them
DOCS = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])
BLOCKS = np.dtype([("n", "<u4"), ("size", "<u4"), ("crc", "<u4"), ("ids_crc", "<u4")])
SEGMENT_IDS = BLOCK * LANES  # a segment ends with the document that reaches so many
READERS = 1 << 14  # tasks that read segments, at most; more segments are several a task
CACHE, LONG = 1 << 18, 32  # words remembered for single texts, characters of those that are not
AT_ONCE = 1 << 20  # bytes of texts that are cut together, at least one text

#: Letters of every version of Unicode. In texts of these, printable ASCII, blanks and line ends the byte-level
#: pattern's classes are beyond doubt, so Python finds the same words as the tokenizer.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-џ一-龥"
OTHER = re.compile(f"[^\t\n\r -~{LETTERS}]")
WORD = re.compile(f" ?[{LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\\s0-9{LETTERS}]+|\\s+(?!\\S)|\\s+")

#: The byte-level alphabet: bytes that can be printed stand for themselves, the others for U+0100 and on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - PRINTED))}
ALPHABET = np.array([BYTES.get(b, b) for b in range(256)], "<u2")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian bytes by the tokenizers library, end id included.

    Where the tokenizer cuts texts by the byte-level pattern, the library's model encodes every different word
    once while it is remembered: by a ``WordTable`` where many texts come, else of CACHE words those of the last half
    found, at least. Texts with other characters or an added token go to the library whole, as does every text of another tokenizer."""

    def __init__(self, path: str, end: int = END):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.known, self.before = Tokenizer.from_file(path), struct.pack("<I", end), {}, {}
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec["added_tokens"]]
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.words = bool(usual) and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")) and not spec["model"].get("dropout")
        self.table: WordTable | None = None

    def _model(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of words, and how many each has."""
        text = ALPHABET[np.frombuffer(b"".join(words), np.uint8)].tobytes().decode("utf-16-le")
        size = [*map(len, words)]
        tokens = [self.model.tokenize(text[z - n : z]) for n, z in zip(size, accumulate(size), strict=True)]
        return [*map(attrgetter("id"), chain.from_iterable(tokens))], [*map(len, tokens)]

    def _word(self, word: str) -> bytes:
        """The ids of a word, which is remembered unless it is long."""
        got = self.known.get(word) or self.before.get(word)
        if got is None:
            ids, _ = self._model([word.encode()])
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONG:
            if len(self.known) >= CACHE // 2:
                self.before, self.known = self.known, {}
            self.known[word] = got
        return got

    def __call__(self, text: str) -> bytes:
        if not self.words or OTHER.search(text) or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end
        words = WORD.findall(text)
        out = [*map(self.known.get, words)]
        if None in out:
            word = self._word
            out = [word(w) if x is None else x for w, x in zip(words, out, strict=True)]
        return b"".join(out) + self.end

    def many(self, texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of texts without nulls, some at a time in their order."""
        odd = pc.match_substring_regex(texts, OTHER.pattern) if self.words else pa.array([True] * len(texts), pa.bool_())
        for t in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = odd.to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        stop = np.cumsum(size)
        turn = np.r_[np.flatnonzero(odd[1:] != odd[:-1]) + 1, len(odd)]
        if self.words and self.table is None:
            self.table = WordTable(self._model, struct.unpack("<I", self.end)[0])
        i = 0
        while i < len(odd):
            z = int(turn[np.searchsorted(turn, i, "right")])
            z = min(z, max(i + 1, int(np.searchsorted(stop, stop[i] - size[i] + AT_ONCE, "right"))))
            some = texts.slice(i, z - i)
            if odd[i]:
                got = [np.frombuffer(self(t), "<u4") for t in some.to_pylist()]
                yield np.concatenate(got), np.array([*map(len, got)])
            else:
                offsets, data = some.buffers()[1:]
                first = int(np.frombuffer(offsets, "<i8" if pa.types.is_large_string(some.type) else "<i4")[some.offset])
                own = np.frombuffer(data, np.uint8)[first : first + int(size[i:z].sum())] if data else np.zeros(0, np.uint8)
                yield self.table.ids(own, size[i:z])
            i = z


@lru_cache(maxsize=1)
def _encoder(path: str, end: int) -> Encoder:
    """One for all tasks of a Python worker, so that words are not learnt anew."""
    return Encoder(path, end)


def _filesystem(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def pack(docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    """A segment: ``docs`` are (doc_id, number of ids), ``ids`` those of all of them."""
    coded = encode(ids)
    own = np.zeros(len(docs), DOCS)
    own["doc_id"], own["null"], own["n"] = [d or 0 for d, _ in docs], [d is None for d, _ in docs], [n for _, n in docs]
    blocks, at = np.zeros(len(coded), BLOCKS), 0
    for k, (n, _, payload) in enumerate(coded):
        blocks[k] = (n, len(payload), zlib.crc32(payload), zlib.crc32(ids[at : at + n].astype("<u4").tobytes()))
        at += n
    tables = zlib.compress(own.tobytes(), 6), zlib.compress(blocks.tobytes(), 6), coded[0][1].pack() if coded else b""
    counts = (SEGMENT, len(docs), len(ids), len(coded), *map(len, tables))
    crc = zlib.crc32(b"".join([HEAD.pack(*counts, 0), *tables]))
    return b"".join([HEAD.pack(*counts, crc), *tables, *[b[2] for b in coded]])


def unpack(data: bytes) -> tuple[list[tuple[int | None, int]], np.ndarray]:
    """What ``pack`` got. ValueError where anything is not as written."""
    if len(data) < HEAD.size:
        raise ValueError("the segment is cut short")
    *counts, a, b, c, crc = HEAD.unpack_from(data)
    places = np.cumsum([HEAD.size, a, b, c]).tolist()
    tables = [data[p:z] for p, z in pairwise(places)]
    if counts[0] != SEGMENT or zlib.crc32(b"".join([HEAD.pack(*counts, a, b, c, 0), *tables])) != crc:
        raise ValueError("the segment's tables are damaged")
    own, blocks = np.frombuffer(zlib.decompress(tables[0]), DOCS), np.frombuffer(zlib.decompress(tables[1]), BLOCKS)
    coded, at, orders = [], places[-1], Orders.unpack(tables[2]) if c else None
    for k, x in enumerate(blocks):
        payload = data[at : at + int(x["size"])]
        at += int(x["size"])
        if len(payload) != x["size"] or zlib.crc32(payload) != x["crc"]:
            raise ValueError(f"block {k} is damaged")
        coded.append((int(x["n"]), orders, payload))
    ids, at = decode(coded).astype("<u4"), 0
    for k, x in enumerate(blocks):
        if zlib.crc32(ids[at : at + int(x["n"])].tobytes()) != x["ids_crc"]:
            raise ValueError(f"block {k} does not give the ids it was made of")
        at += int(x["n"])
    return [(None if x["null"] else int(x["doc_id"]), int(x["n"])) for x in own], ids


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", end: int = END, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the ids of all documents as files in ``folder`` and return the table of segments:
    (shard, file, at, size, before, n_ids): ``before`` counts the ids of the file's segments before it.

    Files in order of shard, segments in order of ``at`` hold documents by ascending doc_id, null first; rows
    of one doc_id follow each other by a hash of their text. A null text is an empty one."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]  # rows of one id may fill several files
    ranged = rows.select("doc_id", "text", order[1].alias("h"), order[2].alias("r")).repartitionByRange("doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r").select("doc_id", "text")
    names = ["shard", "file", "at", "size", "before", "n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        shard, encoder, out, at, before = TaskContext.get().partitionId(), _encoder(path, end), None, 0, 0
        name = f"ids-{shard:06d}-{uuid.uuid4().hex}.rcids"
        own, held, n = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, at, before, own, held, n
            if out is None:
                fs.create_dir(root, recursive=True)
                out, at = fs.open_output_stream(f"{root}/{name}", compression=None), len(MAGIC)
                out.write(MAGIC)
            data = pack(own, np.concatenate(held))
            out.write(data)
            row = pa.RecordBatch.from_pydict(dict(zip(names, ([shard], [name], [at], [len(data)], [before], [n]), strict=True)))
            at, before = at + len(data), before + n
            own, held, n = [], [], 0
            return row

        for b in batches:
            doc_ids, i = b["doc_id"].to_pylist(), 0
            for ids, size in encoder.many(b["text"]):
                stop, k = np.cumsum(size), 0
                while k < len(size):
                    had = int(stop[k - 1]) if k else 0
                    z = min(len(size), int(np.searchsorted(stop, had + segment_ids - n)) + 1)
                    own += zip(doc_ids[i : i + z - k], size[k:z].tolist(), strict=True)
                    held.append(ids[had : stop[z - 1]])
                    n, i, k = n + int(stop[z - 1]) - had, i + z - k, z
                    if n >= segment_ids:
                        yield flush()
        if own:
            yield flush()
        if out is not None:
            out.close()

    return materialize(ranged.mapInArrow(run, "shard long, file string, at long, size long, before long, n_ids long"), "token-segments")


def read(segments: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``write``: ``start`` counts
    the ids of all documents before it. A task reads one segment after the other."""
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    todo = segments.join(files, "shard").select("file", "at", "size", (F.col("offset") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for b in batches:
            for row in b.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{row['file']} is no file of token ids")
                    f.seek(row["at"])
                    data = f.read(row["size"])
                docs, ids = unpack(data)
                n = np.array([x for _, x in docs], np.int64)
                stop = np.cumsum(n)
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip((stop - n).tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(row["start"] + stop - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = min(READERS, max(1, segments.count()))  # told, as rows this small would be put into one task
    return todo.repartition(parts, "file", "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through files of token ids and back. A null text is an empty one: its only id is the
    end. Repeated rows stand as often as in the table, by a hash of the text where ids are equal; a null
    doc_id comes first. An empty table gives no files and no rows."""
    folder = fresh_path(spark, "token-ids")
    return read(write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder), folder)


QUERIES = {"op13_token_ids": op13_token_ids}
SQL: dict[str, str] = {}  # tokenizers are beyond SQL; tests/llm/test_token_ids.py reads every id back
