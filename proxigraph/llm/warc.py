"""WARC archives with a two-level capture index.

Writing: each task writes gzip-per-record archives and returns where its records lie. The
captures are sorted by reversed-host URL key into index shards: compressed blocks of lines,
and a sparse directory with the first key of each block at the shard's end. Looking up:
keys are dealt to shards, a binary search in the directory finds the block, one in the block
finds the line, and records are fetched by range reads, neighbours in one read.

Archive and index files go to the folder that all executors share. A repeated task writes
files of its own; only those of the attempt that succeeded are ever referred to.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.plans.session import table
from proxigraph.plans.shared import fresh_path, materialize

MIN_REVISIT = 100  # bytes of payload from which equal ones become revisits
ARCHIVE_BYTES = 256 << 20  # an archive file is closed once it is larger
BLOCK_LINES = 512
FETCH_BYTES = 64 << 20  # bytes of records that a task fetches, more or less
READ_BYTES = 8 << 20  # neighbouring records are read together up to this size
MAX_SHARDS = 200_000  # index shards whose first keys the driver hands out, some MB at most
DATE = "1970-01-01T00:00:00Z"

CAPTURES = "k string, file string, at long, size long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://m.a.org:80/x?q#f`` gives ``org,a,m)/x?q``. Null or no host: as it is."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url or "")
    if not m or not m[1]:
        return url or ""
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return ",".join(reversed(m[1].lower().split("."))) + port + ")" + (m[3] or "/")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts by URL key, then page."""
    return f"{surt(url)} {0 if page_id is None else page_id + (1 << 63) + 1:020d}"


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head of its capture and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of RECORDS. The digest of a response is taken from its payload and must agree
    with the record's own; a revisit gives size and digest of the full payload from its heads."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")
    told, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != told):
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    return {"page_id": number(h["WARC-Record-ID"]), "url": _unclean(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None, "record_type": h["WARC-Type"],
            "refers_to": number(h.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": told, "payload": None if revisit else payload}


def _fs(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


@dataclass
class Archive:
    """A folder of archives and its index. ``shards``: file, first key, line count and record bytes of each."""

    folder: str
    shards: DataFrame


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to). Of equal payloads of at least MIN_REVISIT bytes
    the least page_id is the response; repeated rows with that id are responses too."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= MIN_REVISIT
    same = p.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = same.filter((F.col("n") > 1) & F.col("first").isNotNull()).select(F.col("digest").alias("same"), "first")
    # Short payloads refer to nothing; each gets a key of its own, so that '' is not one hot key.
    key = F.when(long, F.col("digest")).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url", "payload"))))
    return p.withColumn("same", key).join(same, "same", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, block_lines: int = BLOCK_LINES, archive_bytes: int = ARCHIVE_BYTES) -> Archive:
    """Write a record for each row of ``pages`` and index it.

    Reads page_id, url and html; other columns, whatever their names, are not looked at. Null html:
    an empty payload. Null url: no target. Null page_id: a record without number that nothing refers
    to. Repeated rows give repeated records. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        out, name, at = None, "", 0
        for b in batches:
            rows: dict[str, list] = {"k": [], "file": [], "at": [], "size": []}
            for i, url, payload, digest, ref in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = z.compress(record(i, url, payload, digest, ref)) + z.flush()
                out.write(member)
                for c, v in zip(rows, (capture_key(url, i), name, at, len(member)), strict=True):
                    rows[c].append(v)
                at += len(member)
                if at >= archive_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("k", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))
        if out is not None:
            out.close()

    captures = materialize(plan_records(pages).mapInArrow(archives, CAPTURES), "warc-captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        lines: list[str] = []
        directory: list = []
        out, at, n, size, name = None, 0, 0, 0, f"{uuid.uuid4().hex}.idx"

        def flush() -> int:
            block = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            out.write(block)
            directory.append((json.loads(lines[0])[0], at, len(block), len(lines)))
            lines.clear()
            return len(block)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(json.dumps(row))
                n, size = n + 1, size + row[3]
                if len(lines) == block_lines:
                    at += flush()
        if out is not None:
            if lines:
                at += flush()
            sparse = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(sparse + struct.pack("<QQ", at, len(sparse)))
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [name], "first": [directory[0][0]], "n": [n], "bytes": [size]}, schema=pa.schema([("shard", pa.string()), ("first", pa.string()), ("n", pa.int64()), ("bytes", pa.int64())]))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.repartitionByRange(parts, "k").sortWithinPartitions("k")
    return Archive(folder, materialize(ordered.mapInArrow(index, "shard string, first string, n long, bytes long"), "warc-shards"))


class _Shard:
    """One open index shard; keys are asked for in ascending order."""

    def __init__(self, fs, path: str):
        self.f = fs.open_input_file(path)
        size = self.f.size()
        self.f.seek(size - 16)
        at, n = struct.unpack("<QQ", self.f.read(16))
        self.f.seek(at)
        self.directory = json.loads(zlib.decompress(self.f.read(n)))
        self.firsts = [d[0] for d in self.directory]
        self.block, self.keys, self.lines = -1, [], []

    def find(self, key: str):
        """All lines with this key; repeated rows may go over several blocks."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            if i != self.block:
                _, at, n, _ = self.directory[i]
                self.f.seek(at)
                self.lines = [json.loads(x) for x in zlib.decompress(self.f.read(n)).decode("utf-8", "surrogatepass").split("\n")]
                self.keys, self.block = [x[0] for x in self.lines], i
            yield from self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]
            i += 1


def lookup(archive: Archive, captures: DataFrame) -> DataFrame:
    """Where the captures (url, page_id) lie: (k, file, at, size), a row per record found.

    Each distinct key is asked for once: captures that differ in scheme, port 80 or 443, user,
    case of the host or fragment alone have one key, and what lies under it comes once. Those
    that the archive does not have give no row. A null url counts as ''; other columns are not read.
    """
    spark = captures.sparkSession
    known = archive.shards.orderBy("first", "shard").limit(MAX_SHARDS + 1).collect()
    if len(known) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} index shards: write with fewer partitions")
    firsts, names, folder = [x.first for x in known], [x.shard for x in known], archive.folder
    shared = spark.sparkContext.broadcast((firsts, names))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, _ = shared.value
        for b in batches:
            out: dict[str, list] = {"shard": [], "k": []}
            for url, i in zip(b["url"].to_pylist(), b["page_id"].to_pylist(), strict=True):
                k = capture_key(url, i)
                for s in range(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)):
                    out["shard"].append(s)
                    out["k"].append(k)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("shard", pa.int32()), ("k", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, names), (fs, root) = shared.value, _fs(folder)
        at, shard = -1, None
        for b in batches:
            out: dict[str, list] = {"k": [], "file": [], "at": [], "size": []}
            for s, k in zip(b["shard"].to_pylist(), b["k"].to_pylist(), strict=True):
                if s != at:
                    at, shard = s, _Shard(fs, f"{root}/{names[s]}")
                for line in shard.find(k):
                    for c, v in zip(out, line, strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("k", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))

    asked = captures.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id"))
    # The shard groups the keys for reading; a key lies in one task, so duplicates fall there without another shuffle.
    dealt = asked.mapInArrow(deal, "shard int, k string").repartition("shard").dropDuplicates(["shard", "k"]).sortWithinPartitions("shard", "k")
    return dealt.mapInArrow(search, CAPTURES)


def fetch(archive: Archive, places: DataFrame, payload: bool = True) -> DataFrame:
    """The records at ``places`` (file, at, size) as RECORDS, by range reads in order of the files.

    Tasks are dealt stretches of READ_BYTES of a file, as many tasks as the archives' bytes ask for:
    the places themselves are too small to tell. A null payload: a revisit, or not asked for.
    """
    folder = archive.folder
    spark = places.sparkSession
    size = archive.shards.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FETCH_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        name, f = None, None
        for b in batches:
            rows = list(zip(*(b[c].to_pylist() for c in ("file", "at", "size")), strict=True))
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")}
            i = 0
            while i < len(rows):
                j, start, end = i + 1, rows[i][1], rows[i][1] + rows[i][2]
                while j < len(rows) and rows[j][0] == rows[i][0] and rows[j][1] == end and end - start < READ_BYTES:
                    end += rows[j][2]
                    j += 1
                if rows[i][0] != name:
                    name, f = rows[i][0], fs.open_input_file(f"{root}/{rows[i][0]}")
                f.seek(start)
                data = memoryview(f.read(end - start))
                for _, at, size in rows[i:j]:
                    got = parse(zlib.decompress(data[at - start : at - start + size], 31))
                    for k, v in got.items():
                        out[k].append(v if payload or k != "payload" else None)
                i = j
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

    order = places.select("file", "at", "size").repartition(parts, F.col("file"), F.floor(F.col("at") / READ_BYTES)).sortWithinPartitions("file", "at")
    return order.mapInArrow(read, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page, as the archives say after writing and reading back; see ``write`` for nulls and
    repeated rows. Of equal payloads of 100 bytes or more the least page_id is the response."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = write(pages)
    return fetch(archive, lookup(archive, pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

QUERIES = {"op4_warc": op4_warc}
SQL = {"op4_warc": OP4_SQL}
