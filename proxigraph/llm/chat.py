"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation; for each Arrow batch the lengths of headers, contents and
footers give cumulative offsets, and numpy scatters all pieces into one preallocated buffer
that becomes the Arrow string column. No Python string is built for a turn.

Template, per turn: ``<s>[INST] role [/INST]\\n`` content ``</s>\\n``. Control strings inside a
role or a content get a backslash after their first character, those that hold backslashes
there one more, so that every text can be read back and none can forge a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.plans.session import table

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>\n"
_ESCAPE, _ESCAPED = r"([<\[])(\\*/?(?:s>|INST\]))", r"\1\\\2"
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.S)
_UNESCAPE = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")

SCHEMA = "conv_id long, formatted string, loss array<struct<start:int,end:int>>"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column.cast(pa.string()), ""), _ESCAPE, _ESCAPED)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), off


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array, loss: np.ndarray) -> tuple[pa.Array, np.ndarray, list, np.ndarray]:
    """Formatted string of each run of equal ``conv`` numbers. Returns the strings, the number of
    each run's first row, its loss spans in code points and its length in code points."""
    n = len(conv)
    parts = [pa.array([OPEN] * n), escape(role), pa.array([MIDDLE] * n), escape(text), pa.array([CLOSE] * n)]
    raw = [_bytes(p) for p in parts]
    size = np.stack([np.diff(off) for _, off in raw], axis=1)  # rows x parts, in bytes
    chars = np.stack([pc.utf8_length(p).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts], axis=1)
    at = np.zeros(size.size + 1, np.int64)
    np.cumsum(size.ravel(), out=at[1:])
    out = np.empty(at[-1], np.uint8)
    for k, (data, off) in enumerate(raw):
        start = at[:-1].reshape(n, -1)[:, k]
        src = np.arange(off[0], off[-1])
        # scatter index: position in the column, moved by where its row's piece starts
        out[src + np.repeat(start - off[:-1], size[:, k])] = data[off[0] : off[-1]]
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if n else np.zeros(0, np.int64)
    ends = at[:: size.shape[1]]
    offsets = np.r_[ends[first], ends[-1]] if n else np.zeros(1, np.int64)
    strings = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.data)]) if n else pa.array([], pa.large_string())
    total = np.concatenate([[0], np.cumsum(chars.sum(axis=1))])
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    begin = total[:-1] - total[first][run] + chars[:, :3].sum(axis=1)
    end = begin + chars[:, 3]
    spans: list[list[dict]] = [[] for _ in first]
    for i in np.flatnonzero(loss):
        spans[run[i]].append({"start": int(begin[i]), "end": int(end[i])})
    return strings, first, spans, np.diff(np.r_[total[first], total[-1]])


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; loss spans are code points of
    ``formatted``, one for each turn of ``loss_role``, before escapes are taken back.

    Turns go by turn, then role and text, nulls first; null texts and roles count as empty;
    repeated rows are turns of their own; rows with a null conv_id form one conversation.
    Other columns are not read. A conversation is one value and so stays in one task; tasks
    hold one Arrow batch and the conversation that spans its end.
    """
    src = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b["conv_id"].to_pylist()
            if held and held[-1]["conv_id"][-1].as_py() == ids[0] == ids[-1]:
                held.append(b)  # still the same conversation
                continue
            cut = len(ids)
            while cut > 0 and ids[cut - 1] == ids[-1]:
                cut -= 1
            if cut:
                yield from done([*held, b.slice(0, cut)])
                held = [b.slice(cut)]
            else:
                yield from done(held)
                held = [b]
        yield from done(held)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, role, text = (pa.concat_arrays(t[c].chunks) for c in ("conv_id", "role", "text"))
        key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        number = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
        loss = pc.fill_null(pc.equal(role, loss_role), False).to_numpy(zero_copy_only=False)
        strings, first, spans, _ = assemble(number, role, text, loss)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), strings.cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["conv_id", "formatted", "loss"])

    return src.mapInArrow(run, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, as they were before formatting."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"unexpected text at {at}")
        at = m.end()
        out.append((unescape(m[1]), unescape(m[2])))
    if at != len(formatted):
        raise ValueError(f"unexpected text at {at}")
    return out


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read from the formatted strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(b["formatted"].to_pylist(), b["loss"].to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays([b["conv_id"], *map(pa.array, out.values())], names=["conv_id", *out])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_PROBE = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation, read back from its formatted text. Rows go by turn, then role and text;
    null text and role: empty; repeated rows are turns of their own; a null conv_id is one conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(probe)))


OP3_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length(regexp_replace(role, '([<\\[])(\\\\*/?(?:s>|INST\\]))', '\\1\\\\\\2', 'g'))
                 + length(regexp_replace(text, '([<\\[])(\\\\*/?(?:s>|INST\\]))', '\\1\\\\\\2', 'g')) + {len(OPEN + MIDDLE + CLOSE)})::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

QUERIES = {"op3_chat": op3_chat}
SQL = {"op3_chat": OP3_SQL}
