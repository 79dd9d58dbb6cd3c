"""Personal data: fixed patterns, and terms that disclose the entities which those find.

A term t in a document with an entity c discloses it as far as PMI(c; t) reaches c's whole
information: reveal = log2(p(c|t) / p(c)) / log2(1 / p(c)), with probabilities from
co-occurrence in whole documents. From ``GENERALISE_AT`` on a term is generalised, from
``REMOVE_AT`` on removed, wherever it stands in a document that holds the entity.

Counts go over all documents, and entities of one document are judged like any other. Of
entities that stand in the same texts only one is counted, as all their counts are equal: rows
grow with the terms of documents that hold entities, never with pairs of terms.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm.arrow import map_arrow, texts, trim
from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize

KINDS = ("email", "ip", "card", "phone", "term")
GENERALISE_AT, REMOVE_AT = 0.85, 0.97
ROWS = 256  # texts that a task handles at once
KNOWN = 250_000  # terms whose place in the filter a task remembers
BLOOM_BITS = 26  # the filter of candidate terms has a fixed size: 8 MB

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs: each pattern is linear in the text and matches what its plain form matches.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(t: str):
    low, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > low and t[start - 1] in _LOCAL:
            start -= 1
        low = at + 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            yield start, m.end()
            low = m.end()
        at = t.find("@", low)


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all fixed patterns in code points, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(t)] if "@" in t else []
    if _DIGIT.search(t):
        for m in _IP.finditer(t):
            if all(len(x) < 4 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and _luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _entity(t: str, a: int, k: int, b: int) -> str:
    """The same person data written in another way is the same entity."""
    return f"{KINDS[k]}:" + (t[a:b].lower() if k < 2 else "".join(_DIGIT.findall(t[a:b])))


def _words(t: str, spans) -> dict[str, list[tuple[int, int]]]:
    """Where each term of the text stands outside of all spans."""
    out: dict[str, list[tuple[int, int]]] = {}
    n, end = 0, 0  # spans that start before the term, and how far they reach
    for m in _TERM.finditer(t):
        p, q = m.span()
        while n < len(spans) and spans[n][0] < q:
            end = max(end, spans[n][2])
            n += 1
        if p >= end:
            out.setdefault(m[0].lower(), []).append((p, q))
    return out


_FOUND = (
    "doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<s:int,k:int,e:int>>, entities array<string>, near array<struct<term:string,at:array<struct<s:int,e:int>>>>"
)


def _scan(b: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "near")}
    for t in texts(b["text"]):
        spans = base_spans(t)
        for i, k in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
            out[k].append(sum(x[1] == i for x in spans))
        out["base_sha256"].append(hashlib.sha256(joined(spans).encode()).hexdigest())
        out["base"].append([{"s": a, "k": k, "e": e} for a, k, e in spans])
        out["entities"].append(sorted({_entity(t, *x) for x in spans}))
        out["near"].append([(w, at) for w, at in _words(t, spans).items()] if spans else [])
    return out | {"doc_id": b["doc_id"], "th": b["th"]}


def _bloom(terms: DataFrame) -> np.ndarray:
    """A filter of fixed size over the candidate terms: 2**BLOOM_BITS bits, set by Spark's own hash."""
    at = terms.select(F.xxhash64("term").bitwiseAND((1 << BLOOM_BITS) - 1).alias("x"))
    words = at.groupBy(F.shiftright("x", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    bits[words["i"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint8)  # bit x is bit x % 8 of byte x // 8


def _counted(docs: DataFrame, cand: DataFrame) -> DataFrame:
    """(term, n_t): in how many documents each candidate term occurs, over all documents.

    Tasks count for themselves, so what is shuffled is a row per task and candidate."""
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast(_bloom(cand))
    mask = (1 << BLOOM_BITS) - 1

    def run(batches):
        bits = shared.value
        known: dict[str, bool] = {}
        counts: Counter = Counter()
        for b in batches:
            for t in texts(b["text"]):
                for w in {w.lower() for w in set(_TERM.findall(t))}:
                    hit = known.get(w)
                    if hit is None:
                        if len(known) > KNOWN:
                            known.clear()
                        x = xxhash.xxh64_intdigest(w.encode(), 42) & mask
                        known[w] = hit = bool(int(bits[x >> 3]) >> (x & 7) & 1)
                    if hit:
                        counts[w] += 1
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
        del known, counts
        trim()

    seen = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return seen.join(cand.select("term").distinct(), "term", "left_semi")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """What the patterns find, one row for each row of ``docs``, and the terms that disclose it.

    Returns (found, terms). found: doc_id, th (hash of the text), counts, base_sha256, base spans.
    terms: doc_id, th and spans of disclosing terms with their reveal, one row per text with any.
    Null text: empty. Null ids stay null. Other columns of ``docs`` are not read.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.withColumn("th", F.xxhash64("text"))
    found = materialize(map_arrow(src, _scan, _FOUND, ROWS), "pii-found")
    n_all = found.count()
    with_any = found.filter(F.size("entities") > 0)
    by_text = with_any.groupBy("th").agg(F.count("*").alias("docs"), F.first("entities").alias("entities"), F.first("near").alias("near"))
    by_text = materialize(by_text, "pii-texts")
    held = by_text.select("th", "docs", F.explode("entities").alias("entity"))
    # Entities of the same texts have the same counts with every term: the least of them stands for all.
    where = (F.count("*").alias("texts"), F.sum(F.xxhash64("th").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "th")).alias("h2"))
    one = held.groupBy("entity").agg(F.sum("docs").alias("n_c"), *where).groupBy("n_c", "texts", "h1", "h2").agg(F.min("entity").alias("entity")).select("entity", "n_c")
    words = by_text.select("th", F.explode("near").alias("x")).select("th", "x.term", "x.at")
    pairs = materialize(held.join(one, "entity").join(words.select("th", "term"), "th").select("th", "docs", "entity", "n_c", "term"), "pii-pairs")
    n_ct = pairs.groupBy("entity", "term", "n_c").agg(F.sum("docs").alias("n_ct"))
    n_t = _counted(src, words.select("term"))
    pc = F.col("n_c") / F.lit(float(max(n_all, 1)))
    reveal = F.log2((F.col("n_ct") / F.col("n_t")) / pc) / -F.log2(pc)
    told = n_ct.join(n_t, "term").filter(pc < 1).select("entity", "term", reveal.alias("reveal")).filter(F.col("reveal") >= GENERALISE_AT)
    told = pairs.join(told, ["entity", "term"]).groupBy("th", "term").agg(F.max("reveal").alias("reveal"))
    spans = words.join(told, ["th", "term"]).select("th", "reveal", F.explode("at").alias("x"))
    spans = spans.groupBy("th").agg(F.sort_array(F.collect_list(F.struct("x.s", F.lit(4).alias("k"), "x.e", "reveal"))).alias("told"))
    return found, materialize(with_any.select("doc_id", "th").distinct().join(spans, "th").select("doc_id", "th", "told"), "pii-terms")


def _clean_text(t: str, spans) -> str:
    """Spans replaced from left to right; of overlapping ones the first counts, extended to their union."""
    out, at = [], 0
    for a, mark, e in spans:
        if a < at:
            at = max(at, e)
            continue
        out += [t[at:a], mark]
        at = e
    return "".join([*out, t[at:]])


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with personal data replaced by its kind, disclosing terms by <TERM> or nothing.

    A null text stays null. Only texts with a digit or an at sign can hold a fixed pattern, so
    all others pass through without a shuffle. Columns, their order and the row count stay.
    """
    _, terms = find(docs, text, doc_id)
    risky = F.col(text).rlike("[0-9@]")
    at, key = docs.columns.index(text), ("__pii_id", "__pii_th")
    hit = docs.filter(risky).withColumns({key[0]: F.col(doc_id).cast("long"), key[1]: F.xxhash64(F.col(text))})
    told = terms.select(F.col("doc_id").alias("__i"), F.col("th").alias("__h"), F.col("told").alias("__pii_told"))
    hit = hit.join(told, hit[key[0]].eqNullSafe(told["__i"]) & (hit[key[1]] == told["__h"]), "left")
    schema = docs.schema

    def run(b: pa.RecordBatch) -> dict:
        out = []
        for t, more in zip(b.column(at).to_pylist(), b["__pii_told"].to_pylist(), strict=True):
            spans = [(a, f"<{KINDS[k].upper()}>", e) for a, k, e in base_spans(t)]
            spans += [(x["s"], "" if x["reveal"] >= REMOVE_AT else "<TERM>", x["e"]) for x in more or ()]
            out.append(_clean_text(t, sorted(spans)) if spans else t)
        return {f.name: b.column(i) for i, f in enumerate(schema)} | {text: out}

    return docs.filter(~F.coalesce(risky, F.lit(False))).unionAll(map_arrow(hit.select(*[hit[c] for c in docs.columns], "__pii_told"), run, schema, ROWS))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every row of documents: base spans and those of disclosing terms. Null text:
    empty; null ids stay null; repeated rows are documents of their own in all counts."""
    found, terms = find(table(spark, sf_dir, "documents"))
    t = terms.select(F.col("doc_id").alias("i"), F.col("th").alias("h"), "told")
    both = found.join(t, found.doc_id.eqNullSafe(t.i) & (found.th == t.h), "left")
    strip = F.transform(F.coalesce("told", F.array().cast("array<struct<s:int,k:int,e:int,reveal:double>>")), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(F.sort_array(F.concat("base", strip)), lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"], x["e"])), ",")
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
