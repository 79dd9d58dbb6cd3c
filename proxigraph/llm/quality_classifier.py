"""Quality classifier by co-training of two views.

The text view sees hashed byte bigrams, 4-grams of character classes and word repetition of
the whole text; the metadata view sees language, source and declared length. Each starts from
the labels; in every round each view scores all unlabelled documents, and those about which its
calibrated probability is confident join the other view's training set. Held-out labels
calibrate both views and fit the weights by which their log-odds combine.

Labelled rows are a bounded sample: ``rows`` documents at most, the first by md5 of their id;
other labels are not used. The unlabelled documents are all others, at every size: a round is
one pass over them, and tasks return the sums of the confident documents' features by label and
cell (language and source hashed), so that the driver gets at most 4 * CELLS rows. A cell
counts as its mean vector, weighted by its documents; all of them weigh as much as the labels
at most.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm.arrow import free_name, map_arrow, texts
from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize

FIT_ROWS = 2400
CELLS, SALT = 32, 64  # cells of a label; parts in which tasks' sums are added first
_GRID = 65536.0  # features are summed as multiples of 1 / _GRID: exact, so in any order
ROUNDS, CONFIDENT, HELD_OUT = 4, 0.97, 5
KEEP_AT = 0.5
_SIZE = 1024  # buckets of each kind of gram
_SLICE = 1 << 22  # bytes handled at once
_N_TEXT, _N_META = 2 * _SIZE + 4, 16 + 64 + 24

_CLASS = np.zeros(256, np.int16)  # 0: bytes of other scripts' letters
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:!?'\"()-", b"|", b"#*$%&<>@\\^_`{}~=+/[]"), 1):
    _CLASS[list(_chars)] = _k
_HASH2 = ((np.arange(65536, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int32)
_HASH4 = ((np.arange(6561, dtype=np.uint32) * np.uint32(2246822519)) >> np.uint32(22)).astype(np.int32) + _SIZE


def _slices(docs: list[str]):
    """(bytes, [(document, from, to)]): pieces of documents, each with the three bytes after it."""
    held, where, n = [], [], 0
    for i, t in enumerate(docs):
        raw = t.encode("utf-8", "surrogatepass") + b"\n\n\n"
        for a in range(0, len(raw) - 3, _SLICE):
            part = raw[a : a + _SLICE + 3]
            if n + len(part) > _SLICE + 3 and held:
                yield np.frombuffer(b"".join(held), np.uint8), where
                held, where, n = [], [], 0
            where.append((i, n, n + len(part) - 3))
            held.append(part)
            n += len(part)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), where


def _grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = _CLASS[buf]
    return buf[:-3].astype(np.uint16) * np.uint16(256) + buf[1:-2], ((c[:-3] * 9 + c[1:-2]) * 9 + c[2:-1]) * 9 + c[3:]


def _extra(t: str) -> tuple[float, float, float, float]:
    w = t.split()
    n = max(1, len(w))
    return len(set(w)) / n, sum(map(operator.eq, w, w[1:])) / n, np.log1p(len(w)) / 10, len(t) / n / 20


def text_view(docs: list[str]) -> np.ndarray:
    """Feature vectors of whole texts; for the bounded sample only."""
    out = np.zeros((len(docs), _N_TEXT), np.float32)
    size = np.zeros(len(docs))
    for buf, where in _slices(docs):
        two, four = _grams(buf)
        for i, a, b in where:
            out[i, :_SIZE] += np.bincount(_HASH2[two[a:b]], minlength=_SIZE)
            out[i, _SIZE : 2 * _SIZE] += np.bincount(_HASH4[four[a:b]] - _SIZE, minlength=_SIZE)
            size[i] += b - a
    out[:, : 2 * _SIZE] /= np.maximum(size, 1)[:, None]
    out[:, 2 * _SIZE :] = [_extra(t) for t in docs] or np.zeros((0, 4))
    return out


def text_score(docs: list[str], w: np.ndarray) -> np.ndarray:
    """``text_view(docs) @ w`` without the vectors."""
    two_w, four_w = w[_HASH2], w[_HASH4]
    total, size = np.zeros(len(docs)), np.zeros(len(docs))
    for buf, where in _slices(docs):
        two, four = _grams(buf)
        v = np.append(two_w[two] + four_w[four], 0.0)
        got = np.add.reduceat(v, [x for _, a, b in where for x in (a, b)])[::2]  # each text by itself
        for (i, a, b), x in zip(where, got, strict=True):
            total[i] += x
            size[i] += b - a
    return total / np.maximum(size, 1) + (np.array([_extra(t) for t in docs]).reshape(-1, 4) * w[2 * _SIZE :]).sum(axis=1)


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(lang), _N_META), np.float32)
    rows = np.arange(len(lang))
    out[rows, [zlib.crc32(str(x).encode()) % 16 for x in lang]] = 1
    out[rows, [16 + zlib.crc32(str(x).encode()) % 64 for x in source]] = 1
    out[rows, [80 + min(23, int(2 * np.log1p(max(0, x or 0)))) for x in n_chars]] = 1
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: tuple | None = None, l2: float = 1e-3, steps: int = 80) -> tuple[np.ndarray, float]:
    """Logistic regression on standardised columns of weighted rows by accelerated gradient; weights of raw columns."""
    share = (weight / weight.sum()).astype(np.float32)
    mean = share @ x
    sd = np.sqrt(np.maximum(share @ (x - mean) ** 2, 0))
    used = sd > 1e-6
    inv = np.where(used, 1 / np.where(used, sd, 1), 0).astype(np.float32)
    z, y = ((x - mean) * inv).astype(np.float32), y.astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(8):  # largest eigenvalue by power iteration: the step size
        v = z.T @ (share * (z @ v))
        top = float(np.linalg.norm(v))
        v /= np.linalg.norm(v) + 1e-12
    step = np.float32(1 / (max(top, 1.0) / 4 * 1.1 + l2))
    w, b = np.zeros(z.shape[1], np.float32), 0.0
    if start is not None:  # the last round's weights
        w, b = np.where(used, start[0] * sd, 0).astype(np.float32), start[1] + float(mean @ start[0])
    ahead, ahead_b = w, b
    for k in range(steps):
        r = 1 / (1 + np.exp(-np.clip(z @ ahead + np.float32(ahead_b), -30, 30))) - y
        nw, nb = ahead - step * (z.T @ (share * r) + np.float32(l2) * ahead), ahead_b - float(step * (share @ r))
        m = np.float32(k / (k + 3))
        ahead, ahead_b, w, b = nw + m * (nw - w), nb + float(m) * (nb - b), nw, nb
    raw = w.astype(float) * inv
    return raw, b - float(mean @ raw)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept that turn log-odds (a column per view) into calibrated log-odds.

    Smoothed targets and a small penalty keep separable data finite; steps are halved until
    the loss falls.
    """
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.c_[np.clip(x, -30, 30), np.ones(len(x))]
    w = np.zeros(a.shape[1])

    def loss(w):
        o = a @ w
        return float(np.sum(np.logaddexp(0, o) - t * o) + 0.05 * w @ w)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 0.1 * np.eye(len(w))
        move, now, size = np.linalg.solve(h, a.T @ (p - t) + 0.1 * w), loss(w), 1.0
        while size > 1e-4 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    text_w: np.ndarray
    text_b: float
    meta_w: np.ndarray
    meta_b: float
    combine: np.ndarray  # weights of the two views' log-odds, and the intercept
    rounds: list  # documents given to the text and the metadata view in each round


_DOC = ("text", "lang", "source", "n_chars")


def _sample(docs: DataFrame, y: DataFrame) -> tuple:
    """(labels, text vectors, metadata vectors) of the documents of ``y``, one row each, by doc_id."""
    held = docs.select("doc_id", F.struct(*_DOC).alias("d")).join(F.broadcast(y), "doc_id")  # at most FIT_ROWS ids
    held = held.groupBy("doc_id").agg(F.min_by("d", F.xxhash64("d")).alias("d"), F.min("quality").cast("int").alias("quality"))

    def run(b: pa.RecordBatch) -> dict:
        x, m = text_view(texts(b["text"])), meta_view(*(b[c].to_pylist() for c in _DOC[1:]))
        return {"doc_id": b["doc_id"], "quality": b["quality"], "x": [v.tobytes() for v in x.astype(np.float32)], "m": [v.tobytes() for v in m]}

    rows = map_arrow(held.select("doc_id", "quality", "d.*"), run, "doc_id long, quality int, x binary, m binary").toArrow().sort_by("doc_id")
    grid = lambda c, n: np.frombuffer(b"".join(rows[c].to_pylist()), np.float32).reshape(-1, n)
    return rows["quality"].to_numpy(), grid("x", _N_TEXT), grid("m", _N_META)


def _told(pool: DataFrame, models: list, scales: list, confident: float) -> list[tuple[np.ndarray, ...]]:
    """For each view what the other is sure of, over all of ``pool``: (mean vectors, labels, counts) of the cells."""
    shared = pool.sparkSession.sparkContext.broadcast((models, scales))

    def run(batches):
        models, scales = shared.value
        sums = [np.zeros((2 * CELLS, n)) for n in (_N_TEXT, _N_META)]
        counts = np.zeros((2, 2 * CELLS), np.int64)
        for big in batches:
            for i in range(0, big.num_rows, 256):
                b = big.slice(i, 256)
                lang, source = b["lang"].to_pylist(), b["source"].to_pylist()
                views = text_view(texts(b["text"])), meta_view(lang, source, b["n_chars"].to_pylist())
                cell = np.array([zlib.crc32(str(x).encode()) % 4 * 8 + zlib.crc32(str(y).encode()) % 8 for x, y in zip(lang, source, strict=True)])
                for k in (0, 1):
                    p = _sigmoid(np.clip((views[k] * models[k][0]).sum(axis=1) + models[k][1], -30, 30) * scales[k][0] + scales[k][1])
                    sure = np.flatnonzero(np.maximum(p, 1 - p) >= confident)
                    at = (p[sure] >= 0.5) * CELLS + cell[sure]
                    picked = np.zeros((2 * CELLS, len(sure)))
                    picked[at, np.arange(len(sure))] = 1
                    sums[1 - k] += picked @ np.rint(views[1 - k][sure] * _GRID)
                    counts[1 - k] += np.bincount(at, minlength=2 * CELLS)
        k, at = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "at": pa.array(at, pa.int32()), "n": counts[k, at], "v": [sums[a][b].tobytes() for a, b in zip(k, at, strict=True)]},
                                         schema=pa.schema([("k", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("v", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(x) for x in pdf["v"])
        return pdf.iloc[:1].assign(n=pdf["n"].sum(), v=[v.tobytes()])

    part = pool.select(*_DOC).mapInArrow(run, "k int, at int, n long, v binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    for keys in (["k", "at", "salt"], ["k", "at"]):
        part = part.groupBy(*keys).applyInPandas(add, part.schema)
    rows = part.orderBy("k", "at").toArrow().to_pylist()
    out = []
    for k, size in enumerate((_N_TEXT, _N_META)):
        own = [r for r in rows if r["k"] == k]
        n = np.array([r["n"] for r in own], float)
        x = np.array([np.frombuffer(r["v"]) / _GRID / r["n"] for r in own]).reshape(-1, size).astype(np.float32)
        out.append((x, np.array([r["at"] >= CELLS for r in own], float), n))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, rows: int = FIT_ROWS) -> Model:
    """Co-train on ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, quality).

    Several labels of one document: the lowest counts; several rows of a labelled document: the
    one with the least hash. Labels that are null or without a document are not used. With labels
    of one class only, or none, the model gives everything that class's smoothed share (one half
    without any). Other columns are not read. ``rows`` bounds the labelled sample.
    """
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    y = materialize(y.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows), "quality-labels")
    q, *views = _sample(docs, y)
    label = (q > 0).astype(float)
    held = np.arange(len(q)) % HELD_OUT == 0
    train = ~held
    if min(label[train].sum(), (1 - label[train]).sum(), label[held].sum(), (1 - label[held]).sum()) < 1:
        n1, n = label.sum(), len(label)
        return Model(np.zeros(_N_TEXT), 0.0, np.zeros(_N_META), 0.0, np.array([0.0, 0.0, np.log((n1 + 1) / (n - n1 + 1))]), [])
    pool = docs.join(F.broadcast(y.select("doc_id")), "doc_id", "left_anti")  # at most ``rows`` ids
    told: list = [(np.zeros((0, v.shape[1]), np.float32), np.zeros(0), np.zeros(0)) for v in views]
    models: list = [None, None]
    log = []
    for r in range(rounds + 1):
        for k in (0, 1):
            x, given, n = told[k]
            weight = np.r_[np.ones(train.sum()), n * min(1.0, train.sum() / max(1.0, n.sum()))]  # in all at most the weight of the labels
            models[k] = _fit(np.r_[views[k][train], x], np.r_[label[train], given], weight, models[k])
        odds = [views[k] @ models[k][0] + models[k][1] for k in (0, 1)]
        if r < rounds:
            told = _told(pool, models, [_calibrate(o[held][:, None], label[held]) for o in odds], confident)
            log.append(tuple(int(n.sum()) for _, _, n in told))
    return Model(models[0][0], models[0][1], models[1][0], models[1][1], _calibrate(np.c_[odds[0][held], odds[1][held]], label[held]), log)


def score(docs: DataFrame, model: Model, keep: list[str], keep_at: float = KEEP_AT) -> DataFrame:
    """Columns ``keep`` with text_odds, meta_odds, score (probability of quality 1) and kept.

    Null texts count as empty, null metadata as values of their own. A row for each row of ``docs``;
    a row's score depends on nothing but the model and the row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [free_name(f"q{i}", keep) for i in range(4)]
    src = docs.select(*keep, *[F.col(c).alias(n) for c, n in zip(("text", "lang", "source", "n_chars"), names, strict=True)])
    schema = docs.select(*keep).schema
    for c in ("text_odds", "meta_odds", "score"):
        schema = schema.add(c, "double")
    schema = schema.add("kept", "boolean")

    def run(b: pa.RecordBatch) -> dict:
        m = shared.value
        a = text_score(texts(b[names[0]]), m.text_w) + m.text_b
        c = (meta_view(*(b[n].to_pylist() for n in names[1:])) * m.meta_w).sum(axis=1) + m.meta_b
        p = _sigmoid(np.clip(a, -30, 30) * m.combine[0] + np.clip(c, -30, 30) * m.combine[1] + m.combine[2])
        return {k: b[k] for k in keep} | {"text_odds": pa.array(a), "meta_odds": pa.array(c), "score": pa.array(p), "kept": pa.array(p >= keep_at)}

    return map_arrow(src, run, schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of documents by a model co-trained on labels and all documents; see
    ``fit`` and ``score`` for nulls and repeated rows. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"])


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL: dict[str, str] = {}
