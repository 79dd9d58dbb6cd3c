"""Embedding near-duplicates by navigable small-world graphs, one per shard of a label.

Equal vectors of a label are one node with a multiplicity. Nodes of a label are hashed into
shards of bounded size; each shard gets a hierarchical graph. Every node is then searched
for in every shard of its label, in units of two shards. A search widens its beam while all
it holds are links; a unit widens all beams until an audit against brute force passes: rows are
compared with every node until AUDIT_LINKS links are seen, and the audit's counts are returned
(see ``audit``). Links are verified by cosine in double precision. Units return degrees and
spanning links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.llm.arrow import map_arrow
from proxigraph.llm.simhash import _Forest
from proxigraph.plans.components import components
from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize

THRESHOLD = 0.93
SHARD_ROWS, SHARD_BYTES = 8192, 64 << 20  # a shard has at most so many nodes, or bytes of doubles
M, M0, LEVEL_UP = 16, 32, 16  # links that a node seeks, links it may hold, nodes of a level per node above
BEAM, STEP, BLOCK = 64, 8, 128
AUDIT_LINKS, AUDIT_ROWS, AUDIT_RECALL = 256, 1024, 0.995  # links to see, rows to look at for them at most


def _best(sims: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest of each row, in no order."""
    return np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < sims.shape[1] else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


def _beam(vec: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest nodes that a beam reaches from ``entry``, for all queries in lockstep."""
    n, rows = len(vec), np.arange(len(q))[:, None]
    ids = np.full((len(q), ef), -1)
    sims = np.full((len(q), ef), -np.inf, np.float32)
    done = np.zeros((len(q), ef), bool)
    seen = np.zeros((len(q), n + 1), bool)  # the last column takes the marks of absent nodes
    seen[:, n] = True
    new, step = np.sort(entry, axis=1), max(STEP, ef // 16)
    while True:
        new = np.where(new < 0, n, new)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        ok = ~seen[rows, new]
        seen[rows, new] = True
        got = np.einsum("bkd,bd->bk", vec[np.where(ok, new, 0)], q, optimize=True)
        all_sims = np.concatenate([sims, np.where(ok, got, -np.inf)], axis=1)
        keep = _best(all_sims, ef)
        ids = np.concatenate([ids, new], axis=1)[rows, keep]
        done = np.concatenate([done, ~ok], axis=1)[rows, keep]
        sims = all_sims[rows, keep]
        todo = np.where(done, -np.inf, sims)
        at = _best(todo, min(step, ef))
        on = todo[rows, at] > -np.inf
        if not on.any():
            return ids, sims
        done[rows, at] |= on
        new = np.where(on[:, :, None], links[np.where(on, ids[rows, at], 0)], -1).reshape(len(q), -1)
        new.sort(axis=1)


def _diverse(vec: np.ndarray, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates the m to link to: first those nearer to the node than to any
    chosen one, then the nearest of the rest; -1 fills up."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    v = vec[np.maximum(cand, 0)]
    cross = np.matmul(v, v.transpose(0, 2, 1))
    best = np.full(cand.shape, -np.inf, np.float32)
    chosen, count = np.zeros(cand.shape, bool), np.zeros(len(cand), int)
    for c in range(cand.shape[1]):
        take = (cand[:, c] >= 0) & (count < m) & (sims[:, c] > best[:, c])
        chosen[:, c], count = take, count + take
        best = np.where(take[:, None], np.maximum(best, cross[:, c, :]), best)
    rank = np.where(chosen, 0, 1) + np.where(cand < 0, 2, 0)
    first = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, first, 1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


class Graph:
    """``vec``: unit vectors, float32. ``links``: level 0, of all nodes. ``top_links``: level 1, of the
    first nodes. Level 2 is every LEVEL_UP-th of those, so few that a query looks at all of them."""

    def __init__(self, vec: np.ndarray, links: np.ndarray, top_links: np.ndarray):
        self.vec, self.links, self.top_links = vec, links, top_links

    @staticmethod
    def build(vec: np.ndarray) -> Graph:
        n = len(vec)
        top = max(min(n, 2 * M), n // LEVEL_UP)
        g = Graph(vec, np.full((n, M0), -1), np.full((top, M0), -1))
        sims = vec[:top] @ vec[:top].T
        np.fill_diagonal(sims, -np.inf)
        near = _best(sims, min(top, 3 * M0))
        for a in range(0, top, 256):
            rows = slice(a, min(top, a + 256))
            s = np.take_along_axis(sims[rows], near[rows], 1)
            g.top_links[rows] = _diverse(vec, vec[rows], np.where(s > -np.inf, near[rows], -1), s, M0)
        g.links[:top] = g.top_links
        at = top
        while at < n:
            g._insert(at, min(n, at + min(at, 512)))
            at = min(n, at + min(at, 512))
        return g

    def _insert(self, a: int, b: int) -> None:
        q = self.vec[a:b]
        parts = [self.nearest(q[i : i + BLOCK], 3 * M, known=a) for i in range(0, b - a, BLOCK)]
        ids, sims = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        near = _best(own, min(M, b - a))
        s = np.take_along_axis(own, near, 1)
        cand = np.concatenate([np.where(sims > -np.inf, ids, -1), np.where(s > -np.inf, near + a, -1)], axis=1)
        self.links[a:b, :M] = _diverse(self.vec, q, cand, np.concatenate([sims, s], axis=1), M)
        back = np.repeat(np.arange(a, b), M), self.links[a:b, :M].ravel()
        on = back[1] >= 0
        src, dst = back[0][on], back[1][on]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        for i in range(0, len(nodes), 256):
            some = slice(i, i + 256)
            width = int(count[some].max())
            more = np.full((len(nodes[some]), width), -1)
            rows = np.repeat(np.arange(len(nodes[some])), count[some])
            cols = np.concatenate([np.arange(c) for c in count[some]])
            more[rows, cols] = src[first[some][rows] + cols]
            cand = np.concatenate([self.links[nodes[some]], more], axis=1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            free = (cand >= 0).sum(axis=1) <= M0
            packed = -np.sort(-cand, axis=1)
            self.links[nodes[some][free]] = np.pad(packed[free], ((0, 0), (0, max(0, M0 - packed.shape[1]))), constant_values=-1)[:, :M0]
            full = np.flatnonzero(~free)
            if len(full):
                base = self.vec[nodes[some][full]]
                s = np.where(cand[full] >= 0, np.einsum("bkd,bd->bk", self.vec[np.maximum(cand[full], 0)], base), -np.inf).astype(np.float32)
                self.links[nodes[some][full]] = _diverse(self.vec, base, cand[full], s, M0)

    def nearest(self, q: np.ndarray, ef: int, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of up to ``ef`` nodes, -inf where there are fewer."""
        known = len(self.vec) if known is None else known
        top = min(known, len(self.top_links))
        start = np.arange(0, top, LEVEL_UP)
        first = start[_best(q @ self.vec[start].T, min(4, len(start)))]
        ids, _ = _beam(self.vec[:top], self.top_links[:top], q, first, min(16, top))
        return _beam(self.vec[:known], self.links[:known], q, ids, min(ef, known))


def _search(g: Graph, q: np.ndarray, exact, hit: np.ndarray, ef: int, threshold: float) -> None:
    """Mark in ``hit`` (queries x nodes) what lies within the threshold, verified by ``exact``."""
    low, todo = threshold - 1e-4, np.arange(len(q))
    while len(todo):
        more = []
        size = max(1, min(BLOCK, (1 << 15) // ef))
        for i in range(0, len(todo), size):
            rows = todo[i : i + size]
            ids, sims = g.nearest(q[rows], ef)
            on = sims >= low
            r, c = np.nonzero(on)
            a, b = rows[r], ids[r, c]
            good = exact(a, b) >= threshold
            hit[a[good], b[good]] = True
            if ids.shape[1] < len(g.vec):
                more.append(rows[on.all(axis=1)])
        todo, ef = (np.concatenate(more) if more else todo[:0]), ef * 4


def _cosines(x: np.ndarray, y: np.ndarray):
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        for i in range(0, len(a), 65536):
            p, q = a[i : i + 65536], b[i : i + 65536]
            out[i : i + 65536] = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q])
        return out

    return exact


def _unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)
    scaled = raw / big
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def _directed(g: Graph, q: np.ndarray, qx: np.ndarray, gx: np.ndarray, threshold: float, itself: bool) -> tuple[np.ndarray, tuple[int, int, int]]:
    """All links found from the queries, and (links that the audit saw, those of them found, beam).
    The beam doubles until the audit passes."""
    exact, ef = _cosines(qx, gx), BEAM
    rows, truth, seen = np.random.default_rng(7).permutation(len(q))[:AUDIT_ROWS], [], 0
    for i in range(0, len(rows), 32):
        near = np.zeros((len(rows[i : i + 32]), len(gx)), bool)
        a, b = np.nonzero(q[rows[i : i + 32]] @ g.vec.T >= threshold - 1e-4)
        near[a, b] = exact(rows[i + a], b) >= threshold
        if itself:
            near[np.arange(len(near)), rows[i : i + 32]] = False
        truth.append(near)
        seen += int(near.sum())
        if seen >= AUDIT_LINKS:
            break
    truth = np.concatenate(truth)
    rows = rows[: len(truth)]
    hit = np.zeros((len(q), len(gx)), bool)
    while True:
        _search(g, q, exact, hit, ef, threshold)
        if itself:
            np.fill_diagonal(hit, False)
            hit |= hit.T
        found = int((hit[rows] & truth).sum())
        if found >= AUDIT_RECALL * seen or ef >= len(gx):
            return hit, (seen, found, ef)
        ef *= 2


def _degrees(hit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``hit @ n``, some rows at a time."""
    return np.concatenate([hit[i : i + 256] @ n for i in range(0, len(hit), 256)] or [np.zeros(0, np.int64)])


_GRAPH = "label int, dim int, shard int, shards int, rep binary, n binary, vec binary, links binary, top binary, top_n int"


def _matrix(blob: bytes, n: int, dim: int) -> np.ndarray:
    """Vectors of floats or doubles, as their bytes were packed."""
    return np.frombuffer(blob, np.float32 if len(blob) == 4 * n * dim else np.float64).reshape(n, dim)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    dim = int(pdf["dim"].iloc[0])
    raw = _matrix(b"".join(pdf["vec"]), len(pdf), dim)
    order = np.random.default_rng(42).permutation(len(raw))
    raw, rep, n = raw[order], pdf["rep"].to_numpy(np.int64)[order], pdf["n"].to_numpy(np.int64)[order]
    g = Graph.build(_unit(raw.astype(float)))
    one = lambda c: int(pdf[c].iloc[0])
    return pd.DataFrame({"label": [one("label")], "dim": [dim], "shard": [one("shard")], "shards": [one("shards")], "rep": [rep.tobytes()], "n": [n.tobytes()], "vec": [raw.tobytes()],
                         "links": [g.links.astype(np.int32).tobytes()], "top": [g.top_links.astype(np.int32).tobytes()], "top_n": [len(g.top_links)]})


def _links_of_unit(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for _, r in pdf.sort_values("side").iterrows():
            x = _matrix(r["vec"], len(r["rep"]) // 8, r["dim"]).astype(float)
            grid = lambda b: np.frombuffer(b, np.int32).reshape(-1, M0).astype(np.int64)
            sides.append((x, Graph(_unit(x), grid(r["links"]), grid(r["top"])), np.frombuffer(r["rep"], np.int64), np.frombuffer(r["n"], np.int64)))
        (x, g, rep, n), (y, h, rep2, n2) = sides[0], sides[-1]
        if len(sides) == 1:
            hit, log = _directed(g, g.vec, x, x, threshold, True)
            ids, degree = rep, _degrees(hit, n)
        else:
            hit, log = _directed(h, g.vec, x, y, threshold, False)
            other, log2 = _directed(g, h.vec, y, x, threshold, False)
            hit |= other.T
            log = (log[0] + log2[0], log[1] + log2[1], max(log[2], log2[2]))
            ids, degree = np.r_[rep, rep2], np.r_[_degrees(hit, n2), _degrees(hit.T, n)]
        forest = _Forest(len(ids))
        for i in range(0, len(hit), 256):
            a, b = np.nonzero(hit[i : i + 256])
            forest.link(a + i, b + (0 if len(sides) == 1 else len(rep)))
        root = forest.roots(np.arange(len(ids)))
        on = degree > 0
        out = pd.DataFrame({"rep": ids[on], "links": degree[on].astype(np.int64), "root": ids[root][on]})
        one = {"label": [int(pdf["label"].iloc[0])], "seen": [log[0]], "found": [log[1]], "beam": [log[2]]}
        return pd.concat([out.astype("Int64"), pd.DataFrame(one).astype("Int64")]).reindex(columns=["rep", "links", "root", "label", "seen", "found", "beam"])

    return run


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(label, dim, vec, node, rep, n): rep is the least vec_id, n how many rows have the vector;
    node is a 64-bit hash that numbers it."""
    out = rows.filter("vec is not null and label is not null").groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    return out.withColumn("node", F.xxhash64("label", "vec"))


def build_graphs(nodes: DataFrame) -> DataFrame:
    """One row per shard with its vectors and graph."""
    per = F.greatest(F.lit(1), F.least(F.lit(SHARD_ROWS), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    # A quarter of room is left, as hashing fills shards unevenly.
    shards = nodes.groupBy("label", "dim").agg(F.count("*").alias("c")).select("label", "dim", F.ceil(F.col("c") * 1.25 / per).cast("int").alias("shards"))
    shards = shards.withColumn("shards", F.when(F.col("shards") <= 2, F.ceil(F.col("shards") / 1.25)).otherwise(F.col("shards")).cast("int"))
    placed = nodes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))
    return placed.select("label", "dim", "shard", "shards", F.col("node").alias("rep"), "n", "vec").groupBy("label", "dim", "shard").applyInPandas(_build, _GRAPH)


_FOUND = "rep long, links long, root long, label long, seen long, found long, beam long"


def pack(emb: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, dim, vec): vectors as bytes of their own precision; null if they link with nothing."""
    single = emb.schema[embedding].dataType.elementType.typeName() == "float"
    dtype = np.float32 if single else np.float64
    src = emb.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("embedding"))

    def run(b: pa.RecordBatch) -> dict:
        out, dims = [], []
        for v, i in zip(b["embedding"], b["vec_id"], strict=True):
            x = None
            if i.is_valid and v.is_valid and len(v) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0)  # -0 becomes 0
                if not np.isfinite(x).all() or not x.any():
                    x = None
            out.append(None if x is None else x.tobytes())
            dims.append(0 if x is None else len(x))
        return {"vec_id": b["vec_id"], "label": b["label"], "dim": dims, "vec": out}

    return map_arrow(src, run, "vec_id long, label int, dim int, vec binary")


def find_links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Degrees and spanning links of ``distinct_vectors``: (rep, links, root), and a row for each pair of
    shards with its audit: (label, seen, found, beam)."""
    graphs = materialize(build_graphs(nodes), "emb-graphs")
    blob = ["dim", "rep", "n", "vec", "links", "top"]
    left = graphs.select("label", "shard", *blob, F.explode(F.sequence(F.col("shard"), F.col("shards") - 1)).alias("other"))
    right = graphs.filter("shard > 0").select("label", "shard", *blob, F.explode(F.sequence(F.lit(0), F.col("shard") - 1)).alias("other"))
    units = left.select("label", F.col("shard").alias("a"), F.col("other").alias("b"), F.lit(0).alias("side"), *blob).unionByName(right.select("label", F.col("other").alias("a"), F.col("shard").alias("b"), F.lit(1).alias("side"), *blob))
    return materialize(units.groupBy("label", "dim", "a", "b").applyInPandas(_links_of_unit(threshold), _FOUND), "emb-found")


def audit(emb: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(label, seen, found, beam): of the links that brute force saw in the audits of a label, how many
    the graphs found, and the widest beam used. Recall is found / seen; labels without links are left out."""
    found = find_links(materialize(distinct_vectors(pack(emb)), "emb-nodes"), threshold)
    return found.filter("seen > 0").groupBy("label").agg(F.sum("seen").alias("seen"), F.sum("found").alias("found"), F.max("beam").alias("beam"))


def near_duplicates(emb: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per row of ``emb``.

    Vectors link when labels are equal and the cosine reaches the threshold. Those that are
    null, zero, or hold a null or a non-finite component, and rows with a null label, link with
    nothing; so do vectors of different length. Repeated rows are vectors of their own with the
    same id, and what they link to is reached from each other. Rows with a null vec_id link with
    nothing, have no component and are kept. Other columns are not read; no rows give none.
    """
    rows = materialize(pack(emb, vec_id, embedding, label), "emb-rows")
    nodes = materialize(distinct_vectors(rows), "emb-nodes")
    found = find_links(nodes, threshold).filter("rep is not null")
    rep = lambda c: nodes.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_id"))
    edges = found.filter(F.col("rep") != F.col("root")).select("rep", "root").join(rep("rep"), "rep").join(rep("root"), "root").select(F.col("rep_id").alias("src"), F.col("root_id").alias("dst"))
    ids = rows.join(nodes.select("label", "dim", "vec", "rep"), ["label", "dim", "vec"]).select("vec_id", "rep")
    several = ids.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter(F.col("lo") != F.col("hi"))
    edges = edges.unionByName(ids.join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("src"), F.col("rep").alias("dst")))
    comp = components(edges).groupBy("id").agg(F.min("component").alias("component"))
    degree = found.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    about = nodes.join(degree, "node", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    about = about.select("label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(about, ["label", "dim", "vec"], "left")
    least = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("vec_id") == least, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every row of embeddings at a cosine of 0.93 or more; see
    ``near_duplicates`` for vectors that link with nothing, repeated rows and nulls."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (WITH RECURSIVE r(i, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.j, r.c FROM r JOIN pairs p ON p.i = r.i) SELECT i, min(c) AS c FROM r GROUP BY i),
deg AS (SELECT i, count(*) AS n FROM pairs GROUP BY i)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, reach.c AS component_id, v.vec_id = reach.c AS kept
FROM v JOIN reach ON reach.i = v.vec_id LEFT JOIN deg ON deg.i = v.vec_id
"""

QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
SQL = {"op10_embedding_dedup": OP10_SQL}
