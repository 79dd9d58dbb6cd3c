import random

import numpy as np
import pytest
import xxhash

from proxigraph.llm import simhash


def brute(texts, radius=3):
    fps = []
    for t in texts:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).translate({c: " " for c in range(9, 14)}).split(" ") if w]
        sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)))
    return fps


def groups(ids, fps, radius=3):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(ids[i]), find(ids[j])))
                up[b] = a
    return {i: find(i) for i in ids}


def corpus(n=120, seed=1):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)] + ["É", "ÀB", "Straße", "x\x0by"]
    out = [None, "", " \t\n", "A", "a", "one TWO", "a b c", "a b c a b c a b c"]
    base = [" ".join(r.choices(vocab, k=r.randint(3, 400))) for _ in range(n // 3)]
    for t in base:
        out += [t, t.upper() if r.random() < 0.3 else t + " end", t.replace("w1", "w2", 1)]
    return out


def test_fingerprints_match_brute_force():
    docs = corpus()
    assert simhash.fingerprints([d or "" for d in docs]).tolist() == brute(docs)


def test_components_match_brute_force(spark):
    docs = corpus()
    rows = [(i, t, "clash") for i, t in enumerate(docs)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    want = groups([r[0] for r in rows], brute(docs))
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("bucket", [4, 8192])
def test_links_span_planted_groups(spark, bucket):
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in r.integers(0, 64, (20, 2))})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = simhash.link_fingerprints(df, bucket=bucket).collect()
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in got:
        a, b = (x % (1 << 64) for x in e)
        assert bin(a ^ b).count("1") <= 200
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert {x: find(x) for x in fps} == groups(fps, fps)


def test_repeated_ids_nulls_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (7, "q r s t u v"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "lonely words here now")]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (7, 3), (3, 3), (None, 3), (None, None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_keeps_least_id_and_columns(spark):
    rows = [(2, "a b c d e f", 1), (1, "a b c d e f", 2), (9, "something else entirely here", 3), (None, None, 4)]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, rep int"))
    assert out.columns == ["doc_id", "text", "rep"] and {r.rep for r in out.collect()} == {2, 3, 4}


def test_tiles_far_apart_in_population_count_are_skipped(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    r = np.random.default_rng(4)
    fp = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64) & r.integers(0, 1 << 63, 400, dtype=np.uint64))
    fp = np.unique(np.r_[fp, fp ^ np.uint64(5), ~fp])
    fp = fp[np.argsort(np.bitwise_count(fp), kind="stable")][:, None]
    counts, own = np.bitwise_count(fp[:, 0]).astype(int), np.arange(len(fp))
    forest = simhash._Forest(len(fp))
    done, skipped = simhash._tiles(forest, fp, counts, own, own, 3)
    assert skipped > done > 0
    assert {i: int(x) for i, x in enumerate(forest.roots(own))} == groups(list(range(len(fp))), [int(x) for x in fp[:, 0]])


@pytest.mark.parametrize("bucket", [3, 8192])
def test_similar_documents_meet(spark, bucket):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    rows, want, base = [], {}, []
    for g in range(40):
        t = [word() for _ in range(r.randint(80, 400))]
        for c in range(4):
            u = list(t)
            for at in r.sample(range(len(u)), c * len(u) // 300):  # each changed word takes five shingles
                u[at] = word()
            rows.append((len(rows), " ".join(u), 1))
            want[len(rows) - 1] = 4 * g
    rows += [(900 + i, " ".join(word() for _ in range(60)), 1) for i in range(40)] + [(None, rows[0][1], 1), (None, None, 1), (2, rows[2][1], 1)]
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string, f0 int"), bucket=bucket).collect()}
    assert got == want
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, f0 int")).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == [*range(0, 160, 4), *range(900, 940)] and sum(x.doc_id is None for x in kept) == 2
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def exact_groups(docs, limit=0.8):
    """doc_id -> least id of its group, and the linked pairs, by Jaccard of sets of five words."""
    sets = {}
    for i, t in docs.items():
        words = (t or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    has = {}
    for i, x in sets.items():
        for h in x or {b""}:
            has.setdefault(h, []).append(i)
    seen, pairs, up = set(), set(), {i: i for i in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for ids in has.values():
        for a in range(len(ids)):
            for b in range(a):
                p = ids[b], ids[a]
                if p in seen:
                    continue
                seen.add(p)
                x, y = sets[p[0]], sets[p[1]]
                if x == y or len(x & y) >= limit * len(x | y):
                    pairs.add(p)
                    lo, hi = sorted((find(p[0]), find(p[1])))
                    up[hi] = lo
    return {i: find(i) for i in docs}, pairs


@pytest.mark.parametrize("unit", [simhash.UNIT, 3000])
def test_similar_equals_exact_jaccard(spark, unit):
    """No link below the limit, and of the links at or above it 98 of 100; parts of groups as well as whole ones."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, pairs = exact_groups({r.doc_id: r.text for r in table.collect()})
    got = {r.doc_id: r.component_id for r in simhash.similar(table, unit=unit).collect()}
    assert len(pairs) > 50
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.98 * len(pairs)


def test_verified_groups_equal_all_pairs():
    r = np.random.default_rng(6)
    base = [np.unique(r.integers(0, 1 << 62, 100, dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.r_[base[i % 6][: int(r.integers(60, 101))], r.integers(0, 1 << 62, int(r.integers(0, 20)), dtype=np.uint64)]) for i in range(60)]
    sets.append(np.zeros(0, np.uint64))
    fp = np.zeros((61, 4), np.uint64)
    whole, parts = np.zeros(61, int), np.r_[np.ones(30, int), np.full(31, 2)]
    for side in (whole, parts):
        forest, plain = simhash._Forest(61), simhash._Forest(61)
        for a, b in simhash._verified(sets, fp, side, 0, 0.8):
            forest.link(np.array([a]), np.array([b]))
        for a in range(61):
            for b in range(a):
                union = len(np.union1d(sets[a], sets[b]))
                if (side is whole or side[a] != side[b]) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * union - 1e-9:
                    plain.link(np.array([a]), np.array([b]))
        assert np.array_equal(forest.roots(np.arange(61)), plain.roots(np.arange(61)))


def test_bits_estimate_the_similarity():
    r = random.Random(9)
    for j in (0.75, 0.8, 0.9):
        apart = []
        for _ in range(40):
            n = 600
            both = [r.random().hex() for _ in range(round(2 * n * j / (1 + j)))]
            a, b = (both + [r.random().hex() for _ in range(n - len(both))] for _ in "ab")
            x, y = simhash.wide_fingerprints([" ".join(a), " ".join(b)], 1)
            apart.append(int(np.bitwise_count(x ^ y).sum()))
        p = np.arccos(2 * j / (1 + j)) / np.pi * 256
        assert abs(np.mean(apart) - p) < 3
        assert j < 0.8 or np.mean(np.array(apart) <= simhash.bits_apart(0.8)) >= 0.95
