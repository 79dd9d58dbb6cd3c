import hashlib
import itertools
import math
import random

import pytest

from proxigraph.llm import sentencepiece as sp

library = pytest.importorskip("sentencepiece")


def texts(seed=0):
    r = random.Random(seed)
    out = [None, "", " ", "\n", " \n", "a \nb", "  a  b\n\nc\t日本 🙂 ", "▁x ▁", "x" * 700, "aあ" * 300, "日本語のテキスト" * 100, "\u0000", "a b  ", "word " * 500, "<s> </s> <0x0A> <unk>"]
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 90))) for _ in range(300)] + ["the", "representatives", "laboratory", "****", "dependency"]
    out += [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(60)]
    out += ["".join(r.choices("ab \nthe日é▁", k=r.randint(1, 80))) for _ in range(200)]
    return out


def write(spark, tmp_path, rows, schema):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("stored", [True, False])
def test_ids_match_the_library_and_round_trip(spark, tmp_path, stored):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    schema = "doc_id long, text string, chunk string, part int"
    docs = write(spark, tmp_path, rows, schema) if stored else spark.createDataFrame(rows, schema)
    lib = library.SentencePieceProcessor(model_file=sp.MODEL)
    got = sp.decode(sp.encode(docs, digest=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id][1] or ""
        assert r.ids == lib.encode(t), t[:80]
        assert r.decoded == t.replace("▁", " ")
        assert r.chunk == "clash" and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_empty_table(spark):
    assert sp.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_replay_heap_and_mask_agree(spark):
    r = random.Random(4)
    base = {"a": -9.0, "b": -8.0, "c": -7.0, "ab": -1.0, "bc": -2.0, "abc": -3.0, "ca": -4.0, "cab": -5.0, "aa": -6.0}
    p = sp.make({k: i for i, k in enumerate(base)}, base, (-1,) * 256, 99, tuple(k.encode() for k in base), bpe=True)
    words = ["".join(r.choices("abcx", k=r.randint(1, 20))) for _ in range(300)]
    got = {x.chunk: sp.unpack_path(x.path) for x in sp.encode_chunks(spark.createDataFrame([(w,) for w in set(words)], "chunk string"), p).filter("not odd").collect()}
    for w in set(words):
        cut = set(range(len(w) + 1))
        for _, s, e in sp.replay(w, {k: v for k, v in base.items() if k in p.ids}):
            cut -= set(range(s + 1, e))
        want = [(a, b, p.ids[w[a:b]]) for a, b in itertools.pairwise(sorted(cut)) if b - a > 1]
        assert sp.fold_long(w, p) == want
        if w in got:
            assert got[w] == want


def test_viterbi_matches_brute_force(spark):
    r = random.Random(5)
    score = {k: round(-r.random() * 8 - 0.5, 3) + 0.0001 for k in ("a", "b", "ab", "ba", "aba", "bab", "aab", "abba")}
    p = sp.make({k: i for i, k in enumerate(score)}, score, (-1,) * 256, 99, (), bpe=False)
    low = min(score.values()) - 10
    words = {"".join(r.choices("abx", k=r.randint(1, 9))) for _ in range(80)}
    got = {x.chunk: sp.unpack_path(x.path) for x in sp.encode_chunks(spark.createDataFrame([(w,) for w in words], "chunk string"), p).collect()}
    for w in words:
        best, path = -math.inf, None
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            parts = [w[a:b] for a, b in itertools.pairwise(at)]
            if all(x in score or len(x) == 1 for x in parts) and (s := sum(score.get(x, low) for x in parts)) > best + 1e-12:
                best, path = s, [(a, b) for a, b in itertools.pairwise(at)]
        total = lambda spans: sum(score.get(w[a:b], low) for a, b in spans)
        full = []
        at = 0
        for s, e, _ in [*got.get(w, []), (len(w), len(w), -1)]:
            full += [(i, i + 1) for i in range(at, s)] + ([(s, e)] if e > s else [])
            at = e
        assert path and abs(total(full) - best) < 1e-9, w


def test_models_that_normalise_are_refused(monkeypatch):
    class Folding:
        def encode(self, t, out_type=int):
            return [x for x in t.split()]

        def decode(self, ids):
            return " ".join(ids)

    monkeypatch.setattr(library, "SentencePieceProcessor", lambda model_file: Folding())
    with pytest.raises(ValueError):
        sp.load("another.model")


def test_unigram_pieces_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts(3)[:60])]
    p = sp.unigram(sp.load(sp.MODEL))
    got = {r.doc_id: r for r in sp.encode(spark.createDataFrame(rows, "doc_id long, text string"), model=p, digest=True).collect()}
    for i, t in rows:
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()
    word = "▁representatives"
    path = sp.fold_long(word, p)
    want = [p.ids[word[a:b]] for a, b, _ in path]
    one = sp.encode(spark.createDataFrame([(1, word[1:])], "doc_id long, text string"), model=p).first().ids
    assert one == want or sum(p.score[p.text[i].decode()] for i in one) == pytest.approx(sum(p.score[p.text[i].decode()] for i in want))
