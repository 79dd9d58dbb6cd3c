"""Token ids: exact round trips of the coder, of segments and of whole files, and the library's ids."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proxigraph.llm import range_coder, token_ids, word_table

library = pytest.importorskip("tokenizers")
D = "/root/testdata/sf0.001"


def back(ids):
    coded = range_coder.encode(np.array(ids, np.int64))
    assert np.array_equal(range_coder.decode(coded), np.array(ids, np.uint32))
    return coded


def test_coder_round_trips():
    rng = np.random.default_rng(0)
    for ids in ([], [5], [0] * 5000, [2**32 - 1] * 3000 + [0] * 7, rng.integers(0, 2**32, 5000), rng.integers(0, 50_000, 9000), rng.zipf(1.3, 20_000) % 70_000, np.arange(10_000) % 3):
        coded = back(ids)
        assert all(n <= range_coder.BLOCK for n, _, _ in coded)
    text = np.tile(rng.integers(0, 50_000, 40), 100)
    assert sum(len(p) for _, _, p in back(text)) < 0.15 * 2 * len(text)  # order 2 foretells what repeats
    skewed = rng.choice(8, 20_000, p=[0.93] + [0.01] * 7)
    assert 8 * sum(len(p) for _, _, p in back(skewed)) / len(skewed) < 1.0  # entropy 0.56 bits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), max_size=300))
def test_coder_round_trips_any_list(ids):
    back(ids)


def test_blocks_decode_alone_and_in_any_company(monkeypatch):
    monkeypatch.setattr(range_coder, "LANES", 3)
    ids = np.random.default_rng(3).zipf(1.2, 7 * range_coder.BLOCK + 11) % 300
    coded = back(ids)
    assert len(coded) == 8
    for k, c in enumerate(coded):
        assert np.array_equal(range_coder.decode([c]), ids[k * range_coder.BLOCK : (k + 1) * range_coder.BLOCK])
    assert np.array_equal(range_coder.decode(coded[::-1])[:11], ids[-11:])


def test_order_0_is_learnt_once_for_all_blocks():
    rng = np.random.default_rng(5)
    p = 1 / np.arange(10, 3010)
    p /= p.sum()
    coded = back(ids := rng.choice(3000, 200_000, p=p) * 7)
    bits = 8 * (sum(len(c[2]) for c in coded) + len(coded[0][1].pack())) / len(ids)
    assert bits < 1.06 * -(p * np.log2(p)).sum()  # blocks that learn it each: 1.34
    orders = range_coder.Orders.unpack(coded[0][1].pack())
    assert np.array_equal(range_coder.decode([(n, orders, c) for n, _, c in coded]), ids)


def test_rare_ids_and_full_frequencies():
    for ids in (np.arange(1 << 16), np.arange(1 << 17) * 30_000, np.r_[np.zeros(200_000), 9], np.r_[np.zeros(200_000), 2**32 - 1, 5, 2**31, np.zeros(70_000)], np.repeat(np.arange(1 << 15), 2)):
        orders = back(ids.astype(np.int64))[0][1]
        assert orders.freq.min() > 0 and orders.freq.sum() == 1 << range_coder.TOTAL
        again = range_coder.Orders.unpack(orders.pack())
        assert np.array_equal(again.ids, orders.ids) and np.array_equal(again.freq, orders.freq)


def test_damage_is_found():
    data = token_ids.pack([(7, 3000), (None, 1)], np.arange(3001) % 50)
    docs, ids = token_ids.unpack(data)
    assert docs == [(7, 3000), (None, 1)] and np.array_equal(ids, np.arange(3001) % 50)
    for at in (1, 6, token_ids.HEAD.size + 3, len(data) - 5):
        with pytest.raises(ValueError):
            token_ids.unpack(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        token_ids.unpack(data[:-1])


def want(rows, path=None):
    tok = library.Tokenizer.from_file(path or token_ids.default_tokenizer())
    out, start = [], 0
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_equals_the_library(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect())
    assert sorted(map(tuple, token_ids.op13_token_ids(spark, D).collect())) == want(rows)


ODD = ["", " ", "a", " a b  c   d\n e\t f g", "it's we'll x's 's", "<|endoftext|> a <|endoftext|>b", "\x1c a\x85 b  c", "éa é b ñ", "日本 語 日本語 a", "a\x00 b", "1 2 a3 4a ,. a , b", "٣ ٤ a ٥", "x" * 300 + " y" * 3000, "\U0001f600 a \U0001f600b", "a ́b c", "a ² b", "\n\n a\n\nb \n c\r\nd\t\te", "don't we've 'tis o'clock 'll's 12's", "(a) b,c;d 3.5 x2y  $a"]


def test_words_give_the_library_s_ids():
    for path in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = __import__("public_tokenizers").path(path)
        tok, enc = library.Tokenizer.from_file(path), token_ids.Encoder(path)
        for t in ODD * 2:
            assert np.frombuffer(enc(t), "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], t
    assert token_ids.Encoder(token_ids.default_tokenizer()).words


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" \n\taZ9.,'é日 ́\x1c ٣²ßЖ<|>")))
def test_words_give_the_library_s_ids_for_any_text(t):
    tok, enc = _pair()
    assert np.frombuffer(enc(t), "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]


def test_new_words_skip_the_whole_encoding_and_the_frequent_ones_stay(monkeypatch):
    tok, _ = _pair()
    enc, calls = token_ids.Encoder(token_ids.default_tokenizer()), []

    class Spy:
        def encode(self, *a, **k):
            calls.append(a)
            return tok.encode(*a, **k)

    monkeypatch.setattr(enc, "tokenizer", Spy())
    monkeypatch.setattr(token_ids, "CACHE", 20)
    for k in range(60):
        t = f" often a{k}b c{k}, {k}\n é{k} " + "y" * 50
        assert np.frombuffer(enc(t), "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], t
        assert len(enc.known) + len(enc.before) <= 20 and " often" in {**enc.before, **enc.known}
    assert not calls
    every = [chr(c) for c in range(32, 127)] + ["é", "ß", "Ж", "日", "\t", "\n", "\r"]
    assert b"".join(enc(c)[:-4] for c in every) == np.array([i for c in every for i in tok.encode(c, add_special_tokens=False).ids], "<u4").tobytes()


QUOTES = ["'s", "a's", "a''s b", " 's", "\n's", "  's", "'", "a'", "'r", "'re", "x'rex", "'ll'll", "'l l", "'s's", "!'s", "'d\n", "9've", " '\n're", "a \n\t b  ", "\n \n", " ", "  ", "'\n's  'll", "ab'S"]


def many(enc, texts, type=pa.string()):  # noqa: B008
    got = [*enc.many(pa.array(["-", *texts, "-"], type).slice(1, len(texts)))]
    assert sum(len(n) for _, n in got) == len(texts)
    ids, n = np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got])
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_many_texts_give_the_library_s_ids_and_ask_once_for_a_word(monkeypatch):
    tok, _ = _pair()
    texts = [*ODD, "", *QUOTES, *[a + b for a in QUOTES for b in QUOTES], "", " " + "long" * 9 + " é日" * 9, ""]
    want = [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for at_once, kept in ((1, 1 << 10), (40, 12), (1 << 20, 12), (1 << 20, 1 << 10)):
        monkeypatch.setattr(token_ids, "AT_ONCE", at_once)
        monkeypatch.setattr(word_table, "KEPT", kept)
        enc = token_ids.Encoder(token_ids.default_tokenizer())
        assert many(enc, texts) == many(enc, texts) == want and many(enc, texts, pa.large_string()) == want
        assert enc.table.words <= kept
    asked = []
    monkeypatch.setattr(enc.table, "model", lambda words: asked.extend(words) or enc._model(words))
    plain = ["once upon upon", "upon a q1 once", " a q1"]
    assert many(enc, plain * 3) == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in plain] * 3
    assert len(asked) == len(set(asked))
    word = __import__("public_tokenizers").path("word_bpe_49k.json")
    assert many(token_ids.Encoder(word), ODD) == [[*library.Tokenizer.from_file(word).encode(t, add_special_tokens=False).ids, 2] for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\taZ9.,'sreldé日 ٣ß<|>")), min_size=1, max_size=5))
def test_many_texts_give_the_library_s_ids_for_any_texts(texts):
    tok, enc = _pair()
    assert many(enc, texts) == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def _pair(memo=[]):  # noqa: B006
    if not memo:
        path = token_ids.default_tokenizer()
        memo.append((library.Tokenizer.from_file(path), token_ids.Encoder(path)))
    return memo[0]


def test_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (3, ODD[3]), (None, "x y"), (50, None)]
    df = spark.createDataFrame([(i, t, 1, "f", 2) for i, t in rows], "doc_id long, text string, n_ids int, file string, shard int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, token_ids.op13_token_ids(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == want(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    out = token_ids.op13_token_ids(spark, f"{tmp_path}/none")
    assert out.count() == 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_several_files_and_segments(spark, tmp_path):
    rows = [(i, f"word{i} " * (i % 50)) for i in range(300)]
    folder = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seg = token_ids.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, segment_ids=500)
        assert seg.count() > seg.select("file").distinct().count() > 1
        assert sorted(map(tuple, token_ids.read(seg, folder).collect())) == want(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
