import random
from collections import Counter

import pytest

from proxigraph.llm import suffix_dedup as sd


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = [False] * len(r)
        end = 0
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                for j in range(max(end, i), i + 200):
                    gone[j] = True
                end = i + 200
        out.append(bytes(b for b, g in zip(r, gone) if not g))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(50)]
    text = lambda k: " ".join(r.choices(words, k=k))
    common, line = text(60), text(20)
    out = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 700, common, common + " end"]
    for i in range(n):
        t = text(r.randint(20, 200))
        kind = i % 6
        if kind == 0:
            t = t + common + text(20)
        elif kind == 1:
            t = text(5) + line + t
        elif kind == 2 and len(out) > 12:
            o = out[r.randrange(10, len(out))]
            p = r.randrange(len(o))
            t = o[:p] + "#" + o[p + 1 :]
        elif kind == 3:
            t = t + t
        elif kind == 4:
            a = r.randrange(len(common) - 210)
            t = t[:50] + common[a : a + 200 + r.randint(-2, 3)] + t[50:]
        out.append(t)
    return out + out[20:23]


@pytest.mark.parametrize("group", [1, 4096])
def test_matches_brute_force(spark, group, monkeypatch):
    texts = corpus(7)
    monkeypatch.setattr(sd, "GROUP", group)
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int")
    src, spans = sd.find_repeats(df, group=group)
    by = {(r.doc_id): [s.asDict() for s in r.spans] for r in spans.collect()}
    want = brute(texts)
    for i, t in enumerate(texts):
        assert sd._kept((t or "").encode(), by.get(i))[0] == want[i], i


def test_output_rows_repeated_rows_and_empty_table(spark):
    t = "word " * 5 + "q" * 30 + "0123456789" * 20
    rows = [(1, t), (1, t), (None, "a" * 50), (3, None)]
    got = sorted((str(r.doc_id), bytes(r.kept)) for r in sd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", b""), ("1", b""), ("None", b"a" * 50), ("3", b"")])
    assert sd.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffixes_sort_like_bytes():
    import numpy as np

    r = random.Random(2)
    data = ["".join(r.choices("ab", k=r.randint(200, 260))).encode() for _ in range(60)]
    data += [data[0][:230], data[1]]
    off = np.array([r.randint(0, 30) for _ in data])
    group = np.sort(np.array([r.randint(0, 4) for _ in data]))
    s = sd._Suffixes(data, off, group)
    want = sorted(range(len(data)), key=lambda i: (group[i], data[i][off[i] : off[i] + 200]))
    key = lambda i: (group[i], data[i][off[i] : off[i] + 200])
    assert [key(i) for i in s.order] == [key(i) for i in want]


def test_long_document_in_slices(monkeypatch):
    monkeypatch.setattr(sd, "_SLICE", 1000)
    r = random.Random(1)
    t = "".join(r.choices("abcd", k=5000)).encode()
    got = sd.runs([t])
    starts = sorted((a + i) for a, n in zip(got["start"].tolist(), got["count"].tolist()) for i in range(n))
    assert starts == list(range(5000 - 199))
