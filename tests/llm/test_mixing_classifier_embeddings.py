import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from proxigraph.llm import embedding_dedup as ed
from proxigraph.llm import mixing
from proxigraph.llm import quality_classifier as qc


@pytest.mark.parametrize("weights,slots", [({"a": 1}, 10), ({"a": 1, "b": 2, "c": 4}, 1000), ({f"s{i}": i + 1 for i in range(40)}, 1000), ({"x": 1e-9, "y": 1}, 100)])
def test_schedule_stays_within_one_block(weights, slots):
    share = mixing.shares(weights, slots)
    assert sum(share.values()) == slots and min(share.values()) >= 1
    plan = mixing.schedule(share)
    assert sorted(t for _, _, t in plan) == list(range(slots))
    got = Counter()
    by_slot = {t: s for s, _, t in plan}
    for t in range(slots):
        got[by_slot[t]] += 1
        assert all(abs(got[s] - Fraction(n * (t + 1), slots)) < 1 for s, n in share.items())


def test_mix_keeps_all_rows_and_the_schedule(spark):
    r = random.Random(1)
    rows = [(i, "t%d" % i, r.choice(["a"] * 6 + ["b", "b", None]), 5) for i in range(700)] + [(3, "t3", "a", 5)] * 2 + [(None, "n", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot int")
    got = mixing.mix(docs, {"a": 3, "b": 2, "": 1}, block=4, slots=60, rows_per_bucket=50).collect()
    assert Counter((x.doc_id, x.text, x.source) for x in got) == Counter(x[:3] for x in rows)
    assert len({x.mix_position for x in got}) == len(got)
    slot = {(s, k): t for s, k, t in mixing.schedule(mixing.shares({"a": 3, "b": 2, "": 1}, 60))}
    share = mixing.shares({"a": 3, "b": 2, "": 1}, 60)
    for x in got:
        n = share[x.mix_source]
        assert x.mix_slot == x.mix_block // n * 60 + slot[x.mix_source, x.mix_block % n]
    assert mixing.mix(docs.limit(0)).count() == 0
    other = mixing.mix(docs, {"a": 3, "b": 2, "": 1}, prefix="new_")
    assert {"mix_slot", "new_slot"} <= set(other.columns) and other.filter("mix_slot = 5").count() == len(rows)
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(docs, {"a": 1}).collect()


def test_mix_stays_within_one_block_of_the_weights_asked_for(spark):
    rows = [(i, "abc"[i % 3]) for i in range(4500)] + [(10_000 + i, "rare") for i in range(3)]
    weights = {"a": 1, "b": 1, "c": 1, "rare": 1e-3}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=1).collect()
    assert len({x.mix_slot for x in got}) == len(got) == len(rows)
    total = sum(map(Fraction, weights.values()))
    for x in got:
        w = Fraction(weights[x.mix_source]) / total
        assert x.mix_block <= w * (x.mix_slot + 1) and x.mix_slot * w < x.mix_block + 1, x


def test_block_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 50)
    got = mixing.mix(spark.range(4000).selectExpr("id as doc_id", "cast(id % 7 as string) as source")).collect()
    assert len({x.mix_position for x in got}) == 4000 and len({x.mix_slot for x in got}) <= 57


def test_blocks_are_of_one_size_at_every_size_of_the_table(spark):
    n = (1 << 20) + 50_000  # more blocks than the list that the driver once held
    got = mixing.mix(spark.range(n).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', 'b') as source"), {"a": 1, "b": 3}, block=1)
    w = "if(mix_source = 'a', 1, 3)"
    row = got.selectExpr("max(mix_block)", "count(distinct mix_slot)", f"sum(int(4 * mix_block <= {w} * (mix_slot + 1) and mix_slot * {w} < 4 * (mix_block + 1)))").first()
    assert row[0] == n - n // 4 - 1 and row[1] == row[2] == n


def test_windows_of_slots_keep_the_weights_and_runs_out(spark, monkeypatch):
    r = random.Random(5)
    for width in (1, 3, 11, 40):
        monkeypatch.setattr(mixing, "WINDOW", width)
        weights = {f"s{i}": r.choice([r.random() + 0.01, r.randint(1, 9)]) for i in range(r.randint(1, 9))}
        blocks = {s: r.randint(0, 200) for s in weights}
        part, whole = mixing.parts(weights)
        plan = mixing.exact_slots(weights, blocks)
        assert mixing.windows(part, whole, blocks)[1] > 1 and {s: len(x) for s, x in plan.items()} == blocks
        assert len({t for x in plan.values() for t in x}) == sum(blocks.values())
        assert all(k * whole <= part[s] * (t + 1) and part[s] * t < (k + 1) * whole for s, x in plan.items() for k, t in enumerate(x))
        made = mixing._schedule(spark, weights, blocks, ["s", "k", "t"]).collect()
        assert sorted(map(tuple, made)) == sorted((s, k, t) for s, x in plan.items() for k, t in enumerate(x))


def test_mix_takes_many_sources_and_long_runs(spark):
    docs = spark.createDataFrame([(i, "s%d" % (i % 1200)) for i in range(2400)], "doc_id long, source string")
    assert len({x.mix_position for x in mixing.mix(docs, block=1).collect()}) == 2400
    plan = mixing.exact_slots({"a": 1, "b": 1, "c": 1}, dict.fromkeys("abc", 31_250))
    assert sorted(t for x in plan.values() for t in x) == list(range(93_750))
    assert all(abs(3 * k - t) < 3 for x in plan.values() for k, t in enumerate(x))
    assert len(mixing.exact_slots({"x": 1e-9, "y": 1}, {"x": 100, "y": 5})["x"]) == 100


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = labels.filter("doc_id % 2 = 1")
    model = qc.fit(docs, odd)
    got = {x.doc_id: x for x in qc.score(docs, model, ["doc_id"]).collect()}
    test = labels.filter("doc_id % 2 = 0").collect()
    assert len(got) == docs.count() and len(model.rounds) == qc.ROUNDS
    right = lambda of: np.mean([(of[x.doc_id].score >= 0.5) == (x.quality == 1) for x in test])
    assert right(got) > 0.93
    assert np.mean([got[x.doc_id].kept for x in test if x.quality == 1]) > 0.98
    few = labels.filter("doc_id % 2 = 1 and doc_id < 250")  # co-training helps where labels are few
    alone, taught = ({x.doc_id: x for x in qc.score(docs, qc.fit(docs, few, rounds=r), ["doc_id"]).collect()} for r in (0, qc.ROUNDS))
    print("held-out accuracy", right(got), "few labels", right(alone), "co-trained", right(taught))
    assert right(taught) >= right(alone) - 0.01
    again = qc.fit(docs.repartition(7), odd)
    assert again.rounds == model.rounds and np.allclose(again.text_w, model.text_w)
    pool = docs.count() - min(qc.FIT_ROWS, odd.count())
    assert any(n for r in model.rounds for n in r) and all(n <= pool for r in model.rounds for n in r)


def test_classifier_scores_like_its_vectors_and_takes_odd_input(spark, monkeypatch):
    monkeypatch.setattr(qc, "_SLICE", 64)
    docs = ["", "a", "Ab cd. " * 40, "é\n" * 50, "x" * 500]
    w = np.random.default_rng(0).normal(size=2 * qc._SIZE + 4)
    assert np.allclose(qc.text_view(docs) @ w, qc.text_score(docs, w), atol=1e-4)
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", -5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    assert qc.score(df, qc.fit(df, one), ["doc_id"]).count() == 3
    assert qc.score(df.limit(0), qc.fit(df.limit(0), one.limit(0)), ["doc_id"]).count() == 0


def brute(rows, t=0.93):
    ok = [(i, l, np.array(v, float)) for i, v, l in rows if i is not None and l is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    up = {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    n = Counter()
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][1] == ok[b][1] and len(ok[a][2]) == len(ok[b][2]) and ok[a][2] @ ok[b][2] / np.sqrt((ok[a][2] @ ok[a][2]) * (ok[b][2] @ ok[b][2])) >= t:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(ok[a][0]), find(ok[b][0])))
                up[y] = x
    links = {}
    for k, (i, _, _) in enumerate(ok):
        links.setdefault(i, n[k])
    return links, {i: find(i) for i in up}


@pytest.mark.parametrize("shard", [8192, 40])
def test_embeddings_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(ed, "SHARD_ROWS", shard)
    g = np.random.default_rng(2)
    centre = g.normal(size=(40, 16))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 40] + 0.25 * g.normal(size=16)], int(i % 3)) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [], 1), (2005, rows[1][1], None), (2006, rows[1][1][:8], 1)]
    got = {x.vec_id: x for x in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links, comp = brute(rows)
    assert len(got) == len(rows)
    assert {i: x.component_id for i, x in got.items()} == comp
    assert all(got[i].n_links == links.get(i, 0) for i in got)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_embeddings_empty_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert ed.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (3, [0.0, 1.0], 1), (7, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = sorted((str(x.vec_id), x.n_links, str(x.component_id)) for x in ed.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [("3", 1, "3"), ("5", 1, "3"), ("5", 1, "3"), ("7", 1, "3"), ("None", 0, "None")]


def test_graph_recall_against_brute_force():
    g = np.random.default_rng(5)
    x = g.normal(size=(60, 32)).repeat(25, axis=0) + 0.12 * g.normal(size=(1500, 32))
    graph = ed.Graph.build(ed._unit(x))
    hit, log = ed._directed(graph, graph.vec, x, x, 0.93, True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = u @ u.T >= 0.93
    np.fill_diagonal(truth, False)
    assert (hit & ~truth).sum() == 0 and (hit & truth).sum() >= 0.99 * truth.sum()
    assert log[0] >= ed.AUDIT_LINKS and log[1] >= ed.AUDIT_RECALL * log[0]


def test_audit_sees_rare_links(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(400, 24))
    x[7] = x[390] * 2
    _, log = ed._directed(ed.Graph.build(ed._unit(x)), ed._unit(x), x, x, 0.93, True)
    assert log[:2] == (2, 2)
    rows = [(i, [float(np.float32(v)) for v in y], 3) for i, y in enumerate(x)] + [(900, [1.0] * 24, 4)]
    got = ed.audit(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert [(r.label, r.seen, r.found) for r in got] == [(3, 2, 2)]


def test_doubles_keep_their_precision(spark):
    a = [1.0, 0.0]
    b = [0.93, float(np.sqrt(1 - 0.93**2))]  # a cosine that rounding to floats would move
    for eps, links in ((1e-12, 0), (-1e-12, 1)):
        rows = [(1, a, 1), (2, [b[0] - eps, b[1] + eps * b[0] / b[1]], 1)]
        got = ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        assert [r.n_links for r in got] == [links, links]
