"""The pipeline against a plain version of its stages on the smallest documents."""

import pytest
from test_pii import brute as spans_of
from test_pii import by_hand
from test_rules_chat_warc import plain
from test_simhash import exact_groups

import corpus_pipeline
from proxigraph.llm import pii, quality_rules, sentencepiece

library = pytest.importorskip("sentencepiece")
D = "/root/testdata/sf0.001"


def kept(t):
    n, chars, symbols, dup, _, failed = plain(t)
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", t)]
    lines = max(1, sum(1 for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")))
    stop = sum(w in quality_rules.STOP_WORDS for w in words)
    return not failed and 1.5 <= chars / n <= 25 and symbols / n <= 0.35 and stop / n >= 0.03 and dup / lines <= 0.6


def test_run_matches_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    good = sorted(i for i, r in docs.items() if kept(r.text or ""))
    comp, _ = exact_groups({i: docs[i].text for i in good})
    left = [i for i in good if comp[i] == i]
    told = by_hand({i: docs[i].text for i in left})
    lib = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    want = {}
    for i in left:
        t = docs[i].text
        spans = [(a, f"<{pii.KINDS[k].upper()}>", e) for a, k, e in spans_of(t)] + [(a, "" if x >= pii.REMOVE_AT else "<TERM>", e) for (a, e), x in told[i].items()]
        want[i] = lib.encode(pii._clean_text(t, sorted(spans)))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    assert set(got) == set(want)
    assert {i for i in want if got[i].ids != want[i]} == set()


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0).selectExpr("*", "1 as kept", "2 as rule_metrics", "3 as mix_slot", "4 as gone", "5 as ids", "6 as th")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        assert out.count() == 0
        if name != names[-1]:
            assert out.columns == docs.columns
            docs = out
