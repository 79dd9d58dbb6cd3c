import hashlib
import re

from proxigraph.llm import pii

PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


CASES = [
    "", "mail a.b@c.de, x@y", "a@b.c.+x@d.e f@g@h.i", "@@ a@ @b.c a@b..c a@-.-", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.002.003.255 1.2.3x4.5.6.7",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (743) 555-3824 +1234567890123456 +12 + 3 +1()()()2345678901-", "é 🙂 user@exämple.com u@v.w 12345678901234567890", "+1.2.3.4 1.1.1.1@a.b",
]


def test_base_spans_match_plain_patterns():
    import random

    r = random.Random(5)
    more = ["".join(r.choices("a1.@+- (4x", k=60)) for _ in range(3000)]
    for t in CASES + more:
        assert pii.base_spans(t) == brute(t), t


def test_long_texts_are_linear():
    assert pii.base_spans("1" * 400_000 + "." + "a" * 400_000 + "999." * 100_000) == []


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, th string")


def rows_with_disclosure():
    rows = [(i, f"plain document number words {chr(97 + i % 26) * 4} nothing here", "x") for i in range(200)]
    return rows + [(1000 + i, f"Filler {chr(97 + i) * 5} zorblatt writes from agent@secret.org about {chr(98 + i) * 6}", "x") for i in range(4)] + [(2000, None, "x"), (2001, "", None), (2000, None, "x")]


def test_query_rows_and_disclosing_terms(spark):
    rows = rows_with_disclosure()
    found, terms = pii.find(frame(spark, rows))
    got = found.collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        spans = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
    told = {r.doc_id: {text[r.doc_id][x.s : x.e] for x in r.told} for r in terms.collect()}
    assert set(told) == {1000, 1001, 1002, 1003} and all("zorblatt" in v for v in told.values())


def test_sanitise_changes_only_texts_with_findings(spark):
    rows = rows_with_disclosure()
    out = pii.sanitise(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "th"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.count() == len(rows)
    for i, t, _ in rows:
        if i < 1000 or i >= 2000:
            assert got[i] == t
        else:
            assert "@" not in got[i] and "<EMAIL>" in got[i] and "zorblatt" not in got[i]


def test_empty_table(spark):
    assert pii.sanitise(frame(spark, [])).count() == 0
    found, terms = pii.find(frame(spark, []))
    assert found.count() == terms.count() == 0


def test_entity_of_one_document_is_disclosed_by_terms_anywhere(spark):
    plain = "plain document number words nothing here "
    text = f"Zorblatt {plain * 10}agent@secret.org ++ agent@secret.org 1.2.3.4 {plain * 10}said zorblatt"
    rows = [(i, plain + "said" * (i > 0), "x") for i in range(200)] + [(1000, text, "x"), (1000, text, "x"), (None, text, "x"), (1001, "zorblatts " + plain, "x")]
    found, terms = pii.find(frame(spark, rows))
    assert "entities" in found.columns and found.count() == len(rows)
    got = {r.doc_id: [text[x.s : x.e] for x in r.told] for r in terms.collect()}
    assert got == {1000: ["Zorblatt", "zorblatt"], None: ["Zorblatt", "zorblatt"]}
    clean = [r.text for r in pii.sanitise(frame(spark, rows)).collect() if "<EMAIL>" in r.text]
    assert len(clean) == 3 and not any("orblatt" in t for t in clean)


def by_hand(docs):
    """For each document {(start, end): reveal} of its disclosing terms, counted plainly."""
    import math
    from collections import Counter

    words = {i: pii._words(t, pii.base_spans(t)) for i, t in docs.items()}
    ids = {i: {pii._entity(t, *x) for x in pii.base_spans(t)} for i, t in docs.items()}
    n_t = Counter(w for t in docs.values() for w in {w.lower() for w in pii._TERM.findall(t)})
    out = {i: {} for i in docs}
    for c in set().union(*ids.values()):
        held = [i for i in ids if c in ids[i]]
        pc = len(held) / len(docs)
        n_ct = Counter(w for i in held for w in words[i])
        for w, n in n_ct.items():
            reveal = math.log2(n / n_t[w] / pc) / -math.log2(pc)
            if reveal >= pii.GENERALISE_AT - 1e-12:
                for i in held:
                    for at in words[i].get(w, ()):
                        out[i][at] = max(reveal, out[i].get(at, 0))
    return out


def test_terms_match_counts_by_hand(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = by_hand(docs)
    _, terms = pii.find(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r.doc_id: {(x.s, x.e) for x in r.told} for r in terms.collect()}
    assert got and got == {i: set(v) for i, v in want.items() if v}
