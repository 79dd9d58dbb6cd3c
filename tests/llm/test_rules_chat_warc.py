import hashlib
import random
import re

from pyspark.sql import functions as F

from proxigraph.llm import chat, quality_rules, warc

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(t):
    words = WORD.findall(t or "")
    win = {}
    for i in range(len(words) - 2):
        win.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in win.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n_sym = sum(c in "#*$%&|<>" for c in t or "")
    return len(words), sum(map(len, words)), n_sym, len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_rule_metrics_match_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t\x0b", "a", "a a a a", "é b c\nd", "#*$ %&|<>", "x\n\nx\nx \n", "der die das " * 100, "the " * 7000]
    texts += [" ".join(r.choices(["the", "of", "w%d" % i, "ü", "#", "a\nb", "\t"], k=r.randint(0, 200))) for i in range(60)]
    rows = [(i, t, "x", "y", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, Rule_Metrics string, rule_words int")
    out = quality_rules.quality_rules(docs)
    assert sorted(out.columns) == ["base_failed", "doc_id", "kept", "rule_metrics", "rule_words", "text"]
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[x.doc_id] for x in out.filter("kept").collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    for x in out.collect():
        m = x.rule_metrics
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, x.base_failed) == plain(texts[x.doc_id]), texts[x.doc_id]
        assert x.kept in (True, False) and not (x.kept and x.base_failed)
    assert out.filter("kept").count() == sum(x.kept for x in out.collect())
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chats_round_trip(spark):
    r = random.Random(2)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "<\\s>", "<\\\\/s>", "\\", "é🙂", "\n", " ", "ok", "<", "["]
    rows = [(c, t, r.choice(["user", "assistant", "system", "[INST] x"]), "".join(r.choices(bits, k=r.randint(0, 12))), 0) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(100, 0, None, None, 0), (100, 0, None, None, 0), (None, 1, "assistant", "a", 0), (None, None, "user", "b", 0), (7, 99, "assistant", "z" * 100_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    got = {x.conv_id: x for x in chat.format_chats(df).collect()}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
    assert set(got) == {x[0] for x in rows}
    for c, x in got.items():
        mine = sorted((q for q in rows if q[0] == c), key=key)
        assert chat.parse(x.formatted) == [(q[2] or "", q[3] or "") for q in mine]
        assert [chat.unescape(x.formatted[s.start : s.end]) for s in x.loss] == [q[3] or "" for q in mine if q[2] == "assistant"]
    back = {x.conv_id: x for x in chat.read_back(chat.format_chats(df)).collect()}
    assert back[100].n_turns == 2 and back[100].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    same = "<p>" + "x" * 200
    rows = [(1, "http://B.example.org:80/a?q#f", same, 0), (2, "http://a.example.org/", same, 0), (3, None, None, 0), (4, "not a url\nx", "", 0), (5, "https://u@x.y:8443/p", "é" * 60, 0), (6, "http://a.example.org/", same, 0), (None, "http://n/", "no id", 0), (2, "http://a.example.org/", same, 0), (9, "http://z/", "tiny", 0), (8, "http://z/", "tiny", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, k int")
    archive = warc.write(pages, block_lines=2, archive_bytes=500)
    got = warc.fetch(archive, warc.lookup(archive, pages)).collect()
    assert len(got) == len(rows)
    first = {same: 1}
    for x in got:
        html = next((h or "") for i, u, h, _ in rows if i == x.page_id)
        assert x.payload_bytes == len(html.encode()) and x.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        ref = first.get(html)
        assert (x.record_type, x.refers_to) == (("revisit", ref) if ref not in (None, x.page_id) else ("response", None))
        assert x.url in [u for i, u, _, _ in rows if i == x.page_id]
        assert x.record_type == "revisit" or bytes(x.payload).decode() == html
    assert warc.surt("http://B.example.org:80/a?q#f") == "org,example,b)/a?q"
    assert warc.lookup(archive, spark.createDataFrame([("http://none/", 1)], "url string, page_id long")).count() == 0
    empty = warc.write(pages.limit(0))
    assert warc.fetch(empty, warc.lookup(empty, pages.limit(0))).count() == 0
    assert pages.agg(F.count("*")).first()[0] == len(rows)


def test_warc_captures_of_one_key_come_once(spark):
    rows = [(1, "http://a.org/x", "one" * 50), (1, "https://a.org/x", "two" * 50), (None, None, "p"), (None, None, "q" * 200), (1, "http://A.org:80/x#f", "one" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(pages)
    got = warc.fetch(archive, warc.lookup(archive, pages.unionAll(pages)))
    assert sorted((str(x.page_id), bytes(x.payload or b"").decode(), x.record_type) for x in got.collect()) == sorted((str(i), h, "response") for i, _, h in rows)
    assert archive.shards.agg(F.sum("n")).first()[0] == 5 and archive.shards.agg(F.sum("bytes")).first()[0] > 500
