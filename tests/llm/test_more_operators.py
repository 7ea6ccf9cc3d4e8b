"""Suffix dedup, fingerprints, secrets and URL verdicts against brute force and SQL on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from emberframe.llm import queries, secret_scan, suffix_dedup, syncmers, url_filter
from tests.llm.cases import documents, edge_rows
from tests.oracle import ROOT, connect, difference


def brute_spans(rows, span=400):
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    n = Counter(raw[k : k + span] for _, raw in raws for k in range(len(raw) - span + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - span + 1):
            if n[raw[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, kept))
    return sorted(out, key=repr)


def spans_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [8 << 20, 1500])
def test_repeated_spans(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abé d") for _ in range(n))
    part, edge = text(700), text(399)
    rows = [(1, None), (2, ""), (3, text(900)), (4, text(50) + part + text(60)), (5, part[100:]), (6, "x" * 900), (7, "y" * 400)]
    rows += [(8, text(30) + edge), (9, edge + text(500)), (10, part), (10, part), (11, text(100) + part[:401] + "é" + part[:420]), (12, "y" * 401)]
    for k in range(6):
        at = 20 + 90 * k
        rows.append((20 + k, text(5) + part[:at] + "!" + part[at + 1 :]))
    rows.append((None, part[1:] + "z"))
    rows = [(i, t, "en", "s", 1, "x", "y", "z", "w") for i, t in rows]
    assert spans_of(suffix_dedup.drop_repeated_spans(documents(spark, rows))) == brute_spans(rows)


def test_repeated_spans_edges(spark):
    rows = [r for r in edge_rows() if len(r[1] or "") < 5000]
    assert spans_of(suffix_dedup.drop_repeated_spans(documents(spark, rows))) == brute_spans(rows)
    assert suffix_dedup.drop_repeated_spans(documents(spark, [])).count() == 0


def test_repeated_spans_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_spans(rows)]
    assert sorted(tuple(r) for r in queries.op4(spark, f"{ROOT}/sf0.001").collect()) == sorted(want)


def test_texts_are_cut_a_few_rows_at_a_time():
    rows = [(k, "x" * (k % 7), None, None) for k in range(2000)] + [(2000, "y" * 900, 1, [100, 600]), (2001, "z" * 400, 2, None)]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "text", "copies", "runs"])
    out = list(suffix_dedup._removed(iter([whole])))
    assert max(len(b) for b in out) <= suffix_dedup.ROWS
    got = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(2002)) and [r["kept"] for r in got[:2000]] == [t.encode() for _, t, _, _ in rows[:2000]]
    assert [(r["n_removed"], r["n_spans"], r["kept"]) for r in got[2000:]] == [(500, 1, b"y" * 400), (400, 1, b"")]


def test_every_span_holds_an_anchor_chosen_by_itself():
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    at, h = suffix_dedup._anchors(data)
    places = set(at.tolist())
    for k in range(0, len(data) - suffix_dedup.SPAN, 37):
        own, _ = suffix_dedup._anchors(data[k : k + suffix_dedup.SPAN])
        assert len(own) and all(k + x in places for x in own.tolist())


def test_records_go_packed(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    wanted = SimpleNamespace(value=np.full(1 << 22, 255, np.uint8))
    sent = list(suffix_dedup._payload(wanted, 8)(iter([batch])))
    records = sum(2 * (len(t) - 2) // 3 for t in texts)
    size = sum(len(x.as_py()) for b in sent for k in range(2, b.num_columns) for x in b.column(k))
    assert 7 * records < size < 12 * records


def test_filter_of_anchors_grows_with_them(spark):
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 58, 400_000, dtype=np.int64)
    own, others = h[:200_000], h[200_000:]
    df = spark.createDataFrame(pa.table({"h": own}))
    bits = suffix_dedup._filter(df, 1 << 22)
    assert len(bits) == 1 << 19
    assert suffix_dedup._known(own.view(np.uint64), bits).all()
    assert suffix_dedup._known(others.view(np.uint64), bits).mean() < 0.004


def brute_anchors_equal(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return {r.i: r.f for r in df.select("i", syncmers.fingerprint(syncmers.anchors(F.col("text"))).alias("f")).collect()}


def test_fingerprints(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "one", "one two three", " ".join(words), " ".join(words), "zz yy " + " ".join(words), " ".join(words[:60])]
    got = brute_anchors_equal(spark, texts)
    assert got[0] == got[1] == got[2] == "" and got[5] == got[6] and got[3].startswith("0-")
    hashes = lambda f: {x.split("-")[1] for x in f.split(",")}
    assert len(hashes(got[5]) & hashes(got[7])) >= 0.9 * len(hashes(got[5]))
    shift = {x.split("-")[1]: int(x.split("-")[0]) for x in got[7].split(",")}
    assert all(shift[h] == int(p) + 2 for p, h in (x.split("-") for x in got[5].split(",")) if h in shift)
    # a closed syncmer of a part is one of the whole: nothing around it decides
    small = brute_anchors_equal(spark, [" ".join(words[i : i + 4]) for i in range(40)])
    whole = {x.split("-")[1]: int(x.split("-")[0]) for x in got[8].split(",")}
    for i, f in small.items():
        assert (f != "") == (i in whole.values())


def test_fingerprints_keep_all_anchors(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(3000)]
    whole, passage = " ".join(words), " ".join(words[1500:1550])
    line = "the same four words of one line come again "
    moved = " ".join(words[1500:] + words[:1500])
    pairs = [(whole, passage), (whole, whole), (whole, moved), (line * 50, line * 5), (None, ""), ("a b", "a c")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = df.select("i", syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    got = {r.i: r for r in found.select("*", syncmers.likeness(F.col("a"), F.col("b")).alias("like")).collect()}

    def lined_up(found):
        return Counter((x.hash, y.hash, y.place - x.place) for x, y in zip(found, found[1:]))

    for i in range(4):
        one, two = lined_up(got[i].a), lined_up(got[i].b)
        assert got[i].like == pytest.approx((one & two).total() / (one | two).total())
    assert (got[4].like, got[5].like, got[1].like) == (1.0, pytest.approx(1 / 3), 1.0)
    assert got[2].like > 0.99 and got[3].like < 0.2
    assert len(got[0].a) > 1500 and len(got[0].b) > 15
    assert {(x.hash, x.place + 1500) for x in got[0].b} <= {(x.hash, x.place) for x in got[0].a}


def test_long_words_are_cut(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    signs = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(500))
    code = "".join(rng.choice("abcdefgh0123(){};") for _ in range(500))
    text = f" one {code[:16]}\n{code[:17]}  {signs[:40]}\U0001f600 last "
    pairs = [(x, x[:200] + y + x[201:]) for x in (signs, code) for y in ("", "Q", "QRS")] + [(text, text)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    like = syncmers.likeness(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b")))
    got = {r.i: r for r in df.select("i", syncmers.units(F.col("a")).alias("u"), like.alias("like")).collect()}
    assert all(0.85 < got[i].like < 1 for i in range(6)) and got[6].like == 1.0
    want = []
    for w in text.split():
        want += [w] if len(w) <= 16 else [w[k : k + 8] for k in range(len(w) - 7)]
    assert got[6].u == want


def test_neighbours_and_edited_texts(spark):
    rows = edge_rows() + [(None, "no id at all", None, None, None, *"wxyz")]
    got = syncmers.compare_neighbours(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    ids = sorted({r[0] for r in rows if r[0] is not None}, reverse=True) + [None]
    text = {r[0]: r[1] or "" for r in rows}
    want = []
    for r in rows:
        own, after = r[1] or "", text[ids[(ids.index(r[0]) + 1) % len(ids)]]
        k = len(own) // 3
        want.append((r[0], len(own), hashlib.sha256((own[: len(own) - k] + after[:k]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert syncmers.compare_neighbours(documents(spark, [])).count() == 0
    alone = syncmers.compare_neighbours(documents(spark, rows[:1])).collect()
    assert alone[0].near_next == 1.0


def test_fingerprints_tell_edits_from_neighbours(spark):
    got = queries.op5(spark, f"{ROOT}/sf0.001").collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == [] and secret_scan.trigram_query("(abc|x)") == []
    assert {frozenset({"abc"}), frozenset({"xyz"})} == set(secret_scan.trigram_query("(abc|xyz)d?.*"))
    assert len(secret_scan.trigram_query(secret_scan.RULES[0].pattern)) == 6


def brute_secrets(text):
    out = []
    text = text or ""
    for rank, (kind, pattern, group, least) in enumerate(
        (
            ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20),
            ("hex", r"[0-9a-f]+", 0, 24),
        )
    ):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def test_secrets(spark):
    key = "AKIA" + "Q1" * 9
    texts = [None, "", f"é {key} AKIASHORT AKIA{key}", "password=token:abcdefgh Secret : 'abc.def=' api_key=\"123456\" APIKEY=x", "deadbeef" * 4 + " é " + "0" * 23]
    texts += [f"token={'a1' * 20}\ntoken={'b' * 40} passwd:x passwd = yyyyyy", "secret=" * 3 + "k" * 9, "pass word tok en", "x" * 50_000 + " token=abcdef"]
    rows = [(i, t, "en", "s", 1, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[2], None, None, None, *"wxyz"), (3, "token: other1 AKIA", None, None, None, *"wxyz")]
    got = [(r.doc_id, [tuple(x) for x in r.found]) for r in secret_scan.scan(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], brute_secrets(r[1])) for r in rows), key=repr)
    assert secret_scan.scan(documents(spark, [])).count() == 0


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://Example.com/en/1", "https://www.EXAMPLE.com/en/1?a=/x", "http://a.net/es/x#y", "http://net/fr/",
        "http://b.org/1", "http://c.org/2", "http://d.org/3", "http://x.com", "http://badexample.com/en/", "s://h?://i/j", "http://b.org/1",
        "http://e.org/\n/5", "http://www.example.com.org/en/",
    ]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    edges = [("http://b.org/1", "http://hop.org/"), ("http://a.net/es/x#y", "http://hop.org/"), ("http://c.org/2", "http://a.net/es/x#y"),
             ("http://c.org/2", "http://d.org/3"), ("http://q.org/", "http://x.com/k"), ("http://q.org/", "http://e.org/\n/5"),
             ("http://q.org/", "http://net/fr/"), (None, "http://b.org/1")]
    got = {r.page_id: r for r in url_filter.verdicts(pages, rules, spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len(got) == len(urls)
    assert [(got[k].host, got[k].path) for k in (0, 1, 2, 3, 12)] == [("", ""), ("", ""), ("", ""), ("example.com", "/en/1"), ("h", "")]
    assert [got[k].rule for k in (3, 4, 5, 6, 10, 11, 15)] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, "com/", None]
    assert [(got[k].verdict, got[k].via) for k in (7, 8, 9, 13)] == [("block", "alias")] * 4
    assert (got[14].verdict, got[14].via) == ("allow", "alias") and got[6].verdict == "block"
    assert (got[2].verdict, got[2].via) == ("allow", "default")
    none = spark.createDataFrame([], "a string, b string")
    assert url_filter.verdicts(pages.limit(0), rules, none).count() == 0


def test_page_edges(spark):
    html = ["<link rel='canonical' href=\"http://a.org/?x=1&amp;y=2\">", "<META HTTP-EQUIV=refresh content=\"0; URL=http://b.org/\">",
            "<link href='http://c.org/' rel=canonical>", "<link rel=stylesheet href=http://d.org/>", None, "<link rel=canonical href=/local>"]
    pages = spark.createDataFrame([(i, f"http://p.org/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {tuple(r) for r in url_filter.page_edges(pages).collect()}
    assert got == {("http://p.org/0", "http://a.org/?x=1&y=2"), ("http://p.org/1", "http://b.org/"), ("http://p.org/2", "http://c.org/")}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    root = f"{ROOT}/sf0.01"
    assert difference(queries.QUERIES[name](spark, root), connect(root), queries.ORACLES[name]) is None


def test_labels_of_spans_are_distinct():
    found = defaultdict(int)
    for rule in secret_scan.RULES:
        found[rule.kind] += 1
    assert max(found.values()) == 1
