"""Operators without SQL against brute force, an exact round trip or held-out accuracy."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from emberframe.llm import components, decontamination, language_id, line_runs, ngram_join, packing, queries, tokens, wavelet
from tests.llm.cases import documents, edge_rows
from tests.oracle import ROOT

WHITE = " \t\n\v\f\r"


def split_words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in "".join(c.lower() if c.isascii() else c for c in text).split(" ") if w]


def shingle_set(text, width):
    words = split_words(text or "")
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_groups(rows, width, percent):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[root(k)].append(i)
    return sorted((i, len(s), min(low[root(k)])) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 50)])
def test_similar_groups(spark, width, percent):
    rows = edge_rows()
    got = ngram_join.similar_groups(documents(spark, rows), width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups([r[:2] for r in rows], width, percent)


def test_similar_groups_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3(spark, f"{ROOT}/sf0.001").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 4, 85)


def brute_links(rows, width, percent):
    """Other distinct shingle sets that each row's set links to."""
    sets = [shingle_set(t, width) for _, t in rows]
    classes = {s for s in sets if s}
    links = {s: sum(x != s and 100 * len(x & s) >= percent * len(x | s) for x in classes) for s in classes}
    return sorted((i, links.get(s, 0)) for (i, _), s in zip(rows, sets))


def test_links_within_groups_all_count(spark, monkeypatch):
    words = [f"w{i}" for i in range(100)]
    near = [(k, " ".join([*words[:k], "edit", *words[k + 1 :]])) for k in range(0, 100, 3)]
    near += [(200 + k, " ".join(words[: 60 + 2 * k])) for k in range(20)]
    near += [(300, "p q r s t u"), (301, "p q r s t u v"), (302, None), (303, near[0][1]), (303, near[0][1])]
    want = brute_links(near, 4, 85)
    assert max(n for _, n in want) > 20
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 7)
    got = ngram_join.similar_groups(documents(spark, [(i, t, "en", "s", 0, *"wxyz") for i, t in near]), 4, 85).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == want


@pytest.mark.parametrize("cells", [1 << 22, 300])
def test_blocks_meet_pairwise(monkeypatch, cells):
    monkeypatch.setattr(ngram_join, "MATRIX", cells)
    rng = np.random.default_rng(1)
    base = rng.integers(1 << 60, size=120)
    sets = [np.unique(np.where(rng.random(120) < 0.04, rng.integers(1 << 60, size=120), base)[: rng.integers(95, 121)]) for _ in range(40)]
    like = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    want = {k: sum(like(a, b) for j, b in enumerate(sets) if j != k) for k, a in enumerate(sets)}
    rows = [(7, *sorted((k % 3, o)), k % 3, k, s) for k, s in enumerate(sets) for o in range(3)]
    rows = sorted(rows + rows[:5], key=lambda r: r[:3])
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 11]), kinds)], list("abcdef")) for i in range(0, len(rows), 11)
    ]
    got = Counter()
    for batch in ngram_join._degrees(85)(batches):
        for sign, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got[sign] += n
    assert dict(got) == want and max(want.values()) > 20


def test_only_near_pairs_of_a_bucket_are_rows():
    rng = np.random.default_rng(2)
    base = rng.integers(1 << 60, size=150, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(150) < rng.choice([0.02, 0.2]), rng.integers(1 << 60, size=150, dtype=np.uint64), base)) for _ in range(120)]
    parity = [np.packbits(np.bincount((s % np.uint64(ngram_join.PARITY)).astype(np.int64), minlength=ngram_join.PARITY) & 1).tobytes() for s in sets]
    like = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if a % 40 != b % 40 and like(sets[a], sets[b])}
    rows = [(g, *sorted((k % 3, o)), k % 3, k, len(sets[k]), 0, k % 40, parity[k], [5, 9]) for g in (5, 9) for k in range(120) for o in range(3)]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    names = ["gram", "one", "two", "block", "sign", "n", "at", "grp", "parity", "first"]
    rows = sorted(rows + rows[:40], key=lambda r: r[:5])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 50]), kinds)], names) for i in range(0, len(rows), 50)]
    found = [(a, b) for batch in ngram_join._candidates(85)(batches) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
    assert want <= set(found) and len(want) > 500
    assert len(set(found)) < 2 * len(want) and len(found) == len(set(found))


def test_similar_groups_of_nothing(spark):
    assert ngram_join.similar_groups(documents(spark, [])).count() == 0
    row = ngram_join.similar_groups(documents(spark, [(None, "a b c", None, None, None, *"wxyz")])).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in row] == [(None, 1, None)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500 + i, 501 + i) for i in range(40)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_line_dedup_edges(spark):
    rows = edge_rows()
    holders, docs_of = {}, defaultdict(int)
    keys = lambda t: ["".join(c.lower() if c.isascii() else c for c in x.strip(WHITE)) for x in (t or "").split("\n")]
    for i, t, *_ in rows:
        for k in set(keys(t)):
            if len(k) >= 20:
                docs_of[k] += 1
                holders[k] = max(i, holders.get(k, i))
    want = []
    for i, t, *_ in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if not (docs_of[k] >= 3 and holders[k] != i)]
        want.append((i, "\n".join(kept), len((t or "").split("\n"))))
    got = line_runs.drop_repeated_lines(documents(spark, rows), carry=("lang",)).collect()
    assert sorted((r.doc_id, r.text, r.n_lines) for r in got) == sorted(want)
    assert any(r.n_dropped for r in got)
    assert line_runs.drop_repeated_lines(documents(spark, [])).count() == 0


def contained(rows, items, width=5, percent=80):
    words = lambda t: "".join(c if not c.isascii() or c.isalnum() else " " for c in (t or "").lower()).split(" ")
    out = []
    for item, text in items:
        own = [w for w in words(text) if w]
        if not own:
            continue
        w = min(width, len(own))
        want = {tuple(own[i : i + w]) for i in range(len(own) - w + 1)}
        for i, t, *_ in rows:
            have = [x for x in words(t) if x]
            n = len(want & {tuple(have[k : k + w]) for k in range(len(have) - w + 1)})
            if 100 * n >= percent * len(want):
                out.append((i, item, n, len(want)))
    return sorted(out)


def test_contained_items(spark, monkeypatch):
    rows = edge_rows()
    long = next(r[1] for r in rows if r[0] == 67).split(" ")
    items = [(1, " ".join(long[500:540])), (2, " ".join(long[900:930]).upper() + "!"), (3, None), (4, ""), (5, "one, TWO")]
    items += [(6, " ".join(long[70:90] + ["zzz"] + long[91:120])), (7, "never seen words in any of these texts"), (1, " ".join(long[5:30]))]
    table = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    want = contained(rows, items)
    assert len({x[1] for x in want}) >= 4
    for size in (decontamination.BLOCK_SHINGLES, 30):
        monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", size)
        got = decontamination.contained_items(documents(spark, rows), table).collect()
        assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got) == want
    assert decontamination.contained_items(documents(spark, []), table).count() == 0
    assert decontamination.contained_items(documents(spark, rows), table.limit(0)).count() == 0


def test_contained_items_of_the_table(spark):
    root = f"{ROOT}/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op2(spark, root).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got) == contained(rows, items)


def whole_ids(texts):
    own = Tokenizer.from_file(tokens.default_path())
    return [x.ids for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_whole_encoding():
    texts = [r[1] for r in edge_rows()] + ["a\n b", " a \n\nb.\nc", "x.\n", "\n", "don't.\nI'll go!!\n", "é. b ?", "1.5, 2.\n3", "a ́b. 'tis", "  a", "b  c  "]
    own = tokens.Encoder(tokens.default_path())
    for text, want in zip(texts, whole_ids(texts)):
        assert np.frombuffer(own.encode(text), own.kind).tolist() == want, text


def test_encoder_of_many_texts_keeps_their_order(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 40)
    texts = [None, "", "a b c", "one two. three\nfour " * 9 + "end", "x   y", None, "b, c d", "  ", "one two. three", "a b c", ""]
    own = tokens.Encoder(tokens.default_path())
    got = [np.frombuffer(x, own.kind).tolist() for x in own.encode_all(texts)]
    assert got == whole_ids(texts)
    assert list(own.encode_all([])) == []


def test_encoder_on_the_table(spark):
    texts = [r.text for r in spark.read.parquet(f"{ROOT}/sf0.001/documents.parquet").select("text").collect()]
    own = tokens.Encoder(tokens.default_path())
    for text, want in zip(texts, whole_ids(texts)):
        assert np.frombuffer(own.encode(text), own.kind).tolist() == want


def check_packing(rows, got, limits, size=None):
    by_doc = Counter(r[0] for r in rows)
    ids = dict(zip([r[0] for r in rows], whole_ids([r[1] for r in rows])))
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    size = size or limits.tokens
    for doc, n in by_doc.items():
        own = np.array([*ids[doc], 0], "<u4")
        lengths = [len(own)] if len(own) <= size else [len(own) % size] * (len(own) % size > 0) + [size] * (len(own) // size)
        at = 0
        for k, x in enumerate(lengths):
            want[(doc, k, at, x, zlib.crc32(own[at : at + x].tobytes()))] += n
            at += x
    assert pieces == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limits.tokens
        assert limits.documents is None or len(parts) <= limits.documents
        assert limits.attention is None or sum(x * x for _, x in parts) <= limits.attention
    return len(sequences)


@pytest.mark.parametrize(
    "limits",
    [
        packing.Limits(),
        packing.Limits(tokens=256, documents=3, weights=(1.0, 0.5, 0.0)),
        packing.Limits(tokens=128, documents=5, attention=9000, weights=(1.0, 0.3, 0.3), score="dot"),
    ],
)
def test_packing(spark, limits):
    rows = edge_rows()
    got = packing.pack(documents(spark, rows), tokens.default_path(), 0, limits).collect()
    n = check_packing(rows, got, limits, 94 if limits.attention else None)
    if limits == packing.Limits():
        assert n == -(-sum(r.length for r in got) // 2048)
    assert packing.pack(documents(spark, []), tokens.default_path()).count() == 0


def test_plan_is_best_fit():
    """Against best fit item by item, on the number of sequences."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = sorted(rng.integers(1, 101, 400).tolist(), reverse=True)
        bins = []
        for x in lengths:
            fits = [b for b in bins if b[0] >= x]
            if fits:
                min(fits)[0] -= x
            else:
                bins.append([100 - x])
        rows = packing.plan(Counter(lengths), packing.Limits(tokens=100))
        used = Counter()
        for length, first, end, sequence, offset in rows:
            for k in range(end - first):
                assert used[sequence + k] == offset
                used[sequence + k] += length
        assert max(used.values()) <= 100 and sum(used.values()) == sum(lengths)
        assert len(used) <= len(bins) * 1.02 + 1


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 700, 5000).astype(np.uint16), np.zeros(3, np.uint16), np.array([9], np.uint32), np.full(600, 1 << 17, np.uint32)):
        own = wavelet.WaveletMatrix.read(wavelet.WaveletMatrix.build(ids, np.array([len(ids)])).image())
        assert (own.ids() == ids).all() and own.ends.tolist() == [len(ids)]
        for i in {0, len(ids) // 2, len(ids) - 1}:
            token = int(ids[i])
            assert own.access(i) == token
            assert own.rank(token, i) == int((ids[:i] == token).sum())
            assert own.count(token) == int((ids == token).sum())
            assert own.select(token, own.rank(token, i)) == i
        assert own.count(1 << 20) == 0
        with pytest.raises(IndexError):
            own.select(int(ids[0]), len(ids))
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.read(b"other")


@pytest.mark.parametrize("shard", [1 << 21, 500])
def test_wavelet_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", shard)
    rows = edge_rows()
    got = wavelet.read_shards(wavelet.write_shards(documents(spark, rows), tokens.default_path())).collect()
    ids = dict(zip([r[0] for r in rows], whole_ids([r[1] for r in rows])))
    at, want = 0, []
    for doc in sorted(r[0] for r in rows):
        own = np.array([*ids[doc], 2], "<u4")
        want.append((doc, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    assert sorted(tuple(r) for r in got) == want
    assert wavelet.read_shards(wavelet.write_shards(documents(spark, []), tokens.default_path())).count() == 0


def test_language_id_held_out(spark):
    root = f"{ROOT}/sf0.01"
    lang = dict(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang").collect())
    got = [r for r in queries.op9(spark, root).collect() if r.held_out]
    assert len(got) > 100 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got]) > 0.97


def test_language_id_edges(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert got[60].lang_pred == got[61].lang_pred == got[66].lang_pred == "und" and got[60].rejected and got[60].score == 0
    assert got[63].lang_pred == "en" and not got[63].rejected
    nothing = language_id.train(documents(spark, []))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_language_slices_do_not_matter(monkeypatch):
    text = "Ein Satz, der – über viele – Stücke geht; und noch 12 einer. " * 50
    whole = np.sort(np.concatenate(list(language_id._slices(text))))
    monkeypatch.setattr(language_id, "SLICE", 17)
    assert (np.sort(np.concatenate(list(language_id._slices(text)))) == whole).all()
