"""Centroid clustering, spelling variants and chat formatting against brute force and SQL on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import centroids, chat, queries, spelling
from emberframe.operators import ordered
from tests.llm.cases import documents, edge_rows
from tests.oracle import connect, difference


def stored_as(spark, folder, **tables):
    for name, df in tables.items():
        df.coalesce(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def views(folder, *names):
    con = connect("/nowhere")
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con


# centroid clustering


def brute_clusters(rows, k, rounds, seed):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for j, own in members.items():
            centres[j] = [sum(col) // len(own) for col in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    each = Counter()
    for _, j, d in found:
        each[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, each[j], sum(each.values()), digest[j]) for i, j, d in found), key=repr)


def vectors(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 7) for _ in range(64)]) for i in range(n)]
    rows += [(1000 + i, [0.125] * 64) for i in range(40)]  # equal vectors under many ids
    rows += [(2000, [0.5] * 63), (2001, [0.5] * 65), (2002, None), (2003, [])]
    rows += [(2004, [float("nan")] + [0.0] * 63), (2005, [float("inf")] * 64), (2006, [None] + [1.0] * 63)]
    rows += [(None, [-0.25] * 64), (None, [-0.26] * 64), rows[0], rows[0], (2007, [0.0] * 64), (2008, [-0.0] * 64)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, v string, dots string, cluster string, distance string"


def embedding_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)


def test_clusters_match_brute_force_and_sql(spark, tmp_path):
    rows = vectors(150)
    folder = stored_as(spark, tmp_path, embeddings=embedding_table(spark, rows))
    got = queries.op11(spark, folder)
    assert difference(got, views(folder, "embeddings"), queries.ORACLES["op11_centroid_clustering"]) is None
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows, 40, 5, "2")


@pytest.mark.parametrize("n", [0, 1, 12])
def test_clusters_of_few_vectors(spark, tmp_path, n):
    rows = vectors(40)[:n]
    folder = stored_as(spark, tmp_path, embeddings=embedding_table(spark, rows))
    assert sorted((tuple(r) for r in queries.op11(spark, folder).collect()), key=repr) == brute_clusters(rows, 40, 5, "2")


def test_products_follow_the_moved_components(spark):
    whole = centroids.whole_vectors(embedding_table(spark, vectors(30)), F.col("vec_id"), F.col("embedding"), 64, 256)
    before = [[1] * 64, [2] * 64]
    after = [[1] * 64, [2] * 63 + [9]]
    moves = centroids._moves(before, after)
    assert [(j, at.tolist(), change.tolist()) for j, at, change in moves] == [(1, [63], [7])]
    state = centroids._assign(whole, centroids._moves([[0] * 64] * 2, before), before)
    for r in centroids._assign(state, moves, after).collect():
        assert r.dots == [sum(a * b for a, b in zip(r.v, c)) for c in after]


def test_components_too_large_stop(spark):
    big = embedding_table(spark, [(1, [1e30] * 64)])
    with pytest.raises(Exception, match="component too large"):
        centroids.whole_vectors(big, F.col("vec_id"), F.col("embedding"), 64, 256).collect()


def test_no_rows_are_shuffled_to_be_assigned(spark):
    whole = centroids.whole_vectors(embedding_table(spark, vectors(5)).coalesce(1), F.col("vec_id"), F.col("embedding"), 64, 256)
    start = centroids.hashed_start(whole, 3, "2")
    plan = centroids._assign(whole, centroids._moves([[0] * 64] * 3, start), start)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


# spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near = defaultdict(list)
    for a, b in combinations(sorted(n), 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variant_rows(seed=5, n=80):
    rng = random.Random(seed)
    roots = ["".join(rng.choice("abcéÿz") for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "abababab"]
    signs = "abcdeéÉzÀ×"

    def worn(word):
        k = rng.randrange(len(word) + 1)
        return rng.choice([word, word, word.upper(), word[:k] + rng.choice(signs) + word[k:], word[:k] + word[k + 1 :], word[:k] + rng.choice(signs) + word[k + 1 :]])

    rows = [(i, rng.choice([" ", "-", "1", "\n"]).join(worn(rng.choice(roots)) for _ in range(rng.randint(1, 90)))) for i in range(n)]
    rows += [(None, None), (None, "aaaaa aaaaa"), (n, ""), (n + 1, "  ..."), (n + 2, "abcde " * 30_000), rows[0], rows[0]]
    # counts that double along a chain of forms
    for k in range(9):
        rows.append((n + 10, ("q" * k + "w" * (9 - k) + " ") * (3 << k)))
    return rows


def test_variants_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 1000)
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = variant_rows()
    df = documents(spark, [(i, t, "en", "s", 1, "x", "y", "z", "w") for i, t in rows])
    got = spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert max(x[4] for x in want) > 3 and any(x[1] and x[1] != x[2] for x in want)


def test_variants_match_sql(spark, tmp_path):
    rows = edge_rows() + [(500 + i, t, "en", "s", 1, "x", "y", "z", "w") for i, (_, t) in enumerate(variant_rows(9))]
    folder = stored_as(spark, tmp_path, documents=documents(spark, rows))
    assert difference(queries.op12(spark, folder), views(folder, "documents"), queries.ORACLES["op12_spelling_variants"]) is None


def test_variants_of_nothing(spark):
    assert spelling.variants(documents(spark, [])).count() == 0


def accepted(a, state=None, path=""):
    state = a.start if state is None else state
    if a.final[state]:
        yield path
    for x, q in a.arcs[state].items():
        yield from accepted(a, q, path + x)


def test_acceptor_is_minimal_and_composition_exact():
    rng = random.Random(1)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([4, 5]))) for _ in range(rng.randint(1, 60))})
        a = spelling.Acceptor(words)
        assert sorted(accepted(a)) == words
        languages = [tuple(sorted(accepted(a, q))) for q in range(len(a.arcs))]
        assert len(set(languages)) == len(languages)
        want = {frozenset(p) for p in combinations(words, 2) if one_edit(*p) and min(map(len, p)) == 4}
        got = [frozenset(p) for p in spelling.OneEdit(a, 4).pairs(last_deletion=True)]
        assert len(got) == len(set(got)) and set(got) == want


# chat formatting

TURNS = "conv_id long, turn long, role string, text string, place string, segments string, refused string"


def turn_rows():
    rng = random.Random(2)
    marks = [*chat.CHAT.marks, "\x1b", "\x1b0", "\x1b1", "\n", "<", "|im_end|>", "é", "ab "]
    junk = lambda: "".join(rng.choice(marks) for _ in range(rng.randint(0, 9)))
    rows = []
    for c in range(30):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * rng.randint(1, 4)
        if c % 5 == 4:
            rng.shuffle(roles)
        rows += [(c, t, role, junk()) for t, role in enumerate(roles)]
    rows += [(100, 0, "user", None), (100, 1, "assistant", ""), (101, 5, None, "no role"), (101, None, "tool\n<|im_end|>\x1b", "x")]
    rows += [(None, 0, "user", "of a null id"), (None, 1, "assistant", "<|im_start|>user\n"), (102, 3, "user", "tie"), (102, 3, "user", "tie"), (102, 3, "assistant", "tie")]
    rows += [(103, t, ("user", "assistant")[t % 2], "long " * 50) for t in range(400)] + [(104, 0, "user", "x" * 300_000)]
    rng.shuffle(rows)
    return rows


def brute_conversations(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in turns.items():
        own.sort()
        before, refused = "", None
        for k, (_, _, role, _) in enumerate(own, 1):
            rule = chat.CHAT.roles.get(role)
            if refused is None and (rule is None or before not in rule.after or (k > 1 and before == "")):
                refused = k
            before = role
        learned = "".join(t for *_, r, t in own if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), digest("".join(f"{r}\n{t}\n" for *_, r, t in own)), len(learned), digest(learned), refused)
    return out


@pytest.mark.parametrize("rows_per_chunk", [None, 7])
def test_conversations_read_back(spark, monkeypatch, rows_per_chunk):
    if rows_per_chunk:
        scan = ordered.scan
        monkeypatch.setattr(ordered, "scan", lambda *a, **k: scan(*a, **k, rows_per_chunk=rows_per_chunk))
    rows = turn_rows()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TURNS).repartition(4)
    formatted = chat.format_turns(df, chat.CHAT)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.refused_at) for r in chat.read_back(formatted, chat.CHAT).collect()}
    assert got == brute_conversations(rows)


def test_control_strings_only_where_the_template_puts_them(spark):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in turn_rows()], TURNS)
    for r in chat.format_turns(df, chat.CHAT).collect():
        first, text, last = (s.text for s in r.segments)
        assert [s.loss for s in r.segments] == [False, r.role == "assistant", False]
        assert not any(m in text for m in chat.CHAT.marks) and last == chat.CHAT.closing
        whole = first + text + last
        assert whole.count(chat.CHAT.opening) == whole.count(chat.CHAT.closing) == 1
        assert not any(m in whole for m in chat.CHAT.controls)


def test_chat_query_matches_sql(spark, tmp_path):
    rows = [r for r in turn_rows() if r[0] not in (101, None)]
    folder = stored_as(spark, tmp_path, conversations=spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TURNS))
    assert difference(queries.op13(spark, folder), views(folder, "conversations"), queries.ORACLES["op13_chat_format"]) is None


def test_chat_of_nothing(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], TURNS), chat.CHAT), chat.CHAT).count() == 0


def test_templates_that_could_be_ambiguous_are_refused():
    for closing, controls in (("x", ()), ("<a<b>", ()), ("<end>", ("e<",)), ("<\x1b>", ())):
        with pytest.raises(ValueError):
            chat.Template("<go>", "\n", closing, {}, controls)
