"""Spelling variants: words one edit apart, found by finite-state composition.

The vocabulary acceptor is composed with a transducer that makes exactly one edit and with the acceptor
again; what the composition accepts are the near pairs. It is enumerated in parts. A part starts in the state
that the acceptor reaches over one half of a word: with a shorter word of m code points, either both words
share the first m // 2 (the edit comes later), or they share the last m - m // 2 (the edit comes before;
the acceptor is then entered from its end). So every part is a small minimised acceptor over the other
halves, and no task holds the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators.settle import Generations, settle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = "A-Za-zÀ-ÿ"
#: Code points of a long text that are taken at once; words counted by a task before it passes them on.
SLICE, HELD = 1 << 20, 200_000


def _slices(text: str, outside: re.Pattern) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        cut = outside.search(text, at + SLICE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _altered(doc_id, run: str, modulus: int) -> str:
    """A lower-cased run, less one code point where the checksum of document and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, min_chars: int, modulus: int) -> DataFrame:
    """(word, n): altered lower-cased letter runs of at least ``min_chars`` code points, counted over all texts.

    A null or empty text has none; a null doc_id counts as empty text in the checksum. Each task passes on
    partial counts, so a word that fills the corpus is a row a task.
    """
    runs, outside = re.compile(f"[{LETTERS}]{{{min_chars},}}"), re.compile(f"[^{LETTERS}]")

    def flushed(totals: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["word", "n"])
        totals.clear()
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in _slices(text.as_py() or "", outside):
                    for run, n in Counter(runs.findall(part)).items():
                        word = _altered(doc_id, run.lower() if run.isascii() else run.translate(LOWER), modulus)
                        if len(word) >= min_chars:
                            totals[word] += n
                    if len(totals) > HELD:
                        yield flushed(totals)
        yield flushed(totals)

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """Minimised acceptor of sorted distinct strings: arcs by state, equal right languages are one state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        open_arcs: list[dict[str, int]] = [{}]
        open_final = [False]
        last = ""
        for word in words:
            shared = 0
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
            self._close(open_arcs, open_final, last, shared)
            open_arcs += [{} for _ in word[shared:]]
            open_final += [False] * (len(word) - shared)
            open_final[-1] = True
            last = word
        self._close(open_arcs, open_final, last, 0)
        self.start = self._state(open_arcs[0], open_final[0])

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return at

    def _close(self, arcs: list[dict[str, int]], final: list[bool], word: str, depth: int) -> None:
        """States of the last word below ``depth`` get no more arcs."""
        while len(arcs) > depth + 1:
            own, ends = arcs.pop(), final.pop()
            arcs[-1][word[len(arcs) - 1]] = self._state(own, ends)


class OneEdit:
    """The acceptor composed with the one-edit transducer and the acceptor again.

    Pairs are of ``length`` and ``length`` code points (one replaced) or ``length`` + 1 and ``length`` (one
    deleted). Of a run of equal code points the last is the deleted one, so each pair is accepted once.
    """

    def __init__(self, acceptor: Acceptor, length: int):
        self.a, self.length = acceptor, length
        self._tails: dict[tuple[int, int, int], list[str]] = {}

    def tails(self, p: int, q: int, left: int) -> list[str]:
        """Strings of ``left`` code points that are accepted from both states, after the edit."""
        if left == 0:
            return [""] if self.a.final[p] and self.a.final[q] else []
        key = (p, q, left)
        found = self._tails.get(key)
        if found is None:
            other = self.a.arcs[q]
            found = [x + t for x, r in self.a.arcs[p].items() if x in other for t in self.tails(r, other[x], left - 1)]
            self._tails[key] = found
        return found

    def pairs(self, last_deletion: bool) -> Iterator[tuple[str, str]]:
        """Accepted pairs; without ``last_deletion`` none whose last code point alone is deleted."""
        ahead = [(self.a.start, "")]
        while ahead:
            state, path = ahead.pop()
            arcs = list(self.a.arcs[state].items())
            left = self.length - len(path)
            for i, (x, p) in enumerate(arcs):
                for y, q in arcs[i + 1 :] if left else ():
                    for t in self.tails(p, q, left - 1):
                        yield path + x + t, path + y + t
                if left or last_deletion:
                    for t in self.tails(p, state, left):
                        if not t.startswith(x):
                            yield path + x + t, path + t
                if left:
                    ahead.append((p, path + x))


def _near(m: int, at_end: bool, part: str, rests: list[str], counts: list[int]) -> Iterator[tuple]:
    """(word, near words, count of the best, the best) within one part; the best has the largest count, then the least word."""
    acceptor = Acceptor(rests)
    count = dict(zip(rests, counts))
    whole = (lambda x: x + part) if at_end else (lambda x: part + x)
    best: dict[str, list] = {}
    for pair in OneEdit(acceptor, m - len(part)).pairs(last_deletion=not at_end):
        for own, other in (pair, pair[::-1]):
            rank = (-count[other], whole(other))
            kept = best.get(own)
            if kept is None:
                best[own] = [1, rank]
            else:
                kept[0] += 1
                if rank < kept[1]:
                    kept[1] = rank
    for own, (n, rank) in best.items():
        yield whole(own), n, -rank[0], rank[1]


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and rest; parts of one word are passed over."""
    key, rests, counts, out = None, [], [], []
    for batch in batches:
        for *at, rest, n in zip(*(c.to_pylist() for c in batch.columns)):
            if at != key:
                if len(rests) > 1:
                    out.extend(_near(*key, rests, counts))
                key, rests, counts = at, [], []
            rests.append(rest)
            counts.append(n)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NEAR.types)], schema=_NEAR)
            out = []
    if len(rests) > 1:
        out.extend(_near(*key, rests, counts))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NEAR.types)], schema=_NEAR)


def near_words(vocabulary: DataFrame, min_chars: int) -> DataFrame:
    """(word, n_near, form_n, form): how many words of ``vocabulary`` (word, n; distinct) differ by one edit, and the best of them.

    Only words that have a near one. Each word goes to four parts at most: as the shorter and as the longer
    of a pair, by its first and by its last half.
    """
    length = F.char_length("word")
    shorter = F.filter(F.array(length, length - 1), lambda m: m >= min_chars)
    placed = vocabulary.select("word", "n", F.explode(shorter).alias("m")).select(
        "word", "n", "m", F.explode(F.array(F.lit(False), F.lit(True))).alias("at_end")
    )
    head = F.floor(F.col("m") / 2).cast("int")
    cut = F.when(F.col("at_end"), length - (F.col("m") - head)).otherwise(head)
    first, second = F.substring("word", F.lit(1), cut), F.substring("word", cut + 1, length)
    part = F.when(F.col("at_end"), second).otherwise(first)
    rest = F.when(F.col("at_end"), first).otherwise(second)
    keyed = placed.select("m", "at_end", part.alias("part"), rest.alias("rest"), "n")
    sorted_parts = keyed.repartition("m", "at_end", "part").sortWithinPartitions("m", "at_end", "part", "rest")
    found = sorted_parts.mapInArrow(_parts, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form"))
    sums = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return sums.select("word", "n_near", (-F.col("best.rank")).alias("form_n"), "best.form")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, by doubling; counts double along a chain, so few rounds do."""
    kept = Generations(forms.sparkSession)
    roots = kept.put(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = kept.put(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not roots.where("moved").limit(1).count():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, modulus: int = 97, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts, with the form each is a variant of.

    Words are letter runs (ASCII and Latin-1), A-Z lower-cased, one in ``modulus`` less a code point by a
    checksum of document and run, that have ``min_chars`` code points and occur ``min_count`` times over all
    texts. Near words differ by one inserted, deleted or replaced code point. The form is the near word of
    the largest count (ties: smallest by code points) if that is ``factor`` times the word's own; root follows
    forms to the last. form and form_n are null without a form, root is then the word itself.

    Null and empty texts have no words; repeated rows count each; other columns are ignored; an empty table
    gives an empty result. Long texts are read in slices between words. A part's words share half their
    code points, so parts are many and small; a root that many words share is met by joins Spark can split.
    """
    vocabulary = settle(word_counts(docs, min_chars, modulus).where(F.col("n") >= min_count))
    near = near_words(vocabulary, min_chars)
    good = F.col("form_n") >= factor * F.col("n")
    known = settle(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, F.col("form")).alias("form"),
            F.when(good, F.col("form_n")).alias("form_n"),
        )
    )
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
