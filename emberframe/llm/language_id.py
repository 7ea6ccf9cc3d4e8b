"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Subwords are runs of 2 to 4 code points of a text in lower case, other signs being one space.
SIZES = (2, 3, 4)
BUCKETS = 1 << 15
#: Long texts are read in slices of so many code points, which overlap by the longest subword.
SLICE = 1 << 18
SPACE = 32


@dataclass(frozen=True)
class Model:
    """What a trained model needs to score: one row of class scores a bucket, a temperature, a floor."""

    languages: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    floor: float


@functools.lru_cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _slices(text: str) -> Iterator[np.ndarray]:
    """Subword buckets of a whole text, slice by slice; none if it has no letter."""
    letters, last = _letters(), None
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(letters[points], points, SPACE)
        gap = points == SPACE
        keep = ~(gap & np.concatenate(([last is None or last[-1] == SPACE], gap[:-1])))
        points = points[keep]
        if not len(points):
            continue
        whole = np.concatenate((last if last is not None else np.array([SPACE], np.uint32), points)).astype(np.uint64)
        fresh = len(points)
        for size in SIZES:
            n = len(whole) - size + 1
            n_new = min(n, fresh)
            if n_new <= 0:
                continue
            first = n - n_new
            value = np.full(n_new, size, dtype=np.uint64)
            for k in range(size):
                value = (value + whole[first + k : first + k + n_new]) * np.uint64(0x9E3779B97F4A7C15)
            yield (value >> np.uint64(49)).astype(np.int32)
        last = whole[-max(SIZES) + 1 :].astype(np.uint32)


def _counts(text: str | None) -> np.ndarray | None:
    """Share of each bucket among the subwords of a text; None without a letter."""
    total = np.zeros(BUCKETS, dtype=np.float32)
    for buckets in _slices(text or ""):
        total += np.bincount(buckets, minlength=BUCKETS)
    n = total.sum()
    return total / n if n else None


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, ids, shares, keys = [], [], [], []
        for key, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            x = _counts(text)
            if x is not None:
                at = np.flatnonzero(x)
                keys.append(key)
                langs.append(lang)
                ids.append(at.astype(np.int32).tobytes())
                shares.append(x[at].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())],
            ["key", "lang", "ids", "shares"],
        )


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """(key, lang, ids, shares) of at most ``per_language`` distinct texts of each language, chosen by text hash."""
    rows = labelled.where("lang is not null and text is not null").select(
        F.xxhash64("text", "lang").alias("key"), "lang", "text"
    )
    chosen = (
        rows.select("key", "lang")
        .distinct()
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
        .where(F.col("n") <= per_language)
        .select("key")
    )
    texts = rows.join(chosen, "key", "left_semi").dropDuplicates(["key"])
    return texts.mapInArrow(_features, "key long, lang string, ids binary, shares binary")


def train(
    labelled: DataFrame, per_language: int = 600, width: int = 16, epochs: int = 12, rate: float = 40.0, batch: int = 32
) -> Model:
    """Fit on columns text, lang; rows without either teach nothing.

    The fit sees a bounded sample: ``per_language`` distinct whole texts a language, as sparse shares of
    ``BUCKETS`` buckets. A document's vector is the average of its subwords' embeddings; a linear softmax
    over it is trained by stochastic gradient descent. Every fifth sampled text is kept out of the fit; on
    those the temperature is calibrated by log loss and the floor of rejection is set below 999 in 1000 of
    the scores of right answers (0.5 at most). Without labels every text is unknown.
    """
    rows = sorted(sample(labelled, per_language).collect(), key=lambda r: r.key)
    names = tuple(sorted({r.lang for r in rows}))
    if not rows:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.5)
    rng = np.random.default_rng(7)
    ids = [np.frombuffer(r.ids, np.int32) for r in rows]
    shares = [np.frombuffer(r.shares, np.float32) for r in rows]
    labels = np.array([names.index(r.lang) for r in rows])

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for k, i in enumerate(which):
            x[k, ids[i]] = shares[i]
        return x

    held = np.arange(len(rows)) % 5 == 4
    fit, check = np.flatnonzero(~held), np.flatnonzero(held)
    inner = (rng.standard_normal((BUCKETS, width)) / np.sqrt(width)).astype(np.float32)
    outer = np.zeros((width, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = dense(part)
            mean = x @ inner
            off = _softmax(mean @ outer + bias)
            off[np.arange(len(part)), labels[part]] -= 1
            off /= len(part)
            back = off @ outer.T
            outer -= min(step, 4.0) * (mean.T @ off)
            bias -= 0.1 * off.sum(axis=0)
            inner -= step * (x.T @ back)
    scores = inner @ outer
    temperature, floor = 1.0, 0.5
    if len(check):
        logits = np.concatenate([dense(check[k : k + 64]) @ scores + bias for k in range(0, len(check), 64)])
        right = labels[check]
        grid = 2.0 ** np.arange(-4, 5, 0.5)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(check)), right] + 1e-9).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        sure = _softmax(logits / temperature)
        good = sure.argmax(axis=1) == right
        if good.any():
            floor = float(min(0.5, np.quantile(sure.max(axis=1)[good], 0.001)))
    return Model(names, scores.astype(np.float32), bias, temperature, floor * 0.9)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_text(model: Model, text: str | None) -> tuple[str, float]:
    """Language and calibrated score of one whole text; unknown with 0 without a letter or a model."""
    total, n = np.zeros(len(model.languages)), 0
    for buckets in _slices(text or ""):
        total += model.scores[buckets].sum(axis=0, dtype=np.float64)
        n += len(buckets)
    if not n or not model.languages:
        return UNKNOWN, 0.0
    p = _softmax(((total / n + model.bias) / model.temperature)[None, :])[0]
    return model.languages[int(p.argmax())], float(p.max())


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry`` with lang_pred, score and rejected for every row of ``docs`` (column text).

    lang_pred is a language of the model, or ``und`` with score 0 where the text is null or has no letter.
    rejected: it is unknown or the score is under the model's floor. Repeated rows get equal answers, other
    columns are ignored, an empty table gives an empty result. One pass, no shuffle; the model is a fixed
    ``BUCKETS`` rows of one number a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in carry}
    names = list(carry)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows in batches:
            found = [score_text(own, t) for t in rows.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(i + 1) for i in range(len(names))),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[0] == UNKNOWN or x[1] < own.floor for x in found], pa.bool_()),
                ],
                [*names, "lang_pred", "score", "rejected"],
            )

    schema = "".join(f"`{c}` {k}, " for c, k in kinds.items()) + "lang_pred string, score double, rejected boolean"
    return docs.select(F.col("text").alias("_read"), *names).mapInArrow(answer, schema)
