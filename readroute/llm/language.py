"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its byte trigrams (white space as a
blank, A-Z folded), hashed into a table; a softmax over that mean gives the languages.
Both tables are trained by stochastic gradient descent in numpy on the driver, from a
sample of bounded size. A slice of it is held back: there the softmax's temperature is
fitted and the score found under which a prediction counts as rejected.

As the model is linear, the product of the two tables is all that a task needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readroute.llm.common import LOWER, SPACE, bounded_sample, pick, text_chunks

BUCKET_BITS = 13
DIMENSIONS = 16
#: Texts that the model is fitted on, about: in all, most of one language, and least of one even if the sum grows.
SAMPLE, SAMPLE_OF_ONE, LEAST_OF_ONE = 4000, 800, 20
#: Share of right predictions that those over the rejection score must reach on the held-back slice.
PRECISION = 0.99
#: Share of the softmax's weights that each step takes off.
DECAY = 1e-3
#: Texts counted at once.
_GROUP = 128
_FOLD = LOWER.copy()
_FOLD[SPACE] = 0x20


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


def subword_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, end, counts of its subword buckets) of groups of texts."""
    folded = _FOLD[data].astype(np.uint32)
    code = folded[:-2] | folded[1:-1] << np.uint32(8) | folded[2:] << np.uint32(16) if len(folded) > 2 else np.zeros(0, np.uint32)
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    size = 1 << BUCKET_BITS
    for lo in range(0, len(offsets) - 1, _GROUP):
        hi = min(lo + _GROUP, len(offsets) - 1)
        n = np.maximum(offsets[lo + 1 : hi + 1] - offsets[lo:hi] - 2, 0)
        owner = np.repeat(np.arange(hi - lo), n)
        at = np.arange(n.sum()) + np.repeat(offsets[lo:hi] - np.cumsum(n) + n, n)
        yield lo, hi, np.bincount(owner * size + bucket[at], minlength=(hi - lo) * size).reshape(hi - lo, size)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _short(gradient: np.ndarray) -> np.ndarray:
    """A gradient of at most unit length, so that doubtful labels can't drive the two tables apart."""
    return gradient / max(1.0, float(np.linalg.norm(gradient)))


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit on (language, buckets, counts) rows. Rows are shuffled; a fifth calibrates."""
    rng = np.random.default_rng(seed)
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    index = {x: i for i, x in enumerate(languages)}
    rows = sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    size = 1 << BUCKET_BITS

    def batch(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(which), size), np.float32)
        for k, i in enumerate(which):
            _, buckets, counts = rows[i]
            x[k, buckets] = counts / max(counts.sum(), 1)
        return x, np.array([index[rows[i][0]] for i in which])

    embed = rng.uniform(-1, 1, (size, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(fit)
        for k in range(0, len(fit), 16):
            x, y = batch(fit[k : k + 16])
            mean = x @ embed
            off = _softmax(mean @ weight + bias)
            off[np.arange(len(y)), y] -= 1
            back = off @ weight.T
            weight -= step * _short(mean.T @ off + DECAY * weight)
            bias -= step * 0.1 * off.mean(0)
            embed -= step * _short(20 * (x.T @ back))  # a bucket holds a small share of a mean
    table = embed @ weight
    temperature, reject = 1.0, 0.0
    if len(held):
        logits, truth = [], []
        for k in range(0, len(held), 64):
            x, y = batch(held[k : k + 64])
            logits.append(x @ table + bias)
            truth.append(y)
        logit, y = np.concatenate(logits), np.concatenate(truth)
        loss = {t: -np.log(_softmax(logit / t)[np.arange(len(y)), y] + 1e-9).mean() for t in np.geomspace(0.2, 20, 60)}
        temperature = float(min(loss, key=loss.get))
        p = _softmax(logit / temperature)
        score, right = p.max(1), p.argmax(1) == y
        down = np.argsort(-score)
        good = np.flatnonzero(np.cumsum(right[down]) >= PRECISION * np.arange(1, len(y) + 1))
        reject = float(score[down][good[-1]]) if len(good) else 1.0
    return Model(languages, table.astype(np.float32), bias, temperature, reject)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, of_one: int = SAMPLE_OF_ONE, least_of_one: int = LEAST_OF_ONE) -> Model:
    """Fit on about `sample` rows with a text and a language, drawn evenly by hash of id and text.

    Every language is learned: the sample has as many rows of each, but `least_of_one` at
    least, so it grows with the number of languages, never with that of rows. Rows alike
    in id, text and language teach once.
    """
    known = pick(labelled, id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string")).filter("text is not null and lang is not null")
    counts = known.groupBy("lang").agg(F.greatest(F.approx_count_distinct(F.xxhash64("id", "text"), 0.02), F.lit(1)).alias("n"))
    languages = counts.count()
    if not languages:
        return train([])
    each = min(of_one, max(sample // languages, least_of_one))
    known = known.join(F.broadcast(counts), "lang")  # a row for each language

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_chunks(batch, "text"):
                for lo, hi, counted in subword_counts(data, offsets):
                    full = [np.flatnonzero(c) for c in counted]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(2).slice(lo, hi - lo), pa.array([f.tolist() for f in full], pa.list_(pa.int32())), pa.array([c[f].tolist() for c, f in zip(counted, full, strict=True)], pa.list_(pa.int32()))],
                        names=["lang", "buckets", "counts"],
                    )

    drawn = bounded_sample(known, ["id", "text", "lang"], F.lit(float(each)) / F.col("n")).select("id", "text", "lang").mapInArrow(extract, "lang string, buckets array<int>, counts array<int>")
    return train([(r[0], np.array(r[1], np.int64), np.array(r[2], np.float32)) for r in drawn.toLocalIterator()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of each whole text, from the text alone.

    lang_pred is `und` with score 0 if the text is null or has no letter (or no
    language was learned). rejected: und, or the calibrated probability is under the
    model's rejection score. Of languages of equal probability the first by name is
    predicted. Texts of any length are read whole. One row for each input row, repeated
    ids included; other columns are not read, whatever their names.
    A text with a letter but under three bytes has no subword: the languages' shares decide.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, "und"], dtype=object)
        for batch in batches:
            for rows, data, offsets in text_chunks(batch, "text"):
                letter = np.array(rows.column(2).fill_null(False))
                pick, score = np.full(rows.num_rows, len(own.languages)), np.zeros(rows.num_rows)
                if own.languages:
                    for lo, hi, counted in subword_counts(data, offsets):
                        mean = counted.astype(np.float32) @ own.table / np.maximum(counted.sum(1, keepdims=True), 1)
                        p = _softmax((mean.astype(np.float64) + own.bias) / own.temperature)
                        pick[lo:hi], score[lo:hi] = p.argmax(1), p.max(1)
                pick[~letter], score[~letter] = len(own.languages), 0
                rejected = (score < own.reject_below) | (pick == len(own.languages))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[pick], pa.string()), pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    picked = pick(docs, id=id_col, text=text_col).withColumn("letter", F.col("text").rlike(r"\p{L}"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(predict, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
