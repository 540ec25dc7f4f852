"""Toxicity: a factorization machine over hashed terms.

y = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j over the terms present in a text;
the factors let a pair weigh more than its parts, as an insult next to a group does.
Trained in numpy on the driver by mini-batches with adaptive steps, from a bounded
sample of labelled texts; every term bucket of the sample takes part, rare ones with
small steps. A held-back slice of the sample chooses how small, and turns the machine's
value into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readroute.llm.common import NOT_TERM, bounded_sample, pick, text_chunks, word_bounds, word_keys

HASH_BITS = 18
FACTORS = 8
#: Squared gradients that each weight has behind it at the start, which bound the steps of rare terms: the one of least loss on the held-back slice is taken.
CALM = (0.01, 0.1, 1.0)
#: Texts of a mini-batch.
BATCH = 64
#: Most labelled texts that the machine is fitted on.
SAMPLE = 12_000
THRESHOLD = 0.3
#: Standard deviations of difference at which a term's log odds count by half at the start.
SURE = 10.0


@dataclass
class Machine:
    place: np.ndarray  # term bucket -> feature, -1 if none
    w0: float
    w: np.ndarray
    v: np.ndarray
    scale: float
    shift: float


def present_terms(data: np.ndarray, offsets: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term bucket) pairs; with `place`, (text, feature) pairs."""
    starts, ends, bounds = word_bounds(data, offsets, NOT_TERM)
    term = (word_keys(data, starts, ends) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    width = 1 << HASH_BITS
    if place is not None:
        term = place[term]
        text, term = text[term >= 0], term[term >= 0]
    pairs = np.unique(text * width + term)
    return pairs // width, pairs % width


@dataclass
class Batch:
    """Texts as flat (text, feature) entries; features are numbered within the batch."""

    which: np.ndarray
    text: np.ndarray
    bounds: np.ndarray
    own: np.ndarray
    at: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of the entries of each text."""
        total = np.zeros((len(x) + 1, *x.shape[1:]))
        np.cumsum(x, axis=0, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def value(self, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value of each text, sum of its factors)."""
        own = v[self.own]
        xv = self.sums(own[self.at])
        square = (own**2).sum(1)
        return w0 + self.sums(w[self.own][self.at]) + 0.5 * ((xv**2).sum(1) - self.sums(square[self.at])), xv

    def by_feature(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, x, len(self.own))


def _sigmoid(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def train(rows: list[tuple[int, np.ndarray, float]], epochs: int = 15, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Fit on (label, term buckets, weight) rows; a fifth calibrates."""
    rng = np.random.default_rng(seed)
    place = np.full(1 << HASH_BITS, -1, np.int32)
    rows = sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    label = np.array([r[0] for r in rows], float)
    weight = np.array([r[2] for r in rows], float)
    if not len(rows) or label.min() == label.max():
        rest = float(label[0]) if len(rows) else 0.0
        return Machine(place, 0.0, np.zeros(0), np.zeros((0, FACTORS)), 0.0, float(np.log((rest + 0.01) / (1.01 - rest))))
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    n1, n0 = label[fit].sum(), (1 - label[fit]).sum()
    seen = np.zeros((2, 1 << HASH_BITS))
    for i in fit:
        seen[int(label[i]), rows[i][1]] += 1
    share = (seen[0] + seen[1]) / (n0 + n1)
    z = (seen[1] / max(n1, 1) - seen[0] / max(n0, 1)) / np.sqrt(share * (1 - share) * (1 / max(n1, 1) + 1 / max(n0, 1)) + 1e-9)
    terms = np.flatnonzero(seen.sum(0))
    place[terms] = np.arange(len(terms))

    def batch(which: np.ndarray) -> Batch:
        """Only the features that these texts have."""
        lists = [place[rows[i][1]] for i in which]
        lists = [x[x >= 0] for x in lists]
        bounds = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
        own, at = np.unique(np.concatenate([place[:0], *lists]), return_inverse=True)
        return Batch(which, np.repeat(np.arange(len(which)), np.diff(bounds)), bounds, own, at)

    # linear weights begin at the terms' log odds, less where these are not sure
    odds = np.log((seen[1, terms] + 0.5) / (n1 + 1)) - np.log((seen[0, terms] + 0.5) / (n0 + 1))
    sure = z[terms] ** 2 / (z[terms] ** 2 + SURE**2)
    first = rng.normal(0, 0.01, (len(terms), FACTORS))
    batches = [batch(fit[k : k + BATCH]) for k in range(0, len(fit), BATCH)]
    which = held if len(set(label[held])) == 2 else order
    apart = [batch(which[k : k + 256]) for k in range(0, len(which), 256)]

    def fitted(calm: float) -> tuple[float, np.ndarray, np.ndarray]:
        w0, w, v = float(np.log(n1 / n0)), odds * sure, first.copy()
        g0, gw, gv = 1e-6, np.full(len(terms), calm), np.full(v.shape, calm)
        turns = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in turns.permutation(len(batches)):
                b = batches[k]
                y, xv = b.value(w0, w, v)
                off = (_sigmoid(y) - label[b.which]) * weight[b.which] / len(b.which)
                each = b.by_feature(off[b.text])
                d0, dw = off.sum(), each + decay * w[b.own]
                pull = off[:, None] * xv
                dv = np.stack([b.by_feature(pull[b.text, f]) for f in range(FACTORS)], 1) - v[b.own] * each[:, None] + decay * v[b.own]  # x is 0 or 1
                g0 += d0**2
                gw[b.own] += dw**2
                gv[b.own] += dv**2
                w0 -= rate * d0 / np.sqrt(g0)
                w[b.own] -= rate * dw / np.sqrt(gw[b.own])
                v[b.own] -= rate * dv / np.sqrt(gv[b.own])
        return w0, w, v

    def held_values(machine: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
        return np.concatenate([b.value(*machine)[0] for b in apart])

    def loss(y: np.ndarray) -> float:
        """Log loss of the held-back texts under the best logistic curve of their values."""
        line = _curve(y, label[which], weight[which])
        p = np.clip(_sigmoid(np.clip(y, -30, 30) * line[0] + line[1]), 1e-9, 1 - 1e-9)
        return float(-(weight[which] * (label[which] * np.log(p) + (1 - label[which]) * np.log(1 - p))).sum())

    found = [fitted(c) for c in CALM]
    w0, w, v = min(found, key=lambda m: loss(held_values(m)))
    line = _curve(held_values((w0, w, v)), label[which], weight[which])
    return Machine(place, float(w0), w, v, float(line[0]), float(line[1]))


def _curve(y: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(scale, shift) of a logistic curve over values, by Newton steps."""
    top = np.stack([np.clip(y, -30, 30), np.ones(len(y))], 1)
    line = np.array([1.0, 0.0])
    target = label * 0.998 + 0.001
    for _ in range(30):
        p = _sigmoid(top @ line)
        curve = top.T @ (top * (weight * p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
        line = line - np.linalg.solve(curve, top.T @ (weight * (p - target)) + 1e-3 * (line - [1.0, 0.0]))
    return line if np.isfinite(line).all() and line[0] > 0 else np.array([1.0, 0.0])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on at most about `sample` labelled texts, drawn by hash of the id, as many of each class as there are.

    Rows with a null id, text or label teach nothing; of several texts of one id the
    least one teaches, and an id with both labels counts for both. Texts of the commoner
    class weigh more where fewer were drawn.
    """
    known = pick(labels, id=id_col, label=label_col).withColumn("label", F.col("label").cast("int")).filter("id is not null and label in (0, 1)").dropDuplicates()
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    few = min(counts.values(), default=0)
    room = {k: max(sample // 2, sample - few) if n > few else sample // 2 for k, n in counts.items()}
    rates = {k: min(1.0, room[k] / n) for k, n in counts.items()}
    rate = F.when(F.col("label") == 1, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0)))
    drawn = F.broadcast(bounded_sample(known, ["id", "label"], rate))  # bounded by `sample`
    texts = pick(docs, id=id_col, text=text_col).filter("text is not null").join(drawn, "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_chunks(batch, "text"):
                text, term = present_terms(data, offsets)
                cut = np.searchsorted(text, np.arange(rows.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(1), lists], names=["label", "terms"])

    found = texts.select("text", "label").mapInArrow(extract, "label int, terms array<int>")
    return train([(r[0], np.array(r[1], np.int64), 1 / rates[r[0]]) for r in found.toLocalIterator()])


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of each whole text, from the text alone.

    A null or empty text has no terms and gets the score of none; texts of any length are
    scored whole and those of the same terms alike. One row for each input row, repeated
    ids included; other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for rows, data, offsets in text_chunks(batch, "text"):
                n = rows.num_rows
                text, term = present_terms(data, offsets, own.place) if len(own.w) else (np.zeros(0, int), np.zeros(0, int))
                y = np.full(n, own.w0)
                if len(text):
                    y += np.bincount(text, own.w[term], n)
                    for f in range(own.v.shape[1]):
                        part = own.v[term, f]
                        y += 0.5 * (np.bincount(text, part, n) ** 2 - np.bincount(text, part**2, n))
                p = _sigmoid(np.clip(y, -30, 30) * own.scale + own.shift)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    picked = pick(docs, id=id_col, text=text_col)
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(score, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
