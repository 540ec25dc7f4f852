import random

import numpy as np

from readroute.llm.common import split_key
from readroute.llm.toxicity import FACTORS, Batch, Machine, learn, present_terms, toxicity, train
from pyspark.sql import functions as F


def value(x, w0, w, v):
    """The machine's value of dense rows, and their sums of factors."""
    xv = x @ v
    return w0 + x @ w + 0.5 * (xv**2 - x @ v**2).sum(1), xv


def test_flat_batches_have_the_values_of_dense_rows():
    rng = np.random.default_rng(4)
    x = (rng.random((9, 30)) < 0.2).astype(float)
    x[3] = 0
    w, v = rng.normal(size=30), rng.normal(size=(30, FACTORS))
    text, term = np.nonzero(x)
    own, at = np.unique(term, return_inverse=True)
    b = Batch(np.arange(9), text, np.searchsorted(text, np.arange(10)), own, at)
    for got, want in zip(b.value(0.3, w, v), value(x, 0.3, w, v)):
        assert np.allclose(got, want)
    assert np.allclose(b.by_feature(np.ones(len(at))), x.sum(0)[own])


def tables(spark, n=900):
    """Toxic only where an insult meets a group: neither word alone tells."""
    rng, docs, labels = random.Random(4), [], []
    words = [f"w{i}" for i in range(80)]
    for i in range(n):
        own = rng.sample(words, rng.randint(8, 25))
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        own += ["vile"] * insult + ["clan"] * group
        rng.shuffle(own)
        docs.append((i, " ".join(own), "en", "s", 1))
        labels.append((i, 1, int(insult and group)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_interaction_is_learned(spark):
    docs, labels = tables(spark)
    machine = learn(docs, labels.filter(split_key(F.col("doc_id"), 4) != 2))
    rows = toxicity(docs, machine).join(labels, "doc_id").filter(split_key(F.col("doc_id"), 4) == 2).collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert len(rows) > 150 and right > 0.95  # a linear rule gets 3/4
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_value_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    x, w, v = (rng.random((5, 7)) < 0.5).astype(float), rng.normal(size=7), rng.normal(size=(7, FACTORS))
    want = [0.3 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(7) for j in range(i + 1, 7)) for r in x]
    assert np.allclose(value(x, 0.3, w, v)[0], want)


def test_executor_score_is_the_machine(spark):
    rng = np.random.default_rng(1)
    place = np.full(1 << 18, -1, np.int32)
    data = np.frombuffer(b"aa bb cc Aa dd", np.uint8)
    _, terms = present_terms(data, np.array([0, len(data)]))
    assert len(terms) == 4
    place[terms] = np.arange(4)
    machine = Machine(place, 0.1, rng.normal(size=4), rng.normal(size=(4, FACTORS)), 1.0, 0.0)
    text, own = present_terms(data, np.array([0, 5, len(data)]), place)
    x = np.zeros((2, 4))
    x[text, own] = 1
    want = 1 / (1 + np.exp(-value(x, machine.w0, machine.w, machine.v)[0]))
    docs = spark.createDataFrame([(0, "aa bb"), (1, " cc Aa dd")], "doc_id long, text string")
    assert np.allclose([r.score for r in sorted(toxicity(docs, machine).collect())], want)


def test_odd_tables(spark):
    docs, labels = tables(spark, 40)
    machine = learn(docs.limit(0), labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "vile " * 50000), (3, "x"), (None, "y")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as label")
    assert toxicity(odd, machine).count() == 5
    machine = learn(docs.unionByName(docs), labels.unionByName(labels.selectExpr("doc_id", "quality", "null as toxic")).selectExpr("*", "'a' as text"))
    assert all(0 <= r.score <= 1 for r in toxicity(odd, machine).collect())
    assert train([(1, np.array([5]), 1.0)]).w.size == 0
    assert toxicity(docs.limit(0), machine).count() == 0


def test_a_pair_of_words_that_are_neutral_alone():
    """Toxic if both words are there or neither, in even numbers, among thousands of words of one class."""
    rng, rows = np.random.default_rng(6), []
    fill = np.arange(1000, 9000)
    for i in range(2000):
        a, b = i % 2, i // 2 % 2
        own = np.concatenate([rng.choice(fill, 12, replace=False), [3] * a, [7] * b]).astype(np.int64)
        rows.append((int(a == b), np.unique(own), 1.0))
    machine = train(rows[:1600])
    right = []
    for label, own, _ in rows[1600:]:
        at = machine.place[own]
        at = at[at >= 0]
        y = value(np.ones((1, len(at))), machine.w0, machine.w[at], machine.v[at])[0][0]
        right.append((y * machine.scale + machine.shift > 0) == label)
    assert machine.place[3] >= 0 and machine.place[7] >= 0 and np.mean(right) > 0.85
