import random

import numpy as np

from readroute.llm.common import split_key
from readroute.llm.language import BUCKET_BITS, identify, learn, subword_counts, train
from pyspark.sql import functions as F

SYLLABLES = {"en": ["the", "ing", "and", "ou"], "fr": ["eau", "oi", "é", "que"], "de": ["sch", "ung", "ß", "ie"]}


def speech(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=240):
    rows = [(i, speech(lang := list(SYLLABLES)[i % 3], 5 + i % 60, i), lang, "s", 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy_and_rejection(spark):
    docs = corpus(spark)
    model = learn(docs.filter(split_key(F.col("doc_id"), 4) != 2))
    rows = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(split_key(F.col("doc_id"), 4) == 2).collect()
    assert len(rows) > 30 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in rows)
    shuffled = identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("de")), model)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, identify(docs, model).collect()))
    odd = spark.createDataFrame([(1, "@@@ 123 +++"), (2, None), (3, ""), (4, "é"), (4, "é"), (None, "the " * 40000)], "doc_id long, text string").selectExpr("*", "1 as letter", "2 as id")
    found = {(r.doc_id, r.lang_pred) for r in identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en")} <= found and identify(odd, model).count() == 6
    assert all(r.rejected and r.score == 0 for r in identify(odd, model).collect() if r.lang_pred == "und")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = learn(none)
    assert identify(none, model).count() == 0
    assert [r.lang_pred for r in identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == ["und"]
    one = train([("en", np.array([1, 2]), np.array([3.0, 1.0], np.float32))])
    assert one.languages == ["en"]


def test_counts_stay_inside_texts():
    data = np.frombuffer("abcdXYab".encode(), np.uint8)
    got = [c for _, _, c in subword_counts(data, np.array([0, 4, 6, 6, 8]))]
    assert got[0].sum(1).tolist() == [2, 0, 0, 0] and got[0].shape == (4, 1 << BUCKET_BITS)


def test_rejected_rows_are_the_doubtful_ones(spark):
    """A fifth of the texts mix two languages under a random label: those the model rejects are mostly among them."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        lang = list(SYLLABLES)[i % 3]
        other = rng.choice([x for x in SYLLABLES if x != lang])
        mixed = i % 5 == 0
        text = speech(lang, 15, i) + " " + speech(other if mixed else lang, 15, 10_000 + i)
        rows.append((i, text, rng.choice([lang, other]) if mixed else lang, mixed))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mixed boolean")
    model = learn(docs.filter(split_key(F.col("doc_id"), 4) != 2), of_one=300, sample=2000)
    found = identify(docs, model).join(docs.drop("text"), "doc_id").filter(split_key(F.col("doc_id"), 4) == 2).collect()
    accepted = [r for r in found if not r.rejected]
    assert len(accepted) > 0.6 * len(found) and sum(r.rejected for r in found) > 5
    assert sum(r.lang_pred == r.lang for r in accepted) >= 0.96 * len(accepted)
    assert sum(r.mixed for r in found if r.rejected) >= 0.7 * sum(r.rejected for r in found)


def test_every_language_is_learned(spark):
    """More languages than 400, each by a word of its own, among nulls, copies and a hot id."""
    rows = [(k * 10 + j, f"zz{k:03d}q " * 8, f"l{k:03d}") for k in range(450) for j in range(3)] + [(None, "zz001q " * 8, "l001")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as drawn", "'x' as TEXT", "2 as n")
    assert learn(docs).languages == sorted({r[2] for r in rows})


def test_scores_are_the_definition(spark):
    """Mean of the embeddings of trigrams under the softmax, counted one by one."""
    docs = corpus(spark, 60)
    model = learn(docs)
    for r in identify(docs, model).collect()[:10]:
        text = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\r\x0b\x0c" else b for b in {d.doc_id: d.text for d in docs.collect()}[r.doc_id].encode())
        buckets = [((text[i] | text[i + 1] << 8 | text[i + 2] << 16) * 0x9E3779B1 % 2**32) >> (32 - BUCKET_BITS) for i in range(len(text) - 2)]
        z = (model.table[buckets].astype(float).mean(0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert model.languages[p.argmax()] == r.lang_pred and abs(p.max() - r.score) < 1e-4
