import re

import numpy as np
from pyspark.sql import functions as F

from readroute.llm.quality import FLOORS, MIN_GROUP, REWEIGHT, chi_square, chi_square_quantile, consistency, estimate, quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def test_counts_and_base_rules(docs_of, prose):
    texts = ["", None, "one two", "a b c a b c a b", prose(60), "x\ny\nx\n\n\nX\n x", "é漢字 😀 #*$ %&|<>", "the the the the", prose(200) + "\n" + prose(200), "w " * 60000, prose(30, 1) + " " + prose(30, 1), "a\x1cb  c"]
    docs = docs_of([*enumerate(texts), (4, texts[4]), (None, "z")]).selectExpr("*", "1 as id", "'q' as g", "0 as x1", "true as kept")
    rows = quality(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = brute(texts[r.doc_id] if r.doc_id is not None else "z")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality(docs_of([])).count() == 0


def test_outliers_go_and_clean_texts_stay(docs_of, prose):
    rng = np.random.default_rng(1)
    clean = [prose(int(rng.integers(60, 400)), seed) for seed in range(300)]
    junk = [re.sub(r"(\w+)", r"\1%%%", prose(120, 700 + s)) for s in range(10)]
    rows = quality(docs_of(clean + junk)).collect()
    verdict = {r.doc_id: r.kept for r in rows}
    assert sum(verdict[i] for i in range(300)) >= 299
    assert not any(verdict[300 + i] for i in range(10))


def brute_estimate(rows, h=0.5):
    """Centre and inverse scatter by the definition: the half of least determinant among many starts, then one reweighting."""
    rows, floors = np.asarray(rows), np.diag(np.square(FLOORS))
    n, best = len(rows), None
    rng = np.random.default_rng(0)

    def moments(part, grow=1.0):
        return part.mean(0), np.cov(part.T, bias=True) * grow + floors

    def distances(m, c):
        return np.einsum("ni,ij,nj->n", rows - m, np.linalg.inv(c), rows - m)

    for _ in range(200):
        m, c = moments(rows[rng.choice(n, 6, replace=False)])
        for _ in range(40):
            near = rows[np.argsort(distances(m, c), kind="stable")[: -(-n // 2)]]
            m, c = moments(near)
        fall = np.linalg.slogdet(c)[1]
        if best is None or fall < best[0]:
            best = (fall, near)
    m, c = moments(best[1], consistency(h))
    return moments(rows[distances(m, c) <= chi_square_quantile(1 - REWEIGHT)], consistency(REWEIGHT))


def vectors(spark, groups):
    rows = [(g, *map(float, x)) for g, part in groups.items() for x in part]
    return spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double, x4 double")


def test_estimate_is_the_minimum_over_many_starts(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5))
    groups = {"small": rng.normal(size=(40, 5)) @ mix, "third": rng.normal(size=(120, 5)) @ mix}
    groups["third"][80:, 0] = 30 + rng.normal(size=40) * 0.2
    found = {r.g: r for r in estimate(vectors(spark, groups)).collect()}
    for g, part in groups.items():
        m, c = brute_estimate(part)
        inverse = np.linalg.inv(c)
        own = np.array([[found[g][f"p{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
        centre = np.array([found[g][f"m{i}"] for i in range(5)])
        # halves that differ by a few rows may both be local minima: compare what the estimates say of the rows
        far = lambda m, p: np.einsum("ni,ij,nj->n", part - m, p, part - m)
        want, got = far(m, inverse), far(centre, own)
        assert np.corrcoef(want, got)[0, 1] > 0.95 and 0.7 < np.median(got) / np.median(want) < 1.4
    d = far(centre, own)
    limit = chi_square_quantile(1e-6)
    assert (d[80:] > limit).all() and (d[:80] <= limit).all()  # a third of junk goes


def test_chi_square():
    assert abs(chi_square_quantile(0.5) - 4.3515) < 1e-3 and abs(chi_square_quantile(0.025) - 12.8325) < 1e-3
    assert abs(chi_square(14.067, 1) - 0.05) < 1e-4  # seven degrees
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 5))
    near = x[np.argsort((x**2).sum(1))[:100_000]]
    assert abs(consistency(0.5) * near.var() - 1) < 0.02


def test_group_sizes_and_partitioning(spark, docs_of, prose):
    texts = [prose(80 + i % 40, i) for i in range(60)]
    docs = docs_of(texts).withColumn("source", F.when(F.col("doc_id") < MIN_GROUP - 1, "few").when(F.col("doc_id") < 40, "some").otherwise(None)).selectExpr("*", "'x' as LANG", "1 as m0", "2 as bin")
    one = sorted(map(tuple, quality(docs.coalesce(1)).collect()))
    many = sorted(map(tuple, quality(docs.repartition(7)).collect()))
    assert [r[:-2] for r in one] == [r[:-2] for r in many] and np.allclose([r[-2] for r in one], [r[-2] for r in many], rtol=1e-6)
    assert len(one) == 60 and sum(r[-1] for r in one) >= 59
