import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from readroute.llm import lexical_search as ls


def terms(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold)


def expected(items, docs, k=10):
    """{(item, rank): (id, score)} by scoring every document; of rows alike in an item's id the terms of all."""
    found = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = {}
    for item, own in wanted.items():
        rows = []
        for i, t in found:
            tf, score = Counter(t), 0
            for x in own & tf.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                m = 100 - 90 + (90 * len(t) * n_docs) // total
                score += w * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score > 0:
                rows.append((-score, i is not None, i if i is not None else 0))
        for rank, (s, some, i) in enumerate(sorted(rows)[:k], 1):
            out[item, rank] = (i if some else None, -s)
    return out


def table(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string")


@pytest.mark.parametrize("size", [ls.BLOCK_ENTRIES, 30])
def test_as_by_brute_force(spark, prose, size):
    docs = [(k, prose(5 + 7 * k % 90, k % 70, 120)) for k in range(150)] + [(200, None), (201, ""), (202, "..."), (203, "AAA-bbb aaa BBB ccc9"), (204, "ÀÉ àé ß"), (None, "aaa"), (205, "aaa " * 20000), (206, "aaa"), (206, "aaa"), (3, "aaa")]
    items = [(k, prose(12, 100 + k, 120)) for k in range(25)] + [(50, "aaa bbb"), (50, "ccc9"), (51, None), (52, "?!"), (53, "nothing-here"), (54, "àé"), (None, "aaa"), (55, "the the the")]
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in ls.lexical_search(table(spark, items, "item_id").selectExpr("*", "1 as TEXT", "2 as id"), table(spark, docs, "doc_id").selectExpr("*", "1 as score", "2 as rank"), block_entries=size).collect()}
    assert got == expected(items, docs)


def test_equal_scores_go_by_id(spark):
    docs = [(k, "same words here") for k in range(400, 0, -1)]
    rows = ls.lexical_search(table(spark, [(1, "same"), (2, "words here")], "item_id"), table(spark, docs + [(k, "other") for k in range(1000, 1400)], "doc_id").repartition(4), block_entries=100).collect()
    assert {(r.item_id, r["rank"]): r.doc_id for r in rows} == {(i, k): k for i in (1, 2) for k in range(1, 11)}


def test_empty_tables_and_named_ids(spark):
    some, none = table(spark, [(1, "a b")], "item_id"), table(spark, [], "doc_id")
    assert ls.lexical_search(some, none).count() == 0
    assert ls.lexical_search(some.filter("item_id > 5"), some.withColumnRenamed("item_id", "doc_id")).count() == 0
    docs = spark.createDataFrame([("x", "a b"), ("w", "a b"), ("y", "c")], "doc_id string, text string")
    rows = ls.lexical_search(spark.createDataFrame([("i", "a")], "item_id string, text string"), docs, k=1).collect()
    assert [tuple(r)[:3] for r in rows] == [("i", 1, "w")]


def test_queries_in_blocks(spark, prose, monkeypatch):
    monkeypatch.setattr(ls, "QUERY_TERMS", 20)
    docs, items = [(k, prose(30, k, 60)) for k in range(40)], [(k, prose(8, 50 + k, 60)) for k in range(9)]
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in ls.lexical_search(table(spark, items, "item_id"), table(spark, docs, "doc_id")).collect()}
    assert got == expected(items, docs)


def test_bounds_leave_most_documents_out():
    """Rare terms decide: few documents are scored, and none of the best is lost."""
    rng = np.random.default_rng(1)
    n, n_terms = 20_000, 60
    doc = np.repeat(np.arange(n), 12)
    term = np.concatenate([rng.choice(50, 12, False) for _ in range(n)])
    rare = rng.random(len(term)) < 0.002
    term[rare] = 50 + rng.integers(0, 10, rare.sum())
    impact = np.where(term >= 50, 900_000, 5_000 * (1 + term % 7)) * rng.integers(1, 4, len(term))
    block, ids = ls.Block(doc, term, impact, n, n_terms), pa.array(np.arange(n))
    scored = []
    for query in ([1, 2, 3, 51, 55], [50, 4, 5], [7, 8, 9]):
        best = ls.Best(10)
        add = best.add
        best.add = lambda s, i, p: (scored.append(len(s)), add(s, i, p))
        block.search(np.array(query), best, ids)
        total = np.bincount(doc, impact * np.isin(term, query), n)
        want = sorted(((-int(s), k) for k, s in enumerate(total) if s))[:10]
        assert [(s, i) for s, _, i in best.rows] == want
        if query[0] != 7:
            assert sum(scored) < 0.2 * n, scored
        scored.clear()
