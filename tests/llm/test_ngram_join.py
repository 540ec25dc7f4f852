import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from readroute.llm import components as cc
from readroute.llm import ngram_join as nj
from readroute.llm.components import components, local_forest


def shingles(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", fold)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(docs):
    """{(id, text)}: rows by all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [x for x in low[find(i)] if x is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def family(seed, n_texts):
    rng, docs = random.Random(seed), []
    while len(docs) < n_texts:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 5, 8, 9, 14, 30, 60, 150, 400]))]
        for _ in range(rng.randint(1, 6)):
            docs.append((len(docs), " ".join(edited(rng, words, rng.choice([0, 0.01, 0.02, 0.03, 0.04])) if rng.random() < 0.8 else words)))
    return docs


@pytest.mark.parametrize("block", [1500, 6])
def test_against_all_pairs(docs_of, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK_SETS", block)
    monkeypatch.setattr(nj, "BROADCAST_SETS", nj.BROADCAST_SETS if block > 6 else 0)
    docs = family(block, 130) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1005, "a"), (None, "a b"), (None, "z z"), (7, "dup of id"), (7, "another text of that id")]
    docs += [(None, " ".join(f"n{k}w{i}" for i in range(30))) for k in range(5)] + [(None, " ".join(f"n{k}w{i}" for i in range(31))) for k in range(5)] + [(None, "n n n n n n")] * 4
    long = [f"w{i % 997}" for i in range(20000)]
    docs += [(2000, " ".join(long)), (2001, " ".join(edited(random.Random(1), long, 0.0005)))]
    base = [f"v{i}" for i in range(60)]
    docs += [(3000 + k, " ".join(edited(random.Random(k), base, 0.01))) for k in range(40)]
    found = nj.ngram_join(docs_of(docs).selectExpr("*", "1 as id", "2 as sid", "3 as component_id", "4 as h", "'x' as TEXT"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs)


def test_empty_table(docs_of):
    assert nj.ngram_join(docs_of([])).count() == 0
    assert [tuple(r) for r in nj.ngram_join(docs_of([(5, None)])).collect()] == [(5, 0, 5)]


def test_tasks_follow_the_keys_and_small_rows_take_few_files(docs_of, monkeypatch):
    """Short texts have several part keys a shingle; a later round has those of a few bands only."""
    monkeypatch.setattr(nj, "KEYS_PER_TASK", 2000)
    emit, write, rounds, written = nj._emit, nj.materialize, [], []
    monkeypatch.setattr(nj, "_emit", lambda *a: rounds.append(a) or emit(*a))
    monkeypatch.setattr(nj, "materialize", lambda df: written.append(write(df)) or written[-1])
    rng = random.Random(5)
    docs = docs_of([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))) for i in range(2000)]).repartition(40)
    assert nj.ngram_join(docs).count() == 2000
    held = Counter()
    for r in docs.select("text").mapInArrow(emit(*rounds[0]), "kind int, task int, blob binary").filter("kind = 0").collect():
        held[r.task] += len(nj._unpack(bytes(r.blob))[1])
    assert max(held.values()) <= nj.KEYS_PER_TASK
    assert len(written[0].inputFiles()) <= 4  # not one for each of 40 partitions
    sizes = docs.sparkSession.createDataFrame([(8,)] * 1000 + [(4000,)] * 20, "n long")
    band = int(np.searchsorted(nj.LEAST, 8, "right")) - 1
    assert nj.key_tasks(sizes) == 52 and nj.key_tasks(sizes, [band]) == nj.key_tasks(sizes, [band - 1, band]) == 24
    assert nj.key_tasks(sizes, [band + 1]) == nj.key_tasks(sizes.limit(0)) == 4


def test_bands_and_parts_lose_no_pair():
    assert all(nj.LEAST[j + 1] > 1.25 * (nj.LEAST[j] - 1) for j in range(len(nj.LEAST) - 1))
    rng = np.random.default_rng(0)
    for a in [4, 5, 7, 12, 40, 90, 300]:
        for _ in range(60):
            x = np.sort(rng.integers(0, 1 << 63, a, dtype=np.uint64) * np.uint64(2))
            most = next(d for d in range(a, -1, -1) if nj.linked(a - d // 2, a, a - d // 2 + (d + 1) // 2))
            gone, new = most // 2, (most + 1) // 2
            y = np.sort(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            keys, bounds = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
            band = np.searchsorted(nj.LEAST, min(len(x), len(y)), "right") - 1
            for salt in range(8):
                owner, digest, need = nj.part_keys(keys, bounds, np.array([band, band]), salt)
                shared = set(digest[owner == 0]) & set(digest[owner == 1])
                assert len(shared) >= need.max()
                if need.max() > 0:
                    break


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = sorted((np.unique(rng.choice(pool, rng.integers(5, 200))) for _ in range(40)), key=len)
    size, maps = np.array([len(s) for s in sets]), nj.Bitmaps(sets)
    for i in range(39):
        real = [len(np.intersect1d(sets[i], s)) for s in sets[i + 1 :]]
        assert (maps.most_shared(i, i + 1, 40, size) >= real).all()


@pytest.mark.parametrize("local", [500_000, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(cc, "LOCAL_EDGES", local)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 1000 + i) for i in range(50)]
    want = {}
    node, root = local_forest(*(np.array(x) for x in zip(*edges)))
    for n, r in zip(node.tolist(), root.tolist()):
        want[n] = r
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for u, v in edges:
        if u != v:
            assert found[u] == found[v] == want.get(u, u) == want.get(v, v)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_whole_table_against_an_exact_count(spark):
    """Every link of sf0.01, found by counting shared shingles of all pairs that share one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    where, root = {}, list(range(len(rows)))
    for i, own in enumerate(sets):
        for x in own:
            where.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        met = Counter(j for x in own for j in where[x] if j < i)
        for j, both in met.items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    want = sorted((r.doc_id, len(sets[i]), low[find(i)]) for i, r in enumerate(rows))
    assert sorted(map(tuple, nj.ngram_join(docs).collect())) == want


def test_only_unsafe_sets_are_dealt_anew(docs_of, monkeypatch):
    """Among enough sets some are unsafe under any salts, so a band dealt anew as a whole would never be done."""
    emit, rounds, few = nj._emit, [], nj.DIFFER + 1 + np.maximum(1, nj.DIFFER // 12)

    def counted(*a):
        rounds.append(a)
        assert len(rounds) < 20

        def with_few_parts(batches):  # in a worker
            parts, nj.PARTS = nj.PARTS, few
            try:
                yield from emit(*a)(batches)
            finally:
                nj.PARTS = parts

        return with_few_parts

    monkeypatch.setattr(nj, "_emit", counted)
    rng, docs = random.Random(11), []
    while len(docs) < 420:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([9, 14, 56, 60, 68, 74, 90]))]
        docs += [(len(docs) + k, " ".join(edited(rng, words, 0.01) if k else words)) for k in range(3)]
    found = nj.ngram_join(docs_of(docs))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs)
    assert len(rounds) > 1
