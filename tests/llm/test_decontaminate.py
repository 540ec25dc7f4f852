import random

import numpy as np

from readroute.llm.decontaminate import align, align_many, edit_budget, index, leaks


def semiglobal(p, t):
    """Edits of the best match of p inside t, by the full table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        r = rng.random()
        if r < 0.4:
            s[k] = rng.choice("xyzq")
        elif r < 0.7:
            del s[k]
        else:
            s.insert(k, rng.choice("xyzq"))
    return "".join(s)


def test_alignment_is_the_full_table(prose):
    rng = random.Random(1)
    for seed in range(60):
        p = prose(12, seed)[:60]
        t = "z" * rng.randint(0, 6) + mutate(rng, p, rng.randint(0, 7)) + "z" * rng.randint(0, 6)
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in (p, t))
        want, got = semiglobal(p, t), align(a, b, 8, 20)
        assert (got[0] if got else 9) == min(want, 9)
        if got:
            assert semiglobal(p, t[got[1] : got[2]]) == got[0]


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            if text and item and item.strip():
                fold = lambda s: "".join(" " if c in " \t\n\r" else c.lower() for c in s)
                if semiglobal(fold(item.strip()), fold(text)) <= edit_budget(len(item.strip())):
                    out.add((d, i))
    return out


def test_leaks_against_brute_force(spark, docs_of, prose):
    rng = random.Random(2)
    items = [(i, prose(30, 900 + i)[: rng.randint(60, 160)]) for i in range(8)] + [(50, "qz short"), (51, None), (52, " "), (53, "zqx"), (54, "jumping jacks x")]
    docs = []
    for d in range(60):
        text = prose(50, d)
        if d % 2:
            item = rng.choice(items[:8])[1]
            text = text[:70] + mutate(rng, item, rng.randint(0, edit_budget(len(item)) + 3)) + text[70:]
            text = text.upper() if d % 5 == 0 else text.replace(" ", "\n", 3)
        docs.append((d, text))
    docs += [(104, "a qz Short one"), (105, "zqx"), (106, "the jumpng jacks x of"), (107, "the jumpng jack x of"), (108, "zq x")]
    docs += [(100, ""), (101, None), (102, items[0][1]), (102, items[0][1]), (None, items[1][1]), (103, prose(20000, 4) + items[2][1] + prose(2000, 5) + items[2][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = docs_of(docs).selectExpr("*", "1 as id", "2 as start", "3 as item_id")
    found = [tuple(r) for r in leaks(frame, benchmark).collect()]
    assert {(d, i) for d, i, *_ in found} == brute([x for x in docs if x[0] != 103], items) | {(103, 2)}
    assert sum(d == 103 for d, *_ in found) == 2 and sum(d == 102 for d, *_ in found) == 2
    blocked = leaks(frame, benchmark, block_bytes=200)
    assert sorted(map(tuple, blocked.collect()), key=str) == sorted(found, key=str)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs_of(["a text"]), none).count() == 0
    assert leaks(docs_of([]), none).count() == 0
    assert index([], [], 0.1) == []


def found_in(text, items, share=0.08):
    data = np.frombuffer(text.encode(), np.uint8)
    return [(int(p.ids[i]), a, b, c) for p in index(list(items), [x.encode() for x in items.values()], share) for _, i, a, b, c in p.find(data, np.array([0, len(data)]))]


def test_repeated_characters_against_brute_force():
    rng = random.Random(7)
    for trial in range(40):
        unit = rng.choice(["-", "-=", "ab ", "=-=~"])
        item = (unit * 60)[: rng.randint(17, 70)]
        if trial % 2:
            item = item[:10] + "Q" + item[10:]
        text = "x" * rng.randint(0, 9) + mutate(rng, unit * rng.randint(1, 60), rng.randint(0, 6)) + "y" * rng.randint(0, 9)
        places = found_in(text, {1: item})
        fold = lambda s: s.lower().strip()
        assert bool(places) == (semiglobal(fold(item), text.lower()) <= edit_budget(len(item.strip()))), (item, text)
        for _, a, b, c in places:
            assert semiglobal(fold(item), text[a:b].lower()) == c
        spans = sorted((a, b) for _, a, b, _ in places)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_a_long_rule_of_dashes_is_cheap():
    import resource
    import time

    begun, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    places = found_in("-" * 1_000_000, {1: "-" * 400, 2: "-" * 200 + "Q" + "-" * 30})
    assert sum(i == 1 for i, *_ in places) == 2500 and {c for i, _, _, c in places if i == 2} == {1}
    assert time.time() - begun < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_many_regions_at_once(prose):
    rng = random.Random(9)
    p = np.frombuffer(prose(12, 1)[:60].encode(), np.uint8)
    regions = [np.frombuffer(("z" * rng.randint(0, 6) + mutate(rng, bytes(p).decode(), rng.randint(0, 9)) + "z" * rng.randint(0, 6)).encode(), np.uint8) for _ in range(50)]
    edits, first, last = align_many(p, regions, 8, 20)
    for k, region in enumerate(regions):
        one = align(p, region, 8, 20)
        assert (one or (9,))[0] == edits[k] and (one is None or one[1:] == (first[k], last[k]))
