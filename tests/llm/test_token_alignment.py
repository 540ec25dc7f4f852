import hashlib
from collections import Counter

import pytest

from readroute.llm import token_alignment as ta
from readroute.llm.queries import tokenizer_path
from readroute.llm.token_counts import byte_alphabet

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens_of(text, libraries):
    """[(id, start, end)] of both, from the bytes of the tokens alone; None if the bytes differ."""
    a, b = libraries
    alphabet, raw = byte_alphabet(), (" " + text).encode()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_own = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_own = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
    if b"".join(a_own) != raw or b"".join(b_own) != raw:
        return None
    out = []
    for ids, own in ((a_ids, a_own), (b_ids, b_own)):
        at, spans = 0, []
        for i, x in zip(ids, own):
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def expected(texts, libraries):
    all_links, out = Counter(), []
    for t in texts:
        found = tokens_of(t, libraries) if t else None
        if not found:
            out.append(None)
            continue
        a, b = found
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        all_links.update(links)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, lo = [], 0
        for hi in ends:
            groups.append(",".join(str(x[0]) for x in a if lo < x[2] <= hi) + "|" + ",".join(str(y[0]) for y in b if lo < y[2] <= hi))
            lo = hi
        out.append((len(a), len(b), groups, links))
    most = {}
    for (_, y), n in all_links.items():
        most[y] = max(most.get(y, 0), n)
    rows = []
    for found in out:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            rows.append((n_a, n_b, len(groups), len(links), sum(all_links[p] == most[p[1]] for p in links), sum(all_links[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


ODD = [
    None, "", " ", "a", "  two  spaces ", "\n\n x \t y\n", "don't we'll  it's", "naïve Übergröße ñandú", "日本語のテキスト と 混ぜる", "emoji 👩‍👩‍👧‍👦 and 🏳️‍🌈!", "zero\0byte", "  nbsp  x", "em space   y",
    "x▁y", "▁", "plain ▁mark here", "<|endoftext|> and <s> </s> <unk> <0x41>", "12345 6 7.89", "a" * 700, "ab " * 900, "é́̂ combining é", "﻿bom", "a\u001cb c", "tab\tand  　 wide", "line one\nline two", "a  b", "a ́ b", "ﬁ ligature", " sep  x", "x" * 60 + " " + "y" * 60,
]


@pytest.mark.parametrize("held", [ta.PAIRS_HELD, 0])
def test_as_by_brute_force(docs_of, prose, libraries, held):
    texts = [*ODD, *[prose(60, k) for k in range(6)], prose(60, 1), "don't we'll  it's"]
    docs = docs_of(texts).selectExpr("*", "1 as n_a", "2 as id", "3 as row", "'x' as TEXT")
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    got = {r.doc_id: tuple(r[n] for n in names) for r in ta.token_alignment(docs, A, B, pairs_held=held).collect()}
    for i, want in enumerate(expected(texts, libraries)):
        assert got[i] == want, (i, texts[i])


def test_parts_are_where_no_token_crosses(libraries):
    import random

    rng, code = random.Random(4), ta.coder(A, B)
    assert code.parts_apart
    for k in range(300):
        text = "".join(rng.choice(["a", "be", " ", " ", "  ", "\n", "é", "1", ".", "'s", " ", "👍", "\t", "The"]) for _ in range(rng.randrange(1, 30)))
        whole = tokens_of(text, libraries)
        parts = code.aligned(code.cut(text))
        if whole is None:
            assert not parts.sound.all()
            continue
        assert b";".join(parts.groups) == code.aligned([text]).groups[0], text
        assert parts.counts[:, :2].sum(0).tolist() == [len(x) for x in whole]


def test_empty_table_odd_ids_and_spans(spark, docs_of):
    assert ta.token_alignment(docs_of([]), A, B).count() == 0
    rows = ta.token_alignment(docs_of([("x", "a b")] * 0 + [(1, "a b"), (1, "a b"), (None, "a b")]), A, B, spans=True).collect()
    assert len(rows) == 3 and len({r.groups for r in rows}) == 1
    r = rows[0]
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") + 1 == r.n_groups
    named = spark.createDataFrame([("k", "a b"), (None, None)], "doc_id string, text string")
    assert {x.doc_id: x.n_a for x in ta.token_alignment(named, A, B).collect()} == {"k": 2, None: 0}
    few = ta.token_alignment(named.filter("doc_id is null"), A, B, pairs_held=-1).collect()
    assert few[0].count_sum == 0 and few[0].groups_sha256 == ""


def test_small_memory(docs_of, prose, libraries, monkeypatch):
    monkeypatch.setattr(ta, "CACHE_PARTS", 5)
    monkeypatch.setattr(ta, "CHUNK", 10)
    texts = [prose(30, k // 2) for k in range(8)] + ["x▁y z"]
    code = ta.coder(A, B)
    import pyarrow as pa

    known, seen = ta.Memory(code), []
    for numbers, bounds in known.texts(pa.array(texts)):
        n_a = known.counts[numbers, 0]
        seen += [int(n_a[lo:hi].sum()) for lo, hi in zip(bounds[:-1], bounds[1:])]
        if known.full():
            known.forget()
            assert len(known.number) == len(known.groups) == len(known.counts) <= 5 and len(known.links) == known.counts[:, 3].sum()
            fresh = ta.Memory(code)
            again = fresh.look_up(list(known.number))
            fresh.learn()
            assert [fresh.groups[k] for k in again] == known.groups
    want = [len(f[0]) if (f := tokens_of(t, libraries)) else 0 for t in texts]
    assert seen == want


def test_counts_from_distinct_parts_are_those_from_texts(docs_of, prose):
    docs = docs_of([*ODD, *[prose(60, k % 3) for k in range(6)]]).selectExpr("doc_id as id", "text").repartition(3)
    one = {(r.pair, r.n, r.best) for r in ta.pair_counts(docs, A, B).collect()}
    two = {(r.pair, r.n, r.best) for r in ta.distinct_pair_counts(docs, A, B).collect()}
    assert one == {r for r in two if r[0] >= 0} and {r[:2] for r in two if r[0] < 0} <= {(-1, 0)} and len(one) > 200
