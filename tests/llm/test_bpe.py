import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from readroute.llm.bpe import Codec, bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello world, it's  a test.\n\n  Indented\tline   ",
    "", None, "aaaaaaa aaaa aaa", "don't we'll I'M they've 'tis", "ünïcödé — naïve 😀😀 漢字かな 12345 67",
    "a<|endoftext|>b <|endoftext|>", "x y\x1c\x1dz 　 ﻿", "\r\n\r\n\t \t", "thth" * 2000, "%%%&&&***$$$ ### |x|y|",
    " leading", "trailing ", "a" * 3000, "ab́c", "\U0001f469‍\U0001f4bb", "\x00\x01 \x7f",
]


@pytest.fixture(scope="module")
def own():
    return Codec(PATH), Tokenizer.from_file(PATH)


def test_same_ids_and_text_as_the_library(own):
    code, library = own
    for text in TEXTS:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert code.encode(text or "") == want
        assert code.decode(want) == library.decode(want, skip_special_tokens=False)


def test_random_texts(own, prose):
    import random

    code, library = own
    rng = random.Random(5)
    for seed in range(40):
        text = prose(60, seed) + "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x370, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(80))
        assert code.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_columns(docs_of, own):
    code, library = own
    docs = docs_of([*TEXTS, TEXTS[0]])
    rows = {r.doc_id: r for r in bpe(docs, PATH, ids=True).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, text in enumerate([*TEXTS, TEXTS[0]]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].token_ids, rows[i].decoded) == (len(ids), ids, text or "")
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table_repeated_rows_and_odd_columns(docs_of):
    assert bpe(docs_of([]), PATH).count() == 0
    twice = docs_of([(7, "one two"), (7, "one two"), (None, "x")]).selectExpr("*", "1 as id", "2 as n_tokens", "'x' as decoded")
    assert sorted((r.doc_id or -1, r.n_tokens) for r in bpe(twice, PATH).collect()) == [(-1, 1), (7, 2), (7, 2)]


def test_long_pieces_without_a_break(own):
    import random
    import time

    code, library = own
    rng = random.Random(11)
    for n, letters in ((65, "ab"), (300, "thearingon"), (2000, "aé漢th"), (5000, "a"), (4001, "ab"), (20000, "etaoinshrdlu")):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert code.encode(text) == library.encode(text, add_special_tokens=False).ids
    pieces = [text[:k].encode() for k in (1, 63, 64, 65, 66, 3000)] + [b"", b"the"]
    ids, bounds = code.encode_pieces(pieces)
    for k, piece in enumerate(pieces):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(piece.decode(), add_special_tokens=False).ids
    taken = []
    for n in (100_000, 800_000):
        text = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        begun = time.time()
        code.encode(text)
        taken.append(time.time() - begun)
    assert taken[1] < 20 * max(taken[0], 0.5)
