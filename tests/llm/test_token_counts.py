import public_tokenizers

from readroute.llm.token_counts import LongestMatch, automaton, token_counts, word_piece_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, starts, rest):
    """Longest piece first, by slicing; 1 if the word can't be cut."""
    at, n = 0, 0
    while at < len(word):
        pieces = starts if at == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_is_greedy_on_small_vocabularies():
    import itertools

    starts, rest = {b"a", b"ab", b"abcd"}, {b"b", b"bc", b"c", b"cda", b"d", b"aab"}
    machine = LongestMatch(starts, rest)
    for n in range(1, 7):
        for letters in itertools.product(b"abcd", repeat=n):
            assert machine.count(bytes(letters)) == greedy(bytes(letters), starts, rest), bytes(letters)
    assert machine.count(b"") == 0


def test_real_vocabulary(prose):
    starts, rest = word_piece_vocabulary(PATH)
    machine = automaton(PATH)
    for word in {*prose(400, vocabulary=300).split(), "naïveté", "漢字かな", "😀😀x", "antidisestablishmentarianism", "xq" * 40}:
        assert machine.count(word.encode()) == greedy(word.encode(), starts, rest)


def test_rows(docs_of):
    starts, rest = word_piece_vocabulary(PATH)
    texts = ["the cat  sat\ton\nmats", "", None, " \n", "a b c", "long " * 30000]
    docs = docs_of([*enumerate(texts), (0, texts[0]), (None, "x")]).selectExpr("*", "3 as id", "4 as n_tokens")
    rows = token_counts(docs, PATH).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        words = (texts[r.doc_id] if r.doc_id is not None else "x") or ""
        words = words.encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(w, starts, rest) for w in words))
    assert token_counts(docs_of([]), PATH).count() == 0
