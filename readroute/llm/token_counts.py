"""Token counts: greedy longest-match word pieces counted without building pieces.

A trie over the vocabulary's bytes is turned into a linear longest-match automaton:
each node has a failure link and the number of pieces popped when it is taken, so
one pass over a word's bytes gives the number of its greedy pieces. Each task keeps
the counts of words that it has seen, so a repeated word costs a look-up.

Vocabulary: the pieces of a byte-level tokenizer file; a piece that begins with the
space mark starts a word, any other continues one. All single bytes are pieces, so
every word can be cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from readroute.llm.common import pick

#: Words whose counts a task remembers before it starts afresh.
CACHE_WORDS = 400_000
_automata: dict[str, LongestMatch] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, and its byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def word_piece_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """(pieces that start a word, pieces that continue one) of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = byte_alphabet()
    pieces = {bytes(alphabet[c] for c in piece) for piece in model["vocab"]}
    return {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1}, {p for p in pieces if p[:1] != b" "}


class LongestMatch:
    """Trie of `starts` (from node 0) and `rest` (from node 1) with failure links.

    goto: child of (node, byte). fail: node to go on from when no child fits, -1 if
    the word can't be cut. popped: pieces that end when the failure link is taken.
    """

    def __init__(self, starts: set[bytes], rest: set[bytes]):
        self.goto: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[], []]
        final: set[int] = set()
        for root, pieces in ((0, starts), (1, rest)):
            for piece in sorted(pieces):
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    child = self.goto.get(key)
                    if child is None:
                        child = self.goto[key] = len(children)
                        children[node].append((byte, child))
                        children.append([])
                    node = child
                if piece:
                    final.add(node)
        self.fail, self.popped = [-1] * len(children), [0] * len(children)
        level = [(node, byte, child) for node in (0, 1) for byte, child in children[node]]
        while level:
            below = []
            for node, byte, child in level:
                if child in final:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    at, popped = self.fail[node], self.popped[node]
                    while at >= 0 and (found := self.goto.get(at << 8 | byte)) is None:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = found, popped
                below.extend((child, b, c) for b, c in children[child])
            level = below

    def count(self, word: bytes) -> int:
        """Greedy pieces of a word; one (unknown) if it can't be cut."""
        goto, fail, popped, node, n = self.goto, self.fail, self.popped, 0, 0
        for byte in word:
            while (child := goto.get(node << 8 | byte)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = child
        while node > 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def automaton(path: str) -> LongestMatch:
    if path not in _automata:
        _automata[path] = LongestMatch(*word_piece_vocabulary(path))
    return _automata[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and greedy word pieces of each whole text: (id, n_words, n_tokens).

    Null and empty texts have no words and no tokens; texts of any length are counted
    whole. At each place the longest piece is taken, so there are no ties. One row for
    each input row, repeated ids included; other columns are not read, whatever their
    names. `vocabulary` is a path that every executor can open.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, cache = automaton(vocabulary), {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").split()
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                cache.update([(w, machine.count(w)) for w in set(words) if w not in cache])
                n_words.append(len(words))
                n_tokens.append(sum(map(cache.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    picked = pick(docs, id=id_col, text=text_col)
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(counted, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
