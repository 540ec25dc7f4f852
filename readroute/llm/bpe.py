"""BPE encoding and decoding of whole texts with a byte-level tokenizer file.

Texts are cut into pieces by the tokenizer's pattern. The pieces that a task has not
met yet are encoded together: their symbols lie in one flat array, and each round
looks up the rank of every adjacent pair by binary search over the sorted pair keys
and merges, in every piece at once, the pairs of the piece's lowest rank.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from readroute.llm.common import pick
from readroute.llm.token_counts import byte_alphabet

#: The published pattern of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a task remembers before it starts afresh.
CACHE_PIECES = 400_000
#: Bytes of a piece over which its rounds look at changed places only.
LONG = 64
_codecs: dict[str, Codec] = {}


def _every_second(hit: np.ndarray) -> np.ndarray:
    """Of overlapping pairs (aaa) every second counts, from the left."""
    if len(hit) < 2:
        return hit
    runs = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
    step = np.arange(len(hit)) - np.repeat(runs, np.diff(runs, append=len(hit)))
    return hit[step % 2 == 0]


class Codec:
    """Merge table, vocabulary and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(alphabet[c] for c in piece) for piece, i in vocab.items()}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int64)
        for shown, byte in alphabet.items():
            self.byte_id[byte] = vocab[shown]
        self.width = max(self.bytes_of) + 1
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.pair_made = keys[order], order, made[order]
        self.pieces = regex.compile(PATTERN)
        named = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, named)) + ")") if named else None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair of symbols; a pair without a merge has a rank after all others."""
        none = len(self.pair_keys)
        if not none:
            return np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        pair = left * self.width + right
        at = np.searchsorted(self.pair_keys, pair)
        at[at == none] = 0
        return np.where(self.pair_keys[at] == pair, self.pair_rank[at], none), self.pair_made[at]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces in one array and the bounds of each piece in it."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        long = sizes[owner] > LONG
        parts = [merge(symbols[own], owner[own]) for own, merge in ((~long, self.by_rounds), (long, self.by_ranks)) if own.any()]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(len(pieces) + 1, np.int64)
        ids, owner = (np.concatenate([x[k] for x in parts]) for k in range(2))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(pieces) + 1))

    def by_rounds(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, piece of each): a round merges the pairs of lowest rank of all pieces at once."""
        none = len(self.pair_keys)
        done_ids, done_owner = [], []
        while len(symbols):
            rank, made = self.lookup(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = none
            lowest = np.full(int(owner[-1]) + 1, none, np.int64)
            np.minimum.at(lowest, owner[:-1], rank)
            over = lowest[owner] == none
            if over.any():  # these pieces have no pair left
                done_ids.append(symbols[over])
                done_owner.append(owner[over])
                kept = np.flatnonzero(~over)
                if not len(kept):
                    break
                # a pair lives on if both its symbols stay next to each other
                rank, made = np.where(np.diff(kept) == 1, rank[kept[:-1]], none), made[kept[:-1]]
                symbols, owner = symbols[kept], owner[kept]
            hit = _every_second(np.flatnonzero((rank < none) & (rank == lowest[owner[:-1]])))
            symbols[hit] = made[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return np.concatenate(done_ids), np.concatenate(done_owner)

    def by_ranks(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long pieces: a round merges all pairs of the lowest rank there is and looks at their neighbours only."""
        none, n = len(self.pair_keys), len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, made = np.full(n, none), np.zeros(n, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            """Rank the pairs that begin at these places, and let them wait for their turn."""
            rank[at] = none
            at = at[after[at] < n]
            at = at[owner[at] == owner[after[at]]]
            rank[at], made[at] = self.lookup(symbols[at], symbols[after[at]])
            at = at[rank[at] < none]
            if len(at):
                at = at[np.argsort(rank[at], kind="stable")]
                cut = np.flatnonzero(np.diff(rank[at])) + 1
                for part in np.split(at, cut):
                    k = int(rank[part[0]])
                    if k not in waiting:
                        waiting[k] = []
                        heappush(ranks, k)
                    waiting[k].append(part)

        look(np.arange(n))
        while ranks:
            k = heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(k)))
            at = at[rank[at] == k]
            if len(at) > 1:  # of overlapping pairs every second counts
                first = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = made[at]
            rank[gone] = -1  # no place any more
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left = before[at]
            look(np.unique(np.concatenate([at, left[left >= 0]])))
        stay = rank >= 0
        return symbols[stay], owner[stay]

    def split(self, text: str) -> list[str]:
        """Pieces of a text, special tokens among them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out.extend([part] if part in self.special else self.pieces.findall(part))
        return out

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        ids, bounds = self.encode_pieces([p.encode() for p in pieces])
        return [i for k, p in enumerate(pieces) for i in ([self.special[p]] if p in self.special else ids[bounds[k] : bounds[k + 1]].tolist())]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again: (id, n_tokens, ids_sha256, decoded_sha256).

    With `ids`, also the token ids and the decoded text. A null text is empty and has
    no tokens. Texts are encoded whole, and a piece without a break takes time about in
    proportion to its length. Of pairs of equal rank the leftmost is merged first. One row
    for each input row, repeated ids included; other columns are not read, whatever their
    names. `vocabulary` is a path that every executor can open.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)
        shown: dict[str, bytes] = {}
        plain: dict[str, bytes] = {}

        def learn(new: list[str]) -> None:
            found, bounds = code.encode_pieces([p.encode() for p in new])
            found = found.tolist()
            for k, piece in enumerate(new):
                own = [code.special[piece]] if piece in code.special else found[bounds[k] : bounds[k + 1]]
                shown[piece] = b"%d," * len(own) % tuple(own)
                plain[piece] = b"".join(map(code.bytes_of.__getitem__, own))

        for batch in batches:
            n_tokens, ids_sha, text_sha, id_lists, decoded = [], [], [], [], []
            texts = batch.column(1)
            lo = 0
            while lo < len(texts):
                cut, size = [], 0
                while lo < len(texts) and size < 1 << 20:
                    text = texts[lo].as_py() or ""
                    cut.append(code.split(text))
                    size += len(text)
                    lo += 1
                if len(shown) > CACHE_PIECES:
                    shown.clear()
                    plain.clear()
                if new := [p for p in set().union(*cut) if p not in shown]:
                    learn(new)
                for pieces in cut:
                    line = b"".join(map(shown.__getitem__, pieces))[:-1]
                    back = b"".join(map(plain.__getitem__, pieces))
                    n_tokens.append(line.count(b",") + 1 if line else 0)
                    ids_sha.append(hashlib.sha256(line).hexdigest())
                    text_sha.append(hashlib.sha256(back if back.isascii() else back.decode("utf-8", "replace").encode()).hexdigest())
                    if ids:
                        id_lists.append([int(x) for x in line.split(b",")] if line else [])
                        decoded.append(back.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array(id_lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = pick(docs, id=id_col, text=text_col)
    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * ids
    return picked.mapInArrow(coded, schema).withColumnRenamed("id", id_col)
