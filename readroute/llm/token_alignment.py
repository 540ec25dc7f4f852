"""Alignment of the tokens of two tokenizers over the same bytes of a text.

A text with a space before it is encoded by a byte-level BPE file (A) and by a
sentencepiece model (B, which adds the space itself). The spans that both libraries give
(of A in characters, of B's proto in bytes) are the coarse cuts. Where a span isn't the
token's own bytes, as in a character of several bytes that is cut, or one that falls back
to byte tokens, the token's decoded bytes place it after the token before.

A text is parted at single spaces between characters that are no white space. Neither
tokenizer has a token across such a place: the pattern of A begins a piece there, and
no piece of B holds the space mark after another character (checked when the model is
read). So tokens, groups and links of a part don't hang on what is around it, and each
worker aligns a part once and remembers it.

Links of a pair of ids are counted over all texts: parts are counted by a grouped sum, each
different part is aligned once, and its links are summed by pair. Up to PAIRS_HELD
different pairs go to every task as sorted arrays; of more, the pairs of each text are
joined with their counts.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readroute.llm.common import materialize, pick
from readroute.llm.token_counts import byte_alphabet

#: Different pairs of ids up to which their counts go to every task (17 bytes each).
PAIRS_HELD = 2_000_000
#: Bytes and parts of text whose alignment a worker remembers before it forgets the rarer ones.
CACHE_BYTES, CACHE_PARTS = 64 << 20, 400_000
#: Parts that are encoded in one call.
TOGETHER = 128
#: Characters of text that are parted at once.
CHUNK = 1 << 20
_SEAM = re.compile(r"(?<=\S) (?=\S)")
_coders: dict[tuple[str, str], Coder] = {}
_memories: dict[tuple[str, str], Memory] = {}


@dataclass
class Aligned:
    """The aligned tokens of a run of parts."""

    counts: np.ndarray  # [part, (A tokens, B tokens, groups, links)]
    links: np.ndarray  # A id << 32 | B id, of one part after the other
    groups: list[bytes]
    sound: np.ndarray  # whether both tokenizers give back the bytes of the part


def refined(end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """End of each token in bytes: that of its span, and between ends that don't fit the bytes of the tokens, as many bytes behind the token before."""
    behind = np.cumsum(size)
    off = np.flatnonzero(end != behind)
    end[off] = behind[off]
    return end


def _halves(n: int) -> list[tuple[int, int]]:
    return [(0, n // 2), (n // 2, n)]


def _joined(found: list[Aligned]) -> Aligned:
    return Aligned(*(np.concatenate([getattr(x, c) for x in found]) for c in ("counts", "links")), [g for x in found for g in x.groups], np.concatenate([x.sound for x in found]))


class Coder:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, bpe_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.a = Tokenizer.from_file(bpe_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(bpe_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            if all(c in alphabet for c in piece):
                self.a_bytes[i] = bytes(alphabet[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.parts_apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids as shown in groups, with what follows them
        self.shown = [b"%d%b" % (i, mark) for n, marks in ((len(self.a_bytes), b",|"), (len(pieces), b",;")) for mark in (marks[:1], marks[1:]) for i in range(n)]

    def cut(self, text: str) -> list[str]:
        """The parts of a text, without the space before each."""
        return _SEAM.split(text) if self.parts_apart else [text]

    def aligned(self, parts: list[str], together: int = TOGETHER) -> Aligned:
        """Each part with a space before it, on its own. Parts that can be told apart again are encoded together."""
        apart = [k for k, p in enumerate(parts) if not p or p[0].isspace() or p[-1].isspace() or "▁" in p]
        cuts = sorted({*range(0, len(parts), together), *apart, *(k + 1 for k in apart), len(parts)}) if self.parts_apart else [*range(len(parts) + 1)]
        runs = [" ".join(parts[lo:hi]) for lo, hi in itertools.pairwise(cuts)]
        a = self.a.encode_batch([" " + r for r in runs], add_special_tokens=False)
        b = self.b.encode(runs, return_type="proto", num_threads=1)
        text = " " + " ".join(parts)
        raw = text.encode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))  # the byte of each character
        chars = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1))
        base = at[chars]
        first = np.array(cuts[:-1], np.int64)
        flat = itertools.chain.from_iterable
        n_a, n_b = [len(e) for e in a], [len(t.pieces) for t in b]
        a_ids = np.fromiter(flat(e.ids for e in a), np.int64, sum(n_a))
        a_end = np.array([hi for e in a for _, hi in e.offsets], np.int64) + np.repeat(chars[first], n_a)
        found = [(p.id, p.end) for t in b for p in t.pieces]
        b_ids, b_end = np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64)
        # B's spans are bytes that leave the added space of each run out
        b_end += np.repeat(base[first], n_b) + 1
        a_end, b_end = refined(at[a_end], self.a_size[a_ids]), refined(b_end, self.b_size[b_ids])
        whole = all(b"".join(map(table.__getitem__, ids.tolist())) == raw for table, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids)))
        sound = np.ones(len(parts), bool)
        if not whole:
            if len(parts) > 1:
                return _joined([self.aligned(parts[lo:hi], 1) for lo, hi in _halves(len(parts))])
            sound[:] = False
            a_ids, a_end, b_ids, b_end = (x[:0] for x in (a_ids, a_end, b_ids, b_end))
        a_start, b_start = a_end - self.a_size[a_ids], b_end - self.b_size[b_ids]
        a_of, b_of = (np.searchsorted(base, x, "right") - 1 for x in (a_start, b_start))
        lo, hi = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        n = hi - lo
        owner = np.repeat(np.arange(len(a_ids)), n)
        other = lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        links, of_link = a_ids[owner] << 32 | b_ids[other], a_of[owner]
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        counts = np.array([np.bincount(x, minlength=len(parts)) for x in (a_of, b_of, a_of[np.searchsorted(a_end, shared)], of_link)]).T
        return Aligned(counts, links, self._shown(a_ids, a_of, a_end, b_ids, b_of, b_end, shared, len(parts)), sound)

    def _shown(self, a_ids: np.ndarray, a_of: np.ndarray, a_end: np.ndarray, b_ids: np.ndarray, b_of: np.ndarray, b_end: np.ndarray, shared: np.ndarray, n: int) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each part."""
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        # every id with what comes after it, put in the order of groups, A before B
        entry = np.concatenate([a_ids + n_a * np.isin(a_end, shared), 2 * n_a + b_ids + n_b * np.isin(b_end, shared)])
        group = np.concatenate([2 * np.searchsorted(shared, a_end), 2 * np.searchsorted(shared, b_end) + 1])
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(np.concatenate([a_of, b_of])[order], np.arange(n + 1)).tolist()
        line = list(map(self.shown.__getitem__, entry[order].tolist()))
        return [b"".join(line[bounds[k] : bounds[k + 1]])[:-1] for k in range(n)]


def coder(bpe_path: str, piece_path: str) -> Coder:
    key = (bpe_path, piece_path)
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]


class _Numbers(dict):
    """A number for each part, in the order in which they come up; `new` has those that are not looked at yet."""

    def __init__(self, known: Iterable[str] = ()):
        super().__init__(zip(known, itertools.count()))
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n


class Memory:
    """The parts that a Python worker has met, by number, with what was found for each."""

    def __init__(self, code: Coder):
        self.code, self.age = code, 0
        self.number = _Numbers()
        self.groups: list[bytes] = []
        self.sound = np.zeros(0, bool)
        self.counts, self.links, self.uses = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.groups) > CACHE_PARTS or 8 * len(self.links) > CACHE_BYTES

    def forget(self) -> None:
        """Keep the parts that came up most, half of what there is room for at most, and give them new numbers."""
        self.age += 1
        kept = np.flatnonzero(self.uses > 1)
        fits = np.cumsum(self.counts[kept := kept[np.argsort(-self.uses[kept], kind="stable")], 3]) * 16 < CACHE_BYTES
        kept = np.sort(kept[fits][: CACHE_PARTS // 2])
        stay = np.zeros(len(self.groups), bool)
        stay[kept] = True
        self.links = self.links[np.repeat(stay, self.counts[:, 3])]
        self.counts, self.sound, self.uses = self.counts[kept], self.sound[kept], self.uses[kept] // 2
        self.groups = [self.groups[k] for k in kept.tolist()]
        self.number = _Numbers(itertools.compress(self.number, stay.tolist()))

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of the parts, bounds of each text) of chunks of the texts; a null or empty text has no part.

        A text with a part that a tokenizer doesn't give back is looked at as a whole.
        """
        lo = 0
        while lo < len(column):
            chunk, size = [], 0
            while lo < len(column) and size < CHUNK:
                text = column[lo].as_py() or ""
                chunk.append(self.code.cut(text) if text else [])
                size += len(text)
                lo += 1
            numbers = [self.look_up(parts) for parts in chunk]
            self.learn()
            if not self.sound.all():
                for k, parts in enumerate(chunk):
                    if len(parts) > 1 and not self.sound[numbers[k]].all():
                        numbers[k] = self.look_up([" ".join(parts)])
                self.learn()
            flat = np.concatenate(numbers)
            self.uses += np.bincount(flat, minlength=len(self.groups))
            yield flat, np.append(0, np.cumsum([len(n) for n in numbers]))

    def look_up(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))

    def learn(self) -> None:
        new, self.number.new = self.number.new, []
        found = [self.code.aligned(new[lo : lo + 20_000]) for lo in range(0, len(new), 20_000)]
        if found:
            self.groups.extend(g for f in found for g in f.groups)
            self.counts, self.links, self.sound = (np.concatenate([getattr(self, c), *[getattr(f, c) for f in found]]) for c in ("counts", "links", "sound"))
            self.uses = np.append(self.uses, np.zeros(len(new), np.int64))


def memory(bpe_path: str, piece_path: str) -> Memory:
    """What this worker remembers, from tasks before this one too."""
    key = (bpe_path, piece_path)
    if key not in _memories:
        _memories[key] = Memory(coder(*key))
    return _memories[key]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, sum of the values of each)."""
    own, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, values)
    return own, total


def pair_counts(picked: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """(pair, n, best) of all links: how many hold the pair, and whether no other A id has more with its B id."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(bpe_path, piece_path)
        times = np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            of_link = np.repeat(times, known.counts[: len(times), 3])
            used = of_link > 0
            pairs, n = summed(known.links[: len(of_link)][used], of_link[used])
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for numbers, _ in known.texts(batch.column(1)):
                now = np.bincount(numbers, minlength=len(times))
                now[: len(times)] += times
                times = now
                if known.full():
                    yield flush()
                    known.forget()
                    times = np.zeros(0, np.int64)
        yield flush()

    sums = picked.mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return _with_best(sums)


def distinct_pair_counts(picked: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """pair_counts() from the different parts of all texts, each aligned once, and with pair -1 how many weren't given back though they should.

    A text with B's space mark is not given back by B, so it is one part.
    """

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(bpe_path, piece_path)
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["part", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(1):
                if text := text.as_py():
                    seen.update([text] if "▁" in text else code.cut(text))
                if len(seen) > CACHE_PARTS:
                    yield flush()
        yield flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(bpe_path, piece_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            pairs, n = summed(*(np.concatenate([np.zeros(0, np.int64), *[h[k] for h in held]]) for k in range(2)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            parts, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found = code.aligned(parts)
            odd = sum("▁" not in parts[k] for k in np.flatnonzero(~found.sound))
            held.append(summed(np.append(found.links, -1), np.append(np.repeat(n, found.counts[:, 3]), odd)))
            if sum(len(h[0]) for h in held) > 1 << 20:
                yield flush()
        yield flush()

    parts = picked.select("id", "text").mapInArrow(parted, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return _with_best(parts.mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))


def _with_best(sums: DataFrame) -> DataFrame:
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # as many rows as A has ids at most
    return sums.withColumn("best", F.col("n") == F.max("n").over(of_b))


class PartSums:
    """Tokens of A and B, groups, links, best links and sum of counts of each part known so far."""

    def __init__(self, known: Memory, pair: np.ndarray | None, n: np.ndarray | None, best: np.ndarray | None):
        self.known, self.table, self.age = known, (pair, n, best), -1

    def now(self) -> np.ndarray:
        if self.age != self.known.age:
            self.age, self.sums, self.done = self.known.age, np.zeros((0, 6), np.int64), 0
        counts = self.known.counts
        if len(counts) > len(self.sums):
            new = counts[len(self.sums) :]
            own = np.zeros((len(new), 6), np.int64)
            own[:, :4] = new
            pair, n, best = self.table
            links = self.known.links[self.done :]
            self.done += len(links)
            if pair is not None and len(pair) and len(links):
                # parts from tables before this one may have pairs that it lacks
                at = np.minimum(np.searchsorted(pair, links), len(pair) - 1)
                here = pair[at] == links
                bounds = np.append(0, np.cumsum(new[:, 3]))
                for k, values in ((4, best[at] & here), (5, n[at] * here)):
                    own[:, k] = np.diff(np.append(0, np.cumsum(values))[bounds])
            self.sums = np.concatenate([self.sums, own])
        return self.sums


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def token_alignment(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", pairs_held: int = PAIRS_HELD, spans: bool = False) -> DataFrame:
    """Aligned tokens of each whole text: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Cuts that both tokenizers share part the tokens into groups; tokens whose bytes overlap
    are linked. n_best: links whose pair of ids is as frequent as any with its B id, ties
    included; count_sum: the sum of the pairs' counts over the links. With `spans`, also the
    groups as text (`a1,a2|b1;a3|b2,b3`). Null and empty texts, and those whose bytes a
    tokenizer doesn't give back, have no tokens: zeros and ''. Texts of any length are
    aligned whole. One row for each input row, rows alike included; other columns are not
    read, whatever their names. Both paths are ones that every executor can open.
    """
    picked = pick(docs, id=id_col, text=text_col)
    spark = docs.sparkSession
    kind = picked.schema["id"].dataType.simpleString()
    table = materialize(distinct_pair_counts(picked, bpe_path, piece_path))
    if table.filter("pair = -1 and n > 0").count():  # a model that changes bytes in other ways: by whole texts
        table = materialize(pair_counts(picked, bpe_path, piece_path))
    table = table.filter("pair >= 0")
    few = table.count() <= pairs_held
    held = None
    if few:
        got = table.toArrow().sort_by("pair")
        held = spark.sparkContext.broadcast(tuple(got.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(bpe_path, piece_path)
        sums = PartSums(known, *(held.value if few else (None, None, None)))
        for batch in batches:
            rows, digests, shown, pairs, times = [np.zeros((0, 6), np.int64)], [], [], [], []
            for numbers, bounds in known.texts(batch.column(1)):
                of_part = sums.now()
                whole = np.zeros((len(numbers) + 1, 6), np.int64)
                np.cumsum(of_part[numbers], axis=0, out=whole[1:])
                rows.append(np.diff(whole[bounds], axis=0))
                lines = list(map(known.groups.__getitem__, numbers.tolist()))
                links = known.links
                ends = np.cumsum(of_part[:, 3]) if not few else None
                for lo, hi in itertools.pairwise(bounds.tolist()):
                    line = b";".join(lines[lo:hi])
                    digests.append(hashlib.sha256(line).hexdigest() if line else "")
                    if spans:
                        shown.append(line.decode())
                    if not few:
                        own, n = np.unique(numbers[lo:hi], return_counts=True)
                        some = [links[ends[k] - of_part[k, 3] : ends[k]] for k in own.tolist()]
                        own, n = summed(np.concatenate([np.zeros(0, np.int64), *some]), np.repeat(n, of_part[own, 3]))
                        pairs.append(own)
                        times.append(n)
                if known.full():
                    known.forget()
            columns = [batch.column(0), *map(pa.array, np.concatenate(rows).T), pa.array(digests, pa.string())]
            names = ["id", *[c.split()[0] for c in _COUNTS.split(", ")]]
            if spans:
                columns, names = [*columns, pa.array(shown, pa.string())], [*names, "groups"]
            if not few:
                columns, names = [*columns, pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], [*names, "pairs", "times"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, {_COUNTS}" + ", groups string" * spans
    if few:
        return picked.mapInArrow(found, schema).withColumnRenamed("id", id_col)
    rows = materialize(picked.mapInArrow(found, f"{schema}, pairs array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(table, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n1"), F.sum(F.col("times") * F.col("n")).alias("n2"))
    none = F.lit(0).cast("long")
    whole = rows.drop("pairs", "times").join(sums, "row", "left").withColumns({"n_best": F.coalesce("n1", none), "count_sum": F.coalesce("n2", none)})
    return whole.drop("row", "n1", "n2").withColumnRenamed("id", id_col)
