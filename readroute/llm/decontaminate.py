"""Benchmark decontamination: texts that hold a benchmark passage, up to a few edits.

Q-gram lemma: if a region of a text is within `e` edits of a passage of m bytes, the
two share at least m - q + 1 - q*e q-grams, and they lie on diagonals at most e apart.
The shared q-grams of each text are therefore counted in overlapping bands of
diagonals; bands that reach the bound are kept and verified by banded alignment.

A q-gram that a passage repeats (a rule of dashes) is held as stretches of places, each
of which meets a run of bands, so the work for a text's q-gram is bounded by the number of
bands of a passage and not by its repeats.

Letters A-Z are folded and white space counts as one blank each, so positions stay.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readroute.llm.common import CHUNK_BYTES, LOWER, SPACE, materialize, pick, text_chunks

#: Least bytes of a passage, and the bytes of the q-grams it is searched by; eight fill one 64-bit code.
GRAMS = ((16, 8), (4, 4), (1, 1))
#: Edits allowed, as a share of the passage's length.
EDIT_SHARE = 0.08
#: Bytes of passages that one pass over the texts takes along; more go in further passes.
BLOCK_BYTES = 4 << 20
#: Meetings of q-grams that are counted at once; above, a block's passages are halved.
MEETINGS = 4 << 20
#: Regions aligned at once.
REGIONS = 256
_FILTER_BITS = 22
_FOLD = LOWER.copy()
_FOLD[SPACE] = 0x20
_BLANKS = bytes(np.flatnonzero(SPACE).tolist())


def codes(data: np.ndarray, q: int) -> np.ndarray:
    """The code of the q bytes (1, 2, 4 or 8) from each position on."""
    code, have = data, 1
    while have < q:
        wide = np.dtype(f"u{2 * have}")
        code = code[:-have].astype(wide) | code[have:].astype(wide) << wide.type(8 * have) if len(code) > have else np.zeros(0, wide)
        have *= 2
    return code.astype(np.uint64)


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def gram_size(length: int) -> int:
    """Bytes of the q-grams that a passage is searched by."""
    return next(q for least, q in GRAMS if length >= least)


def edit_budget(length: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed in a passage; with a large share, no more than leave the lemma one q-gram to ask for."""
    q = gram_size(length)
    return max(0, min(int(share * length), (length - q) // q))


def align_many(passage: np.ndarray, regions: list[np.ndarray], budget: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best match of the whole passage inside each region; edits over the budget: none.

    Semi-global: a region's ends are free. Only cells whose diagonal (region minus
    passage position) lies within [-budget, shift] are filled. Of equal matches the one
    that ends first counts.
    """
    m, width, big = len(passage), budget + shift + 1, budget + 1
    edits, first, last = (np.full(len(regions), x, np.int64) for x in (big, 0, 0))
    size = np.array([len(r) for r in regions])
    step = np.arange(width, dtype=np.int32)
    diagonals = step - budget
    text = np.full((len(regions), m + width), 256, np.int16)
    for k, region in enumerate(regions):
        text[k, budget : budget + len(region)] = region[: m + width - budget]
    who = np.arange(len(regions))
    cost = np.where((diagonals >= 0) & (diagonals <= size[:, None]), 0, big).astype(np.int32)
    begin = np.tile(diagonals, (len(regions), 1))
    for i in range(m):
        best, origin = cost + (text[:, i : i + width] != passage[i]), begin
        up = np.full_like(cost, big)  # passage byte without a region byte
        up[:, :-1] = cost[:, 1:] + 1
        take = up < best
        moved = np.zeros_like(begin)
        moved[:, :-1] = begin[:, 1:]
        best, origin = np.where(take, up, best), np.where(take, moved, origin)
        at = i + 1 + diagonals
        out = (at < 0) | (at > size[who, None])
        best[out] = big
        # region bytes without a passage byte: running minimum of best - step
        slope = best - step
        low = np.minimum.accumulate(slope, axis=1)
        origin = np.take_along_axis(origin, np.maximum.accumulate(np.where(slope == low, step, 0), axis=1), 1)
        best = low + step
        best[out] = big
        cost, begin = np.minimum(best, big), origin
        if i % 8 == 7 or i + 1 == m:
            alive = cost.min(1) <= budget
            if not alive.any():
                return edits, first, last
            if 2 * alive.sum() < len(alive):
                who, cost, begin, text = who[alive], cost[alive], begin[alive], text[alive]
    k = np.argmin(cost, axis=1)
    row = np.arange(len(who))
    edits[who], first[who], last[who] = cost[row, k], begin[row, k], m + k - budget
    return edits, first, last


def align(passage: np.ndarray, region: np.ndarray, budget: int, shift: int) -> tuple[int, int, int] | None:
    """align_many() of one region; None beyond the budget."""
    edits, first, last = align_many(passage, [region], budget, shift)
    return (int(edits[0]), int(first[0]), int(last[0])) if edits[0] <= budget else None


class Passages:
    """The q-grams of passages that are searched by q-grams of one size, sorted by code and passage.

    An entry is a stretch of places of one code in one passage, with no gap wider than a
    band, so that the bands it meets follow each other; the stretches of a code and
    passage run from its end to its start.
    """

    def __init__(self, ids: list[int], passages: list[np.ndarray], share: float, q: int):
        self.q, self.ids, self.data = q, np.array(ids, np.int64), passages
        self.length = np.array([len(d) for d in passages], np.int64)
        self.budget = np.array([edit_budget(len(d), share) for d in passages], np.int64)
        self.bound = self.length - q + 1 - q * self.budget
        grams = [codes(d, q) for d in passages]
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.lexsort((-place, item, code))
        code, item, place = code[order], item[order], place[order]
        new = np.ones(len(code), bool)
        if len(code):
            new[1:] = (code[1:] != code[:-1]) | (item[1:] != item[:-1]) | (place[:-1] - place[1:] > self.budget[item[1:]] + 1)
        first = np.flatnonzero(new)
        self.high, self.low = place[first], place[np.append(first[1:], len(code)) - 1] if len(code) else place
        self.item = item[first]
        self.code, rank = np.unique(code[first], return_inverse=True)
        self.entry = rank * (len(passages) + 1) + self.item  # sorted
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[_slot(self.code)] = True

    def bands(self, grams: np.ndarray, rank: np.ndarray, text: np.ndarray, at: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, passage, band) that reach the bound, for the passages lo to hi."""
        left = np.searchsorted(self.entry, rank * (len(self.data) + 1) + lo)
        n = np.searchsorted(self.entry, rank * (len(self.data) + 1) + hi) - left
        if n.sum() > MEETINGS and hi - lo > 1:
            yield from self.bands(grams, rank, text, at, lo, (lo + hi) // 2)
            yield from self.bands(grams, rank, text, at, (lo + hi) // 2, hi)
            return
        if not n.sum():
            return
        entry = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, gram = self.item[entry], np.repeat(grams, n)
        # diagonals from 0 on within each text; a band is two steps of e + 1 diagonals and one begins at each step
        base, step = self.length[item] + np.repeat(at, n), self.budget[item] + 1
        begin, end = (base - self.high[entry]) // step - 1, (base - self.low[entry]) // step
        again = np.flatnonzero((gram[1:] == gram[:-1]) & (item[1:] == item[:-1])) + 1
        begin[again] = np.maximum(begin[again], end[again - 1] + 1)  # a gram counts once in a band
        pair = (np.repeat(text, n) * len(self.data) + item) << 32
        keys = np.concatenate([pair | begin.clip(0), pair | (end + 1)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        count = np.cumsum(np.where(order < len(pair), 1, -1))
        last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
        keys, count = keys[last], count[last]
        item = (keys >> 32) % len(self.data)
        enough = np.flatnonzero(count >= self.bound[item])
        many = keys[enough + 1] - keys[enough]  # after the last event of a pair the count is 0
        band = np.repeat((keys[enough] & 0xFFFFFFFF) - np.cumsum(many) + many, many) + np.arange(many.sum())
        yield np.repeat((keys[enough] >> 32) // len(self.data), many), np.repeat(item[enough], many), band

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, passage, start, end, edits) of each verified region."""
        if not len(self.data):
            return
        folded = _FOLD[data]
        code = codes(folded, self.q)
        maybe = np.flatnonzero(self.filter[_slot(code)])
        rank = np.searchsorted(self.code, code[maybe])
        rank[rank == len(self.code)] = 0
        same = self.code[rank] == code[maybe]
        maybe, rank = maybe[same], rank[same]
        text = np.searchsorted(offsets, maybe, "right") - 1
        inside = maybe + self.q <= offsets[text + 1]
        maybe, rank, text = maybe[inside], rank[inside], text[inside]
        for texts, items, bands in self.bands(maybe, rank, text, maybe - offsets[text], 0, len(self.data)):
            cut = np.flatnonzero(np.append(True, (texts[1:] != texts[:-1]) | (items[1:] != items[:-1]))) if len(texts) else []
            for a, b in zip(cut, np.append(cut[1:], len(texts)), strict=True) if len(cut) else ():
                t, i = int(texts[a]), int(items[a])
                own = folded[offsets[t] : offsets[t + 1]]
                for start, stop, edits in self.verify(i, own, bands[a:b]):
                    yield t, i, start, stop, edits

    def verify(self, i: int, text: np.ndarray, bands: np.ndarray) -> list[tuple[int, int, int]]:
        """Places of passage i in the bands of a text, none over another: exact ones from the left, then by (edits, start, end)."""
        passage, e = self.data[i], int(self.budget[i])
        m = len(passage)
        lo = bands * (e + 1) - m
        begin, end = np.maximum(lo - e, 0), np.minimum(lo + 3 * e + 2 + m, len(text))
        taken: list[tuple[int, int, int]] = []
        raw, want, at = text.tobytes(), passage.tobytes(), 0
        while (at := raw.find(want, at)) >= 0:
            taken.append((at, at + m, 0))
            at += m
        free = np.zeros(len(text) + 1, np.int64)
        for a, b, _ in taken:
            free[a] += 1
            free[b] -= 1
        free = np.append(0, np.cumsum(np.cumsum(free)[:-1] == 0))
        keep = free[end.clip(0)] - free[begin.clip(0, len(text))] >= m - e
        begin, end = begin[keep], end[keep]
        spans = set()
        for k in range(0, len(begin) if e else 0, REGIONS):
            regions = [text[a:b] for a, b in zip(begin[k : k + REGIONS], end[k : k + REGIONS], strict=True)]
            edits, first, last = align_many(passage, regions, e, 4 * e + 2)
            spans |= {(int(c), int(a + x), int(a + y)) for c, a, x, y in zip(edits, begin[k : k + REGIONS], first, last, strict=True) if c <= e}
        used = sorted((a, b) for a, b, _ in taken)
        for c, a, b in sorted(spans):
            k = bisect(used, (a, b))
            if (k == 0 or used[k - 1][1] <= a) and (k == len(used) or used[k][0] >= b):
                insort(used, (a, b))
                taken.append((a, b, c))
        return taken


def index(ids: list[int], texts: list[bytes], share: float) -> list[Passages]:
    """The passages of a block by the size of their q-grams."""
    held: dict[int, tuple[list, list]] = {}
    for i, t in zip(ids, texts, strict=True):
        if len(t := t.strip(_BLANKS)):
            known = held.setdefault(gram_size(len(t)), ([], []))
            known[0].append(i)
            known[1].append(_FOLD[np.frombuffer(t, np.uint8)])
    return [Passages(*own, share, q) for q, own in held.items()]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[DataFrame]:
    """The passages in parts whose texts hold about `block_bytes` each."""
    picked = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).filter("id is not null and text is not null")
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield picked.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k) if n > 1 else picked


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, min_bytes: int = 1) -> DataFrame:
    """One row for each passage found in a text: (id, item_id, start, end, edits).

    start and end are byte offsets in the text's UTF-8. Places of one passage that overlap
    count once: exact ones first, from the left, then by (edits, start, end). Null and
    empty texts have no row, nor have null or blank passages and those under `min_bytes`;
    repeated rows are each searched, and so is each row of a repeated item. Texts of any
    length are searched whole. Other columns are not read, whatever their names.

    The benchmark is the query set, taken along in blocks of bounded size. If it has more
    than one, each is a pass of its own whose rows are written before the next begins, so
    the driver and the tasks hold one block at a time.
    """
    picked = pick(docs, id=id_col, text=text_col)
    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id long, start long, end long, edits int"
    spark, found = docs.sparkSession, []
    parts = list(blocks(pick(benchmark, id=item_col, text=item_text_col), "id", "text", block_bytes))
    for block in parts:
        rows = block.filter(F.octet_length("text") >= min_bytes).collect()  # bounded by block_bytes
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [bytes(r[1]) for r in rows]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = index(*shared.value, share)
            for batch in batches:
                for rows, data, offsets in text_chunks(batch, "text", CHUNK_BYTES):
                    for passages in indexes:
                        if hits := list(passages.find(data, offsets)):
                            where = [pa.array([h[k] for h in hits], pa.int64()) for k in range(5)]
                            yield pa.RecordBatch.from_arrays([rows.column(0).take(where[0]), pa.array(passages.ids[[h[1] for h in hits]]), where[2], where[3], where[4].cast(pa.int32())], names=["id", "item_id", "start", "end", "edits"])

        part = picked.mapInArrow(search, schema)
        if len(parts) > 1:
            part = materialize(part)
            shared.destroy()
        found.append(part)
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)
