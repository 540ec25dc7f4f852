"""Approximate search of tags in text windows, vectorised over the windows of a batch.

Each cell of the tables is one whole number, cost << 40 | indels << 20 | span, so that
the least is the alignment of least cost, then fewest indels, then shortest span.
Reported are the rightmost local minima of the cost over the end positions.

Of more than FEW tags, not every one is aligned with every window. A tag within k edits
has one of its k + 1 pieces whole in the text, shifted by k places at most, so pieces are
looked up in a sorted index, and only the tags found are aligned, and only around there:
an end whose cost is within the limit lies within k places of where a piece puts it, and
costs over the limit are all alike. A worker keeps the index of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from readroute.functions.seq import IUPAC, revcomp_text
from readroute.plans.spec import Group, Tag

#: Tags of a group up to which each is aligned with every window.
FEW = 12
#: Shortest piece that is looked up; longest, as a key has two bits a base; variants of a piece with codes for several bases.
SHORTEST, LONGEST, VARIANTS = 2, 31, 4096
#: Bases of windows, windows, candidates, and cells of tables that are handled at once.
BASES, WINDOWS, CANDIDATES, CELLS = 1 << 20, 1 << 16, 1 << 21, 1 << 22

_COST, _INDEL = 1 << 40, 1 << 20
_OVER = 1 << 20
_BIT = {"A": 1, "C": 2, "G": 4, "T": 8}
_READ = np.zeros(256, np.uint8)
for _b, _m in _BIT.items():
    _READ[ord(_b)] = _READ[ord(_b.lower())] = _m
_MASK = np.zeros(256, np.uint8)
for _b, _s in IUPAC.items():
    _MASK[ord(_b)] = _MASK[ord(_b.lower())] = sum(_BIT[x] for x in _s)
_DIGIT = np.full(256, 4, np.uint8)
for _k, _m in enumerate((1, 2, 4, 8)):
    _DIGIT[_m] = _k
_FIELDS = ("cost", "start", "strand", "tag_idx", "span", "end", "subs", "indels")
HIT = "struct<cost:int,file:int,start:int,strand:int,tag_idx:int,span:int,end:int,subs:int,indels:int>"
_FOUND = "array<struct<" + ",".join(f"{f}:int" for f in _FIELDS) + ">>"


def tag_mask(tag: str) -> np.ndarray:
    return _MASK[np.frombuffer(tag.encode(), np.uint8)]


@dataclass
class Windows:
    """Base masks of many windows, one after the other, 0 for what is no base."""

    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def part(self, lo: int, hi: int) -> Windows:
        return Windows(self.flat, self.start[lo:hi], self.length[lo:hi])

    def table(self, rows: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
        """[row, k]: base first + k of a window, 0 behind its end."""
        at = first[:, None] + np.arange(width)
        inside = (at >= 0) & (at < self.length[rows, None])
        return np.where(inside, self.flat[np.where(inside, self.start[rows, None] + at, 0)], 0) if len(self.flat) else np.zeros((len(rows), width), np.uint8)

    def reversed(self) -> Windows:
        """Each window from its end on."""
        owner = np.repeat(np.arange(len(self.start)), self.length)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        return Windows(self.flat[self.start[owner] + self.length[owner] - 1 - within], np.cumsum(self.length) - self.length, self.length)


def windows_of(texts: list[str]) -> Windows:
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return Windows(_READ[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)], np.cumsum(n) - n, n)


def profile(masks: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """[window, end]: the best alignment of a tag, or of each window's own tag, that ends there."""
    m, (rows, width) = tag.shape[-1], masks.shape
    step = _COST + _INDEL  # a tag base without a text base
    fall = np.arange(m + 1, dtype=np.int64) * step
    now = np.tile(fall, (rows, 1))
    ends = np.empty((rows, width + 1), np.int64)
    ends[:, 0] = now[:, m]
    for j in range(width):
        differs = np.where(masks[:, j, None] & tag, 1, _COST + 1)
        new = np.empty_like(now)
        new[:, 0] = 0
        new[:, 1:] = np.minimum(now[:, :-1] + differs, now[:, 1:] + step + 1)
        now = np.minimum.accumulate(new - fall, axis=1) + fall
        ends[:, j + 1] = now[:, m]
    return ends


def minima(ends: np.ndarray, known: np.ndarray, budget: int) -> tuple[np.ndarray, ...]:
    """(row, end, cost, span, indels) of the rightmost local minima within budget; ends that aren't `known` cost more."""
    cost = np.where(known, ends >> 40, _OVER)
    rise = np.ones_like(cost, bool)
    rise[:, :-1] = cost[:, 1:] > cost[:, :-1]
    # the last differing cost to the left must be higher
    change = np.zeros_like(cost, bool)
    change[:, 1:] = cost[:, 1:] != cost[:, :-1]
    last = np.maximum.accumulate(np.where(change, np.arange(cost.shape[1]), 0), axis=1)
    before = np.take_along_axis(cost, np.maximum(last - 1, 0), axis=1)
    row, end = np.nonzero((cost <= budget) & rise & ((last == 0) | (before > cost)))
    value = ends[row, end]
    span, indels = value & (_INDEL - 1), value >> 20 & (_INDEL - 1)
    some = span > 0
    return tuple(x[some] for x in (row, end, value >> 40, span, indels))


def hits(window: np.ndarray, start: np.ndarray, strand: int, tag: np.ndarray, end: np.ndarray, cost: np.ndarray, indels: np.ndarray, subs: np.ndarray) -> np.ndarray:
    """Rows of (window, cost, start, strand, tag, span, end, subs, indels)."""
    return np.column_stack([window, cost, start, np.full(len(window), strand), tag, end - start, end, subs, indels]).astype(np.int64)


class Index:
    """Tags of one length by their pieces; `rest` are those that are aligned with every window."""

    def __init__(self, tags: list[np.ndarray], places: list[int], edits: int):
        m = len(tags[0])
        self.m, self.edits = m, edits
        self.masks, self.places = np.array(tags, np.uint8), np.array(places, np.int64)
        bounds = [m * k // (edits + 1) for k in range(edits + 2)]
        self.pieces = [(lo, min(hi, lo + LONGEST)) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        several = np.bitwise_count(self.masks).astype(np.float64)
        too_many = np.zeros(len(tags), bool)
        for lo, hi in self.pieces:
            too_many |= np.prod(several[:, lo:hi], axis=1) > VARIANTS
        if len(tags) <= FEW or min(hi - lo for lo, hi in self.pieces) < SHORTEST:
            too_many[:] = True
        self.rest = np.flatnonzero(too_many)
        self.keys, self.of = [], []
        plain = (several == 1).all(1) & ~too_many
        for lo, hi in self.pieces if (~too_many).any() else ():
            weight = 4 ** np.arange(hi - lo)[::-1]
            keys, of = [_DIGIT[self.masks[plain, lo:hi]].astype(np.int64) @ weight], [np.flatnonzero(plain)]
            for t in np.flatnonzero(~plain & ~too_many):
                own = np.array([*product(*[[d for d in range(4) if mask >> d & 1] for mask in self.masks[t, lo:hi].tolist()])], np.int64) @ weight
                keys.append(own)
                of.append(np.full(len(own), t))
            keys, of = np.concatenate(keys), np.concatenate(of)
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.of.append(of[order])

    def candidates(self, w: Windows, anchored: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, tag, where the tag would begin) wherever a piece is in the text; with `anchored`, at most so far from the window's start."""
        if not self.keys:
            return
        lo_flat, hi_flat = int(w.start[0]), int(w.start[-1] + w.length[-1])
        digits = _DIGIT[w.flat[lo_flat:hi_flat]].astype(np.int64)
        gaps = np.append(0, np.cumsum(digits == 4))
        digits[digits == 4] = 0
        first = w.start - lo_flat
        for (lo, hi), keys, of in zip(self.pieces, self.keys, self.of, strict=True):
            size = hi - lo
            if anchored is None:
                at = np.arange(max(0, len(digits) - size + 1))
                window = np.searchsorted(first, at, "right") - 1
            else:
                shift = np.arange(max(-anchored, -lo), anchored + 1)
                window = np.repeat(np.arange(len(first)), len(shift))
                at = (first[:, None] + lo + shift).ravel()
            fits = (at + size <= first[window] + w.length[window]) & (at >= 0)
            at, window = at[fits], window[fits]
            sure = gaps[at + size] == gaps[at]
            at, window = at[sure], window[sure]
            key = np.zeros(len(at), np.int64)
            for k in range(size):
                key = key * 4 + digits[at + k]
            a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = b - a
            total = np.cumsum(n)
            cut = 0
            while cut < len(at):  # so many places that their candidates fit
                to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + CANDIDATES, "right")))
                own = n[cut:to]
                if own.sum():
                    place = np.repeat(np.arange(cut, to), own)
                    which = a[place] + np.arange(len(place)) - np.repeat(np.cumsum(own) - own, own)
                    yield window[place], of[which], at[place] - first[window[place]] - lo
                cut = to


def within_limits(found: np.ndarray, group: Group) -> np.ndarray:
    subs, indels = found[:, 7], found[:, 8]
    return found[(subs <= group.mismatch) & (indels <= group.indel) & (subs + indels <= group.total)]


def slide(w: Windows, index: Index, budget: int) -> Iterator[np.ndarray]:
    """Hits of an index's tags anywhere in the windows, on the strand that they are given on."""
    m = index.m
    for t in index.rest:
        order = np.argsort(w.length, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * (w.length[order[hi]] + m + 2) <= CELLS:
                hi += max(1, (hi - lo) // 8)
            rows = order[lo : min(hi, len(order))]
            width = int(w.length[rows].max())
            ends = profile(w.table(rows, np.zeros(len(rows), np.int64), width), index.masks[t])
            row, end, cost, span, indels = minima(ends, np.arange(width + 1) <= w.length[rows, None], budget)
            yield hits(rows[row], end - span, 0, np.full(len(row), index.places[t]), end, cost, indels, cost - indels)
            lo = hi
    found = [*index.candidates(w, None)]
    if not found:
        return
    # where the costs of a (window, tag) can be within budget: runs of places of the pieces
    wide = int(w.length.max()) + m + 1
    packed = np.unique(np.concatenate([(x[0] * len(index.places) + x[1]) * wide + (x[2] + m) for x in found]))
    pair, place = packed // wide, packed % wide - m
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (place[1:] - place[:-1] > 2 * budget + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(pair)) - 1
    window, tag = pair[head] // len(index.places), pair[head] % len(index.places)
    a, b = np.maximum(place[head] + m - budget, 0), np.minimum(place[tail] + m + budget, w.length[window])
    first = np.maximum(a - m - budget, 0)
    size = b - first
    real = b >= a
    order = np.flatnonzero(real)[np.argsort(size[real], kind="stable")]
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, CELLS // (int(size[order[lo]]) + m + 2)))
        hi = max(lo + 1, min(hi, int(np.searchsorted(size[order], 2 * size[order[lo]] + 8, "right"))))
        rows = order[lo:hi]
        width = int(size[rows].max())
        ends = profile(w.table(window[rows], first[rows], width), index.masks[tag[rows]])
        at = first[rows, None] + np.arange(width + 1)
        row, end, cost, span, indels = minima(ends, (at >= a[rows, None]) & (at <= b[rows, None]), budget)
        end = end + first[rows[row]]
        yield hits(window[rows[row]], end - span, 0, index.places[tag[rows[row]]], end, cost, indels, cost - indels)
        lo = hi


def anchored(w: Windows, index: Index, mismatch: int, indel: int, total: int) -> Iterator[np.ndarray]:
    """Best alignment of a tag from each window's first base on, by (cost, indels, |end - length|)."""
    m, every = index.m, np.arange(len(w.length))
    pairs = [(every, np.full(len(every), t)) for t in index.rest]
    if found := [*index.candidates(w, indel)]:
        packed = np.unique(np.concatenate([x[0] * len(index.places) + x[1] for x in found]))
        pairs.append((packed // len(index.places), packed % len(index.places)))
    for all_windows, all_tags in pairs:
        for lo in range(0, len(all_windows), max(1, CELLS // ((indel + 1) * (m + indel + 1)))):
            rows, tag = (x[lo : lo + max(1, CELLS // ((indel + 1) * (m + indel + 1)))] for x in (all_windows, all_tags))
            width = m + indel
            masks, tags = w.table(rows, np.zeros(len(rows), np.int64), width), index.masks[tag]
            table = np.full((indel + 1, len(rows), width + 1), _OVER, np.int64)  # fewest substitutions by indels and end
            for e in range(indel + 1):
                table[e, :, e] = 0
            for i in range(m):
                new = np.full_like(table, _OVER)
                differs = (masks & tags[:, i, None]) == 0
                for e in range(indel + 1):
                    new[e, :, 1:] = table[e, :, :-1] + differs
                    if e:
                        new[e] = np.minimum(new[e], table[e - 1])
                        new[e, :, 1:] = np.minimum(new[e, :, 1:], new[e - 1, :, :-1])
                table = new
            end, none = np.arange(width + 1), np.iinfo(np.int64).max
            best = np.full(len(rows), none)
            for e in range(indel + 1):
                ok = (table[e] <= mismatch) & (table[e] + e <= total) & (end <= w.length[rows, None]) & (end > 0)
                rank = np.where(ok, (table[e] + e) << 48 | e << 40 | np.abs(end - m) << 20 | end, none)
                best = np.minimum(best, rank.min(1))
            some = best < none
            rank = best[some]
            cost, indels = rank >> 48, rank >> 40 & 0xFF
            yield hits(rows[some], np.zeros(some.sum(), np.int64), 0, index.places[tag[some]], rank & 0xFFFFF, cost, indels, cost - indels)


def overhangs(w: Windows, index: Index, group: Group) -> Iterator[np.ndarray]:
    """Tags cut at a window's edge: no indels, cost of one for each base beyond it."""
    m = index.m
    for policy, left in ((group.partial5, True), (group.partial3, False)):
        if not policy:
            continue
        least, share = policy
        for over in range(1, m - max(least, 1) + 1):
            kept = m - over
            fits = np.flatnonzero(w.length >= kept)
            start = np.zeros(len(fits), np.int64) if left else w.length[fits] - kept
            masks = w.table(fits, start, kept)
            for place, tag in zip(index.places, index.masks, strict=True):
                own = tag[over:] if left else tag[:kept]
                subs = ((masks & own) == 0).sum(1)
                ok = subs <= share * kept
                n = int(ok.sum())
                yield hits(fits[ok], start[ok], 0, np.full(n, place), start[ok] + kept, subs[ok] + over, np.zeros(n, np.int64), subs[ok])


class Searcher:
    """The indices of a group's tags."""

    def __init__(self, group: Group):
        self.group = group
        self.forward = self._indices([t.seq.upper() for t in group.tags])
        self.back = self._indices([revcomp_text(t.seq.upper())[::-1] for t in group.tags]) if group.both_strands else []

    def _indices(self, seqs: list[str]) -> list[Index]:
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(seqs):
            by_length.setdefault(len(s), []).append(i)
        return [Index([tag_mask(seqs[i]) for i in own], own, self.group.total) for own in by_length.values()]

    def find(self, texts: list[str]) -> np.ndarray:
        """Accepted matches in the windows as rows of hits(), by window in total order."""
        group, whole = self.group, windows_of(texts)
        out = [np.zeros((0, 9), np.int64)]
        ends = np.cumsum(whole.length)
        lo = 0
        while lo < len(texts):
            hi = min(lo + WINDOWS, max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BASES, "right"))))
            w = whole.part(lo, hi)
            found: list[np.ndarray] = []
            for index in self.forward:
                if group.anchor == "5p":
                    found += anchored(w, index, group.mismatch, group.indel, group.total)
                else:
                    found += [within_limits(x, group) for x in slide(w, index, group.total)]
                    found += overhangs(w, index, group)
            if self.back:  # reversed windows, so that plateaus mirror
                back, mirrored = w.reversed(), replace(group, partial5=group.partial3, partial3=group.partial5)
                for index in self.back:
                    for x in [*(within_limits(y, group) for y in slide(back, index, group.total)), *overhangs(back, index, mirrored)]:
                        n = w.length[x[:, 0]]
                        x[:, 2], x[:, 6], x[:, 3] = n - x[:, 6], n - x[:, 2], 1
                        found.append(x)
            if found:
                rows = np.concatenate(found)
                rows[:, 0] += lo
                out.append(np.unique(rows, axis=0))
            lo = hi
        return np.concatenate(out)


def search(texts: list[str], group: Group) -> list[list[tuple]]:
    """Accepted matches of a group's tags in each window, in total order."""
    found: list[list[tuple]] = [[] for _ in texts]
    for w, *row in Searcher(group).find(texts).tolist():
        found[w].append(tuple(row))
    return found


_searchers: dict[tuple, Searcher] = {}


def _searcher(group: Group, seqs: str) -> Searcher:
    """The searcher of a group whose tags' sequences come as one text; a worker keeps the last few."""
    key = (group, seqs)
    if key not in _searchers:
        if len(_searchers) > 8:
            _searchers.clear()
        _searchers[key] = Searcher(replace(group, tags=tuple(Tag("", s) for s in seqs.split("\n"))))
    return _searchers[key]


def search_column(window: Column, group: Group) -> Column:
    """Accepted matches in a window column, each distinct window of a batch searched once."""
    seqs, bare = "\n".join(t.seq for t in group.tags), replace(group, tags=())

    @F.arrow_udf(_FOUND)
    def found(windows: pa.Array) -> pa.Array:
        codes, distinct = pd.factorize(windows.to_numpy(zero_copy_only=False))
        rows = _searcher(bare, seqs).find([str(x) for x in distinct])
        bounds = np.searchsorted(rows[:, 0], np.arange(len(distinct) + 1))
        n = np.where(codes >= 0, np.append(np.diff(bounds), 0)[codes], 0)
        offsets = np.append(0, np.cumsum(n))
        at = np.repeat(np.append(bounds[:-1], 0)[codes], n) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
        values = pa.StructArray.from_arrays([pa.array(rows[at, k].astype(np.int32)) for k in range(1, 9)], names=list(_FIELDS))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(codes < 0))

    return found(window)
