"""Language-model scores: a hierarchical Pitman-Yor model of words after their context.

Restaurants: one for each context (the word before; the start of a text is one of its
own), all sharing one parent, the restaurant of words, over a uniform base of the known
words and one unknown. Seating is sampled by Gibbs: in each sweep every customer of every
dish of every context is seated again. Only numbers of tables count, so a dish's is drawn
at once from its conditional (Stirling numbers times weights of new tables), with no
limit. Predictive probabilities are averaged over several samples.

Three jobs, each with a shuffle on keys of its own, and a small one:

1. Words are dealt to shards by hash, with their tokens. A shard counts its (word, context)
   pairs. Given one table of each pair, a word's tables in the parent hang on the other
   words by their number alone: it is the one that the expectations of all words add up
   to, found from how many words have how many pairs in all shards.
2. Each shard draws the tables of its words given that number (a small job adds them up), and
   contexts are dealt to parts by hash, with the pairs' counts. A part has whole context
   restaurants, so it samples their seating with exact totals; the parent's probabilities
   are held. A pair of one customer has one table and is only counted.
3. Shards get the totals of their contexts and the tables of their pairs back, in the order
   in which they sent them. A word's customers in the parent are the tables that the
   contexts then have; probabilities use exact sums throughout, so they add up to one. Sums
   for each text go back to the group of texts it came with.

What one word, context or pair may hold is not bounded, so the few with more than a quarter
of a shard's tokens (their number follows from that) are split: a word's tokens by context, a
context's pairs by shard (each part is sampled given the tables that all of them are
expected to have, from sums over the shards), and of a pair only counts are sent, while its probability comes
back to each group of texts. Their sums, and sums over all, are what meets in the driver.

Words are told apart by 64-bit hashes, contexts by 32 bits within their part.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.llm.common import materialize, mix64, pick, scratch_path, split_key, text_chunks, word_bounds, word_keys

#: Parts of a word or context that holds much of the corpus.
PARTS = 64
TOKENS_PER_SHARD = 1_500_000
#: Bytes of text whose tokens go out together, and texts at most (a text's place takes 15 bits).
FLUSH_BYTES, FLUSH_TEXTS = 8 << 20, 30_000
#: Words and pairs under this share of a group of texts are not looked at as frequent ones.
RARE_BITS = 16
BURN_IN, SAMPLES = 3, 3
#: Customers up to which all weights of the numbers of tables are held; beyond, the grid of counts has FINE steps for a factor of e.
EXACT, FINE = 1024, 256
#: Parts of the dishes that are drawn in turn, each with the totals that the part before left.
TURNS = 4
#: Discount and strength of the context restaurants and of their parent.
DISCOUNT, STRENGTH = (0.8, 0.75), (4.0, 10.0)
_END = np.uint64(0x1F83D9ABFB41BD6B)
_START = np.uint64(0)


@lru_cache(2)
def log_ways(discount: float) -> np.ndarray:
    """[c, t]: log of the weight of all seatings of c customers at t tables (generalised Stirling numbers)."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        stay = np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1 : c + 2]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def _small_weights(customers: np.ndarray, room: np.ndarray, discount: float, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dishes, weight of each number of tables from 1 on) of dishes with 1 to EXACT customers, some at a time."""
    ways = log_ways(discount)
    order = np.argsort(customers, kind="stable")
    sizes = customers[order]
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(sizes, max(int(sizes[lo]) + 1, int(sizes[lo]) * 5 // 4), "left"))
        width = int(sizes[hi - 1])
        hi = min(hi, lo + max(1, (1 << 19) // width))
        who = order[lo:hi]
        weight = np.log((room[who, None] + discount * np.arange(width)) * p[who, None])
        np.cumsum(weight, axis=1, out=weight)
        weight += ways[sizes[lo:hi], 1 : width + 1]
        weight -= weight.max(1, keepdims=True)
        np.exp(weight, out=weight)
        yield who, weight
        lo = hi


def draw_tables(customers: np.ndarray, room: np.ndarray, discount: float, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with 1 to EXACT customers, all of whom are seated anew, from the exact conditional.

    `room`: strength and discounts of the restaurant without the dish; `p`: the parent's
    probability of the dish. A table that opens as the k-th has the weight (room + k * discount) * p.
    """
    out = np.empty(len(customers), np.int64)
    for who, weight in _small_weights(customers, room, discount, p):
        np.cumsum(weight, axis=1, out=weight)
        out[who] = 1 + (weight[:, :-1] <= rng.random((len(who), 1)) * weight[:, -1:]).sum(1)
    return np.minimum(out, customers)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers."""
    below = x.copy()
    for k in range(1, 8):
        below *= x + k
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(below)


class Ways:
    """log_ways() of a few large counts, for t = 1, 2, ... as far as asked for.

    The sum over the customers at which table t opens is taken over each up to EXACT,
    beyond that over a grid whose steps grow by a FINE-th, each step a geometric series.
    So the work grows with the logarithm of the counts, and the tables are not limited.
    """

    def __init__(self, counts: np.ndarray, discount: float):
        self.discount, most = discount, int(counts.max())
        grid = [np.arange(1, EXACT + 1), counts]
        if most > EXACT:
            grid.append(np.exp(np.arange(np.log(EXACT), np.log(most), 1 / FINE)).astype(np.int64))
        self.grid = np.unique(np.concatenate(grid))
        self.step = np.diff(self.grid).astype(np.float64)
        self.at = np.searchsorted(self.grid, counts)
        self.last = _lgamma(self.grid - discount) - _lgamma(np.array([1 - discount]))[0]
        self.rows = self.last[self.at][:, None]

    def upto(self, t_max: int) -> np.ndarray:
        """[k, t - 1] of the k-th count."""
        rows = [self.rows]
        for t in range(self.rows.shape[1] + 1, t_max + 1):
            now = np.full(len(self.grid), -np.inf)
            k = int(np.searchsorted(self.grid, t))
            if k < len(self.grid):
                c = self.grid[k:] - self.discount * t
                stay = _lgamma(c)
                opens = self.last[k:] - stay - np.log(c)  # table t opens after so many customers
                n, rise = self.step[k:], np.diff(opens)
                rise = np.where(np.isfinite(rise) & (np.abs(rise) > 1e-9), rise, 1e-9)
                seg = opens[:-1] + np.log(np.expm1(rise) / np.expm1(rise / n))
                # before the grid's first count over t next to nothing opens that lasts
                first = -_lgamma(np.array([t - self.discount * t]))[0] if self.grid[k] == t else opens[0]
                now[k:] = np.logaddexp.accumulate(np.append(first, seg)) + stay
            self.last = now
            rows.append(now[self.at][:, None])
        self.rows = np.concatenate(rows, axis=1)
        return self.rows


def _large_weights(counts: np.ndarray, ways: Ways, room: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights of the numbers of tables for counts over EXACT: as many tables are looked at as have any weight."""
    t_max, discount = 256, ways.discount
    while True:
        t_max = min(t_max, int(counts.max()))
        weight = np.cumsum(np.log((room[:, None] + discount * np.arange(t_max)) * p[:, None]), axis=1) + ways.upto(t_max)[:, :t_max]
        weight[np.arange(1, t_max + 1) > counts[:, None]] = -np.inf
        weight -= weight.max(1, keepdims=True)
        if t_max == counts.max() or (weight[:, -1] < -40).all():
            return np.exp(weight)
        t_max = t_max * 5 // 4


def draw_large(counts: np.ndarray, ways: Ways, room: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """draw_tables() for counts over EXACT."""
    weight = np.cumsum(_large_weights(counts, ways, room, p), axis=1)
    return 1 + (weight[:, :-1] <= rng.random((len(counts), 1)) * weight[:, -1:]).sum(1)


class Dishes:
    """Draws and means of the tables of many dishes, given what else is in their restaurants."""

    def __init__(self, customers: np.ndarray, discount: float):
        self.customers, self.discount = customers, discount
        self.few, self.large = np.flatnonzero((customers > 1) & (customers <= EXACT)), np.flatnonzero(customers > EXACT)
        self.ways = Ways(customers[self.large], discount) if len(self.large) else None

    def draw(self, room: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out = np.minimum(self.customers, 1).astype(np.int64)
        out[self.few] = draw_tables(self.customers[self.few], room[self.few], self.discount, p[self.few], rng)
        if self.ways:
            out[self.large] = draw_large(self.customers[self.large], self.ways, room[self.large], p[self.large], rng)
        return out

    def mean(self, room: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.minimum(self.customers, 1).astype(np.float64)
        found = [(self.few[who], w) for who, w in _small_weights(self.customers[self.few], room[self.few], self.discount, p[self.few])]
        if self.ways:
            found.append((self.large, _large_weights(self.customers[self.large], self.ways, room[self.large], p[self.large])))
        for who, weight in found:
            out[who] = weight @ np.arange(1, weight.shape[1] + 1) / weight.sum(1)
        return out


class Restaurants:
    """Tables of all dishes of one level, each drawn with all its customers seated anew; at first one each."""

    def __init__(self, customers: np.ndarray, discount: float, strength: float, rng: np.random.Generator):
        self.discount, self.strength, self.rng = discount, strength, rng
        self.tables = np.minimum(customers, 1)
        self.ways: tuple[np.ndarray, Ways] | None = None

    def sweep(self, customers: np.ndarray, total: np.ndarray, of: np.ndarray, held: np.ndarray, p: np.ndarray) -> None:
        """Seat every customer anew. `total[of[i]]`, kept up to date: tables of the dish's restaurant, where `held[of[i]]` gives none (0)."""
        single = np.flatnonzero((customers == 1) & (self.tables > 1))
        np.add.at(total, of[single], 1 - self.tables[single])
        self.tables[single] = 1
        large = np.flatnonzero(customers > EXACT)
        if len(large) and (self.ways is None or not np.array_equal(self.ways[0], customers[large])):
            self.ways = customers[large], Ways(customers[large], self.discount)
        mixed = self.rng.permutation(np.flatnonzero((customers > 1) & (customers <= EXACT)))
        for who in [*np.array_split(mixed, TURNS), large]:
            if len(who):
                own = np.where(held[of[who]] > 0, held[of[who]], total[of[who]])
                room = self.strength + self.discount * np.maximum(own - self.tables[who], 0)
                if customers[who[0]] > EXACT:
                    now = draw_large(customers[who], self.ways[1], room, p[who], self.rng)
                else:
                    now = draw_tables(customers[who], room, self.discount, p[who], self.rng)
                np.add.at(total, of[who], now - self.tables[who])
                self.tables[who] = now


@dataclass
class Totals:
    """Sums over all shards and parts."""

    tokens: int = 0  # of training
    known: int = 0  # words
    pairs: int = 0  # different (word, context) pairs
    tables: int = 0  # of the parent
    expected: float = 0.0  # tables of the parent, before they are drawn
    words_of: dict[int, int] = field(default_factory=dict)  # words that aren't split, by their number of pairs
    open_of: dict[int, np.ndarray] = field(default_factory=dict)  # split contexts: tokens, pairs of one customer, other pairs, their tokens
    curve: dict[int, np.ndarray] = field(default_factory=dict)  # split contexts: tables expected if there were as many as at each of the POINTS
    held: dict[int, float] = field(default_factory=dict)  # split contexts: tables expected
    customers: np.ndarray | int = 0  # of the parent, for each sample
    words: dict[int, np.ndarray] = field(default_factory=dict)  # split words: tokens, pairs, tables opened beyond one a pair in each sample
    contexts: dict[int, np.ndarray] = field(default_factory=dict)  # split contexts: tokens, tables in each sample
    word_tables: dict[int, int] = field(default_factory=dict)  # of split words

    def add(self, other: Totals) -> None:
        for name in ("tokens", "known", "pairs", "tables", "customers"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        for mine, its in ((getattr(self, name), getattr(other, name)) for name in ("words", "contexts", "words_of", "open_of", "curve")):
            for k, v in its.items():
                mine[k] = mine.get(k, 0) + v

    def root(self) -> float:
        """Weight of the base, for each word and the unknown one."""
        return (STRENGTH[1] + DISCOUNT[1] * self.tables) / (self.known + 1)


def _binned(hist: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(customers, words) of a histogram; beyond EXACT, counts within a hundredth are one."""
    c = np.array(sorted(hist), np.int64)
    n = np.array([hist[int(x)] for x in c], np.float64)
    bin_ = np.where(c <= EXACT, c, EXACT + np.floor(np.log(np.maximum(c, 1) / EXACT) * 100).astype(np.int64) + 1)
    first = _starts(bin_)
    weight = np.add.reduceat(n, first) if len(first) else n
    return (np.rint(np.add.reduceat(n * c, first) / weight).astype(np.int64) if len(first) else c), weight


def expected_tables(hist: dict[int, int], known: int) -> float:
    """Tables of the parent: the number that its words' expected tables add up to, given that there are as many."""
    c, n = _binned({k: v for k, v in hist.items() if k > 0})
    if not len(c):
        return 0.0
    dishes, p = Dishes(c, DISCOUNT[1]), np.full(len(c), 1 / (known + 1))
    each, total = np.ones(len(c)), float(n.sum())
    for _ in range(200):
        each = dishes.mean(STRENGTH[1] + DISCOUNT[1] * np.maximum(total - each, 0), p)
        before, total = total, float(n @ each)
        if abs(total - before) <= 1e-5 * total:
            break
    return total


def word_tables(pairs: np.ndarray, expected: float, known: int, seed: list[int]) -> np.ndarray:
    """Tables of words in the parent, drawn given how many it has; the same for the same seed."""
    dishes, p, rng = Dishes(pairs, DISCOUNT[1]), np.full(len(pairs), 1 / (known + 1)), np.random.default_rng(seed)
    own = dishes.draw(np.full(len(pairs), STRENGTH[1] + DISCOUNT[1] * expected), p, rng)
    return dishes.draw(STRENGTH[1] + DISCOUNT[1] * np.maximum(expected - own, 0), p, rng)


#: Where the expected tables of a split context are looked at, between one a pair (0) and one a token (1).
POINTS = (0.0, 0.5, 1.0)


def _span(of: np.ndarray) -> tuple[float, float]:
    """Fewest and most tables of a split context."""
    tokens, single, several, rest = of
    return max(1.0, float(single + several)), max(1.0, float(single + rest))


def settle(curve: np.ndarray, low: float, high: float) -> float:
    """The number of tables that is expected if there are as many, from the expectations at POINTS."""
    if high <= low * (1 + 1e-9):
        return low
    at = np.linspace(0, 1, 513)
    expected = np.polyval(np.polyfit(POINTS, np.log(np.maximum(curve, low)), 2), at)
    over = expected - (np.log(low) + at * np.log(high / low))
    return float(low * (high / low) ** at[int(np.argmin(np.where(over <= 0, at, 2)))]) if (over <= 0).any() else high


def context_tables(context: np.ndarray, count: np.ndarray, p: np.ndarray, single: np.ndarray, held: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the tables of each pair with several customers, and of each context.

    `context`, `count`, `p`: of these pairs, `p` the parent's probability of the word.
    `single`: pairs of one customer of each context; `held`: of a context split into parts
    the tables expected in all of them, else 0.
    """
    level = Restaurants(count, DISCOUNT[0], STRENGTH[0], rng)
    total = single + np.bincount(context, level.tables, len(single)).astype(np.int64)
    tables, totals = [], []
    for sweep in range(BURN_IN + SAMPLES):
        level.sweep(count, total, context, held, p)
        if sweep >= BURN_IN:
            tables.append(level.tables.copy())
            totals.append(total.copy())
    return np.array(tables), np.array(totals)


def predictive(totals: Totals, word: np.ndarray, seen: np.ndarray, tables: np.ndarray, customers: np.ndarray, word_tables: np.ndarray, in_context: np.ndarray, context_tables: np.ndarray) -> np.ndarray:
    """Probability of each (word, context) pair averaged over the samples.

    Of pairs: their word, training count, tables in each sample, and the context's tokens
    and tables. Of words: customers in each sample and tables in the parent.
    """
    (d2, d1), (s2, s1) = DISCOUNT, STRENGTH
    p = np.zeros(len(word))
    for s in range(SAMPLES):
        of_word = (customers[s] - d1 * word_tables + totals.root()) / (s1 + totals.customers[s])
        p += (seen - d2 * tables[s] + (s2 + d2 * context_tables[s]) * of_word[word]) / (s2 + in_context)
    return p / SAMPLES


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """Even parts of the space of 64-bit keys."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _pair_keys(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix64(word ^ mix64(context + np.uint64(0x5B)))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted ones, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys, at


def _starts(*arrays: np.ndarray) -> np.ndarray:
    """Where a run of equal values of all arrays begins."""
    if not len(arrays[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in arrays])))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mostly small whole numbers: a byte each, and the places and values of those from 255 on."""
    far = np.flatnonzero(x >= 255)
    return np.minimum(x, 255).astype(np.uint8), _narrow(far), _narrow(x[far])


def _unpack(packed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    out = packed[0].astype(np.int64)
    out[packed[1]] = packed[2]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc ids, held flags, token counts, keys, contexts, text index of each token) of groups of texts."""
    held: list[tuple] = []
    size = texts = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, FLUSH_TEXTS):
            for rows, data, offsets in text_chunks(batch.slice(lo, FLUSH_TEXTS), "text"):
                starts, ends, bounds = word_bounds(data, offsets)
                words = word_keys(data, starts, ends)
                n = np.diff(bounds)
                # a place for the end after each text's words
                own = np.repeat(np.arange(len(n)), n + 1)
                last = np.cumsum(n + 1) - 1
                keys = np.empty(len(own), np.uint64)
                keys[last] = _END
                inner = np.ones(len(own), bool)
                inner[last] = False
                keys[inner] = words
                context = np.empty(len(own), np.uint64)
                context[1:] = keys[:-1]
                context[last - n] = _START
                if held and (texts + rows.num_rows > FLUSH_TEXTS or size > FLUSH_BYTES):
                    yield _join(held)
                    held, size, texts = [], 0, 0
                held.append((rows.column(0), np.array(rows.column(2)), n + 1, keys, context, own + texts))
                size, texts = size + len(data), texts + rows.num_rows
    if held:
        yield _join(held)


def _join(held: list[tuple]) -> tuple:
    ids = pa.chunked_array([h[0] for h in held]).combine_chunks()
    return (ids, *[np.concatenate([h[k] for h in held]) for k in range(1, 6)])


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    """(kind, batch, shard, part, content) rows."""
    return _rows(["kind", "batch", "shard", "part", "blob"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], [(*r[:4], pickle.dumps(r[4], 5)) for r in rows])


_BLOBS = "kind int, batch long, shard int, part int, blob binary"
TEXTS, STATE, SUMS, ASKED, ANSWER, WORDS = range(6)  # kinds


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, key, n) of a group: all tokens (0), words (1) and pairs (2) that are not rare in it."""
    for _, _, n, keys, context, _ in _scan(batches):
        out = [(0, 0, len(keys))]
        for what, every in ((1, keys), (2, _pair_keys(keys, context))):
            every = np.sort(every)
            first = _starts(every)
            count = np.diff(np.append(first, len(every)))
            often = count > len(keys) >> RARE_BITS
            out += [(what, k, c) for k, c in zip(every[first[often]].view(np.int64).tolist(), count[often].tolist(), strict=True)]
        yield _rows(["what", "key", "n"], [pa.int32(), pa.int64(), pa.int64()], out)


@dataclass
class Plan:
    """How keys are dealt: the shards' labels, and the keys with more than a quarter of a shard's tokens."""

    labels: list[int]
    words: np.ndarray
    pairs: np.ndarray

    def __post_init__(self) -> None:
        self.shards = len(self.labels)
        often = np.append(self.words, np.zeros(int(np.isin(_END, self.words)), np.uint64))  # as many starts as ends
        often = np.sort(often)
        code = _part(often, self.shards) << 32 | (often & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.contexts = np.sort(code)

    def home(self, context: np.ndarray, shard: int) -> np.ndarray:
        """The part of split contexts (as codes) for a shard."""
        return _part(mix64(context.astype(np.uint64) * np.uint64(PARTS) + np.uint64(shard % PARTS)), self.shards)


def _deal(plan: Plan):
    """Tokens by shard (STATE, still without it) and the texts of each group (TEXTS)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (ids, held, n, keys, context, text) in enumerate(_scan(batches)):
            group = task << 32 | number
            text = text.astype(np.uint16) | held[text].astype(np.uint16) << np.uint16(15)
            extra, counted = None, (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if len(plan.pairs):  # of these only counts go out
                pair = _pair_keys(keys, context)
                much, at = _find(plan.pairs, pair)
                where, first, inverse = np.unique(at[much], return_index=True, return_inverse=True)
                trained = np.bincount(inverse, text[much] < 1 << 15, len(where)).astype(np.int64)
                extra = keys[much][first], context[much][first], trained, plan.pairs[where]
                both, count = np.unique((text[much] & np.uint16(0x7FFF)).astype(np.int64) * len(plan.pairs) + at[much], return_counts=True)
                counted = both // len(plan.pairs), plan.pairs[both % len(plan.pairs)], count
                keys, context, text = keys[~much], context[~much], text[~much]
            dealt = _dealt(plan, keys, context)
            order = np.argsort(dealt & ~np.uint64(0xFFFFFFFF) | context & np.uint64(0xFFFFFFFF))
            keys, context, text, shard = keys[order], context[order], text[order], _part(dealt[order], plan.shards)
            words, pairs = _starts(keys, shard), _starts(keys, context, shard)
            size, inside = np.diff(np.append(pairs, len(keys))), np.diff(np.append(np.searchsorted(pairs, words), len(pairs)))
            part, low = _narrow(_part(context[pairs], plan.shards)), (context[pairs] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cut = np.searchsorted(shard, np.arange(plan.shards + 1))
            cut_w, cut_p = np.searchsorted(words, cut), np.searchsorted(pairs, cut)
            to = _part(_dealt(plan, *extra[:2]), plan.shards) if extra else None
            rows = [(TEXTS, group, plan.labels[group % plan.shards], 0, (ids, held, n.astype(np.uint32), *counted))]
            for k in range(plan.shards):
                more = tuple(x[to == k] for x in extra) if extra else None
                if cut[k] < cut[k + 1] or more and len(more[0]):
                    w, p = slice(cut_w[k], cut_w[k + 1]), slice(cut_p[k], cut_p[k + 1])
                    rows.append((STATE, group, plan.labels[k], k, (keys[words[w]], _narrow(inside[w]), part[p], low[p], _narrow(size[p]), text[cut[k] : cut[k + 1]], more)))
            yield _blobs(rows)

    return deal


def _dealt(plan: Plan, keys: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The key that a token is dealt by: its word's, or of a split word a key of it and a part of the contexts."""
    out = keys.copy()
    much, _ = _find(plan.words, keys)
    out[much] = mix64(keys[much] + context[much] % np.uint64(PARTS) + np.uint64(1))
    return out


def _close(plan: Plan, shard: int, blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """State, sums and words of a shard whose tokens have all come."""
    groups, parts = np.array([g for g, _ in blobs], np.int64), [pickle.loads(b) for _, b in blobs]
    extra = [p[6] for p in parts if p[6] is not None]
    extra_group = np.repeat([g for g, p in enumerate(parts) if p[6] is not None], [len(e[0]) for e in extra]).astype(np.int64)
    extra_word, extra_context, extra_count, extra_key = (np.concatenate([e[k] for e in extra]) if extra else np.zeros(0, np.uint64 if k != 2 else np.int64) for k in range(4))
    # runs of tokens of one pair, and each counted pair as a run without tokens
    keys, at = np.unique(np.concatenate([*[p[0] for p in parts], extra_word]), return_inverse=True)
    runs = np.concatenate([*[p[4] for p in parts], np.zeros(len(extra_word), np.int64)]).astype(np.int64)
    word = np.repeat(at, np.concatenate([*[p[1] for p in parts], np.ones(len(extra_word), np.int64)]).astype(np.int64))
    code = np.concatenate([*[p[2].astype(np.int64) << 32 | p[3].astype(np.int64) for p in parts], _part(extra_context, plan.shards) << 32 | (extra_context & np.uint64(0xFFFFFFFF)).astype(np.int64)])
    text, group = np.concatenate([p[5] for p in parts]), np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p[5]) for p in parts])
    del parts
    order = np.lexsort((code, word))
    first = _starts(word[order], code[order])
    pair = np.empty(len(order), np.int64)
    pair[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    word, code = word[order][first], code[order][first]
    token = np.repeat(pair, runs)
    seen = np.bincount(token, text < 1 << 15, len(first)).astype(np.int64) + np.bincount(pair[len(pair) - len(extra_word) :], extra_count, len(first)).astype(np.int64)
    size = np.bincount(token, minlength=len(first))
    order = np.argsort(token, kind="stable")
    text, group = text[order], group[order]
    del token, order
    # contexts, in the order of the parts that they are asked of
    codes, context = np.unique(code, return_inverse=True)
    split, hot = _find(plan.contexts, codes)
    asked = codes.copy()
    asked[split] = plan.home(codes[split], shard) << 32 | codes[split] & 0xFFFFFFFF
    order = np.argsort(asked, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes, split, hot, context = asked[order], split[order], hot[order], place[context]
    count = np.bincount(word, seen, len(keys)).astype(np.int64)
    pairs = np.bincount(word, seen > 0, len(keys)).astype(np.int64)
    whole = ~_find(plan.words, keys)[0]
    live = np.flatnonzero(whole & (count > 0))
    shared = {int(keys[i]): np.concatenate([[count[i], pairs[i]], np.zeros(SAMPLES, np.int64)]) for i in np.flatnonzero(~whole)}
    own, single = np.bincount(context, seen, len(codes)).astype(np.int64), np.bincount(context, seen == 1, len(codes)).astype(np.int64)
    much = np.flatnonzero(split[context] & (seen > 1))
    several, tokens = np.bincount(context[much], minlength=len(codes)), np.bincount(context[much], seen[much], len(codes)).astype(np.int64)
    open_of = {int(h): np.array([own[k], single[k], several[k], tokens[k]], np.int64) for k, h in zip(np.flatnonzero(split), hot[split], strict=True)}
    words_of = dict(zip(*(x.tolist() for x in np.unique(pairs[live], return_counts=True)), strict=True))
    yield _blobs([(SUMS, 0, plan.labels[shard], 0, Totals(int(count.sum()), len(live), int(pairs.sum()), words=shared, words_of=words_of, open_of=open_of))])
    # the words' pairs, and the pairs of split contexts: context, customers, word (negative: a split one)
    place = np.full(len(keys), -1)
    place[live] = np.arange(len(live))
    place[~whole] = -1 - np.searchsorted(plan.words, keys[~whole])
    yield _blobs([(WORDS, 0, plan.labels[shard], shard, (_narrow(pairs[live]), _narrow(hot[context[much]]), _pack(seen[much]), place[word[much]].astype(np.int32)))])
    inside = np.bincount(word, minlength=len(keys))
    counted = (pair[len(pair) - len(extra_word) :], extra_key, extra_group)
    asked = _narrow(codes >> 32), (codes & 0xFFFFFFFF).astype(np.uint32)
    state = (shard, groups, keys, *map(_narrow, (count, inside, context, size, seen, pairs, text & np.uint16(0x7FFF), group)), np.flatnonzero(split), hot[split], counted, asked)
    yield _blobs([(STATE, 0, plan.labels[shard], shard, state)])


def _parent(plan: Plan, totals: Totals, shard: int, keys: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Tables of a shard's words in the parent; of split words those that all shards share."""
    split = _find(plan.words, keys)[0]
    live = np.flatnonzero(~split & (count > 0))
    out = np.zeros(len(keys), np.int64)
    out[live] = word_tables(pairs[live], totals.expected, totals.known, [1, shard])
    for i in np.flatnonzero(split):
        out[i] = totals.word_tables[int(keys[i])]
    return out


def _draw(plan: Plan, shared):
    """Of each shard's WORDS: the tables of its words, and what split contexts are expected to have (SUMS)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Totals = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(3)[i].as_py()
                pairs, hot, seen, place = pickle.loads(batch.column(4)[i].as_py())
                own = word_tables(pairs.astype(np.int64), totals.expected, totals.known, [1, shard])
                curve: dict[int, np.ndarray] = {}
                if len(hot):
                    weight = np.append(pairs - DISCOUNT[1] * own, [totals.words[int(k)][1] - DISCOUNT[1] * totals.word_tables[int(k)] for k in plan.words[::-1]])
                    p = (weight[place] + (STRENGTH[1] + DISCOUNT[1] * totals.expected) / (totals.known + 1)) / (STRENGTH[1] + totals.pairs)
                    dishes, each = Dishes(_unpack(seen), DISCOUNT[0]), np.ones(len(hot))
                    contexts, of = np.unique(hot, return_inverse=True)
                    spans = np.log([_span(totals.open_of[int(k)]) for k in contexts])
                    found = []
                    for x in POINTS:
                        total = np.exp(spans[:, 0] + x * (spans[:, 1] - spans[:, 0]))
                        each = dishes.mean(STRENGTH[0] + DISCOUNT[0] * np.maximum(total[of] - each, 0), p)
                        found.append(np.bincount(of, each, len(contexts)))
                    curve = dict(zip(contexts.tolist(), np.array(found).T, strict=True))
                yield _blobs([(SUMS, 0, 0, 0, Totals(tables=int(own.sum()), curve=curve))])

    return draw


def _ask(plan: Plan, shared):
    """The questions (ASKED) of each shard's STATE to the parts of its contexts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Totals = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard, _, keys, count, inside, context, _, seen, pairs, *_, (part, low) = pickle.loads(batch.column(4)[i].as_py())
                context, seen, part = (x.astype(np.int64) for x in (context, seen, part))
                word = np.repeat(np.arange(len(keys)), inside.astype(np.int64))
                own, single = np.bincount(context, seen, len(low)).astype(np.int64), np.bincount(context, seen == 1, len(low)).astype(np.int64)
                several = _several(context, seen)
                weight = pairs - DISCOUNT[1] * _parent(plan, totals, shard, keys, count, pairs.astype(np.int64))
                split = _find(plan.words, keys)[0]
                weight[split] = -1 - np.searchsorted(plan.words, keys[split])
                cut = _starts(part)
                bound = np.searchsorted(context[several], np.append(cut, len(part)))
                for k, (a, b) in enumerate(zip(cut, np.append(cut[1:], len(part)), strict=True)):
                    at = several[bound[k] : bound[k + 1]]
                    content = (low[a:b], _pack(own[a:b]), _pack(single[a:b]), _narrow(context[at] - a), _pack(seen[at]), weight[word[at]].astype(np.float32))
                    yield _blobs([(ASKED, 0, batch.column(2)[i].as_py(), int(part[a]), content)])

    return ask


def _several(context: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The pairs of more than one customer, by context."""
    at = np.flatnonzero(seen > 1)
    return at[np.argsort(context[at], kind="stable")]


def _shards(plan: Plan):
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                kind, group, shard = (batch.column(k)[i].as_py() for k in (0, 1, 3))
                if kind == TEXTS:
                    yield batch.slice(i, 1)
                    continue
                if now is not None and shard != now:
                    yield from _close(plan, now, blobs)
                    blobs = []
                now = shard
                blobs.append((group, batch.column(4)[i].as_py()))
        if blobs:
            yield from _close(plan, now, blobs)

    return seat


def _answer(plan: Plan, shared):
    """Seating of the contexts of each part; ANSWER rows to the shards that asked, and SUMS."""

    def close(part: int, asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
        totals: Totals = shared.value
        labels, blobs = [x for x, _ in asked], [pickle.loads(b) for _, b in asked]
        own, context = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        bound = np.append(0, np.cumsum([len(b[0]) for b in blobs]))
        tokens, single = (np.bincount(context, np.concatenate([_unpack(b[k]) for b in blobs]), len(own)).astype(np.int64) for k in (1, 2))
        of = np.concatenate([context[lo + b[3].astype(np.int64)] for lo, b in zip(bound[:-1], blobs, strict=True)])
        count, weight = np.concatenate([_unpack(b[4]) for b in blobs]), np.concatenate([b[5] for b in blobs]).astype(np.float64)
        split_word = np.where(weight < 0, -1 - weight, -1).astype(np.int64)
        for i in np.unique(split_word[split_word >= 0]):
            key = int(plan.words[i])
            weight[split_word == i] = totals.words[key][1] - DISCOUNT[1] * totals.word_tables[key]
        p = (weight + totals.root()) / (STRENGTH[1] + totals.pairs)
        home = {int(c & 0xFFFFFFFF): i for i, c in enumerate(plan.contexts) if part in set(plan.home(np.full(PARTS, c), np.arange(PARTS)).tolist())}
        hot = {k: home[int(own[k])] for k in np.flatnonzero(np.isin(own, np.array(list(home), np.uint32)))}
        held = np.zeros(len(own))
        for k, i in hot.items():
            held[k] = totals.held.get(i, 0.0)
        tables, total = context_tables(of, count, p, single, held, np.random.default_rng([2, part]))
        opened = {int(plan.words[i]): np.append([0, 0], (tables[:, split_word == i] - 1).sum(1)) for i in np.unique(split_word[split_word >= 0])}
        sums = Totals(customers=total.sum(1), words=opened, contexts={i: np.append(tokens[k], total[:, k]) for k, i in hot.items()})
        rows = [(SUMS, 0, 0, part, sums)]
        at = np.append(0, np.cumsum([len(b[3]) for b in blobs]))
        for k, label in enumerate(labels):
            c, t = context[bound[k] : bound[k + 1]], slice(at[k], at[k + 1])
            rows.append((ANSWER, 0, label, part, (_pack(tokens[c]), [_pack(x[c]) for x in total], [_pack(x[t]) for x in tables])))
        return _blobs(rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                shard, part, blob = (batch.column(k)[i].as_py() for k in (2, 3, 4))
                if now is not None and part != now:
                    yield close(now, asked)
                    asked = []
                now = part
                asked.append((shard, blob))
        if asked:
            yield close(now, asked)

    return answer


def _score(plan: Plan, shared):
    """(batch, kind, blob): what a shard's words give to the texts of each group."""

    def close(blob: bytes, answers: list[bytes]) -> pa.RecordBatch:
        totals: Totals = shared.value
        shard, groups, keys, count, inside, context, size, seen, pairs, text, group, split, hot, counted, _ = pickle.loads(blob)
        context, seen, size, count = (x.astype(np.int64) for x in (context, seen, size, count))
        tables_of = _parent(plan, totals, shard, keys, count, pairs.astype(np.int64))
        told = [pickle.loads(a) for a in answers]
        in_context = np.concatenate([_unpack(a[0]) for a in told])
        open_tables = np.array([np.concatenate([_unpack(a[1][s]) for a in told]) for s in range(SAMPLES)])
        for k, i in zip(split, hot, strict=True):
            in_context[k], open_tables[:, k] = totals.contexts[int(i)][0], totals.contexts[int(i)][1:]
        word = np.repeat(np.arange(len(keys)), inside.astype(np.int64))
        tables = np.tile(np.minimum(seen, 1), (SAMPLES, 1))
        tables[:, _several(context, seen)] = np.array([np.concatenate([_unpack(a[2][s]) for a in told]) for s in range(SAMPLES)])
        customers = np.array([np.bincount(word, t, len(keys)) for t in tables])
        for i in np.flatnonzero(_find(plan.words, keys)[0]):
            own = totals.words[int(keys[i])]
            count[i], customers[:, i] = own[0], own[1] + own[2:]
        score = np.log10(predictive(totals, word, seen, tables, customers, tables_of, in_context[context], open_tables[:, context]))
        base = np.log10((count + 0.1) / (totals.tokens + 0.1 * (totals.known + 1)))
        order = np.argsort(group.astype(np.int64) << 16 | text, kind="stable")
        of = np.repeat(np.arange(len(word)), size)[order]
        at = (group.astype(np.int64) << 16 | text)[order]
        first = _starts(at)
        sums = [np.add.reduceat(x[of], first) if len(first) else np.zeros(0) for x in (score, base[word], (count[word] > 0).astype(np.int64))]
        where = at[first]
        cut = np.searchsorted(where >> 16, np.arange(len(groups) + 1))
        rows = []
        for g, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            mine = counted[0][counted[2] == g]
            extra = counted[1][counted[2] == g], score[mine], base[word[mine]], (count[word[mine]] > 0).astype(np.int64)
            rows.append((int(groups[g]), 1, pickle.dumps(((where[a:b] & 0xFFFF).astype(np.uint16), sums[0][a:b], sums[1][a:b], _narrow(sums[2][a:b].astype(np.int64)), *extra), 5)))
        return _rows(["batch", "kind", "blob"], [pa.int64(), pa.int32(), pa.binary()], rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield close(batch.column(0)[i].as_py(), [a["blob"] for a in batch.column(1)[i].as_py()])

    return score


def _collect(tokens: int):
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def close(texts, parts: list[bytes]) -> pa.RecordBatch:
        ids, held, n, who, pair, times = texts
        sums = np.zeros((2, len(n)))
        known, of_pair = np.zeros(len(n), np.int64), {}
        for part in parts:
            at, score, base, k, *extra = pickle.loads(part)
            sums[0][at] += score
            sums[1][at] += base
            known[at] += k
            of_pair |= {x: y for x, *y in zip(*(e.tolist() for e in extra), strict=True)}
        for key in np.unique(pair):
            mine = pair == key
            score, base, k = of_pair[int(key)]
            sums[0][who[mine]] += times[mine] * score
            sums[1][who[mine]] += times[mine] * base
            known[who[mine]] += times[mine] * k
        return pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), tokens, np.int64)), pa.array(sums[1]), pa.array(sums[0])], names=names)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, parts = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                group, kind, blob = (batch.column(k)[i].as_py() for k in range(3))
                if now is not None and group != now:
                    yield close(texts, parts)
                    parts = []
                now = group
                if kind == TEXTS:
                    texts = pickle.loads(blob)
                else:
                    parts.append(blob)
        if now is not None:
            yield close(texts, parts)

    return collect


def _summed(blobs: DataFrame) -> Totals:
    """The sum of all SUMS rows: one for each shard or part."""
    totals = Totals()
    for row in blobs.filter(F.col("kind") == SUMS).select("blob").toLocalIterator():
        totals.add(pickle.loads(row[0]))
    return totals


def _labels(spark: SparkSession, shards: int) -> list[int]:
    """Numbers that Spark deals to different ones of `shards` buckets, so that each shard has a bucket of its own."""
    label = F.col("id").cast("int")
    dealt = spark.range(shards * (20 + shards.bit_length())).groupBy(F.pmod(F.hash(label), F.lit(shards)).alias("bucket")).agg(F.min(label).alias("label"))
    labels = sorted(r["label"] for r in dealt.collect())
    return labels + [shards * 64 + i for i in range(shards - len(labels))]


def language_model(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", tokens_per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """Scores of each whole text: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the texts that `held_out` (by default: crc32 of the id, modulo 10, is 0)
    leaves. Tokens are words, A-Z folded, and one end a text; a null text is empty and
    has the end alone. base_score: log10 of add-0.1 word probabilities; score: log10 of
    the averaged predictive probabilities. Texts of any length are scored whole. Repeated
    rows each count and each get a row. Other columns are not read, whatever their names
    (`held_out` may name any of `docs`). perplexity() sums up.
    """
    spark = docs.sparkSession
    if held_out is None:
        picked = pick(docs, id=id_col, text=text_col).withColumn("held", split_key(F.col("id"), 10) == 0)
    else:
        picked = pick(docs.select("*", F.coalesce(held_out, F.lit(False)).alias(_HELD)), id=id_col, text=text_col, held=_HELD)
    kind = picked.schema["id"].dataType.simpleString()
    often = materialize(picked.mapInArrow(_frequent, "what int, key long, n long").groupBy("what", "key").agg(F.sum("n").alias("n")))
    tokens = often.filter("what = 0").agg(F.sum("n")).first()[0] or 0
    shards = max(4, int(tokens // tokens_per_shard) + 1)
    much = often.filter((F.col("what") > 0) & (F.col("n") > tokens / (4 * shards))).collect()  # fewer than 8 * shards
    words, pairs = (np.sort(np.array([r["key"] for r in much if r["what"] == k], np.int64).view(np.uint64)) for k in (1, 2))
    plan = Plan(_labels(spark, shards), words, pairs)

    name = f"readroute_{uuid.uuid4().hex}"
    dealt = picked.mapInArrow(_deal(plan), _BLOBS).repartitionById(shards, F.col("part")).sortWithinPartitions("part", "batch")
    dealt.mapInArrow(_shards(plan), _BLOBS).write.partitionBy("kind").bucketBy(shards, "shard").option("compression", "zstd").option("path", scratch_path(spark)).saveAsTable(name)
    try:
        table = spark.table(name)
        totals = _summed(table)
        _share_parent(totals, plan)
        words = table.filter(F.col("kind") == WORDS).select(*_COLUMNS)
        totals.add(_summed(materialize(words.mapInArrow(_draw(plan, spark.sparkContext.broadcast(totals)), _BLOBS))))
        for k, of in totals.open_of.items():
            low, high = _span(of)
            totals.held[k] = settle(totals.curve[k] + of[1], low, high) if k in totals.curve else low
        asking = table.filter(F.col("kind") == STATE).select(*_COLUMNS).mapInArrow(_ask(plan, spark.sparkContext.broadcast(totals)), _BLOBS)
        asked = asking.repartitionById(shards, F.col("part")).sortWithinPartitions("part", "shard")
        answers = materialize(asked.mapInArrow(_answer(plan, spark.sparkContext.broadcast(totals)), _BLOBS))
        totals.add(_summed(answers))
        shared = spark.sparkContext.broadcast(totals)
        told = answers.filter(F.col("kind") == ANSWER).repartition(shards, "shard").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("part", "blob"))).alias("answers"))
        state = table.filter(F.col("kind") == STATE).select("shard", "blob").join(told, "shard").select("blob", "answers")
        scores = state.mapInArrow(_score(plan, shared), "batch long, kind int, blob binary")
        texts = table.filter(F.col("kind") == TEXTS).select("batch", F.col("kind").cast("int").alias("kind"), "blob")
        met = scores.unionByName(texts).repartition(2 * shards, "batch").sortWithinPartitions("batch", "kind")  # few groups in a task
        found = met.mapInArrow(_collect(totals.tokens), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return materialize(found.withColumnRenamed("id", id_col))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


_COLUMNS = ["kind", "batch", "shard", "part", "blob"]
_HELD = "readroute held out"


def _share_parent(totals: Totals, plan: Plan) -> None:
    """How many tables the parent is expected to have, and those of the split words, drawn where their sums are: few numbers."""
    keys = sorted(totals.words)
    count, pairs = (np.array([totals.words[k][i] for k in keys], np.int64) for i in (0, 1))
    totals.known += int((count > 0).sum())
    hist = dict(totals.words_of)
    for n in pairs[pairs > 0].tolist():
        hist[n] = hist.get(n, 0) + 1
    totals.expected = expected_tables(hist, totals.known)
    tables = np.zeros(len(keys), np.int64)
    tables[pairs > 0] = word_tables(pairs[pairs > 0], totals.expected, totals.known, [3])
    totals.word_tables = dict(zip(keys, tables.tolist(), strict=True))
    totals.tables += int(tables.sum())


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, tokens, perplexity, base_perplexity) of scored texts."""
    ten = F.lit(10.0)
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("tokens"),
        F.pow(ten, -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(ten, -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"),
    )
