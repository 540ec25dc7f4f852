"""Ranked lexical search: the best documents for each of a set of short queries, exactly.

A document's impact vector has, for each term of the queries that it holds, the whole
number that this term adds to a score, so a score is the sum of the vector's entries at
the query's terms. Each task orders the vectors of a block of its documents by length
and cuts them into buckets (after LEMP, Teflioudi et al., 2015). For a query, the task's
tenth best score so far is the bound to reach:

* by Cauchy-Schwarz a bucket whose longest vector is too short ends the search in the block;
* within a bucket, terms are taken by their largest entry, until the terms left can't reach
  the bound (by their largest entries, or by the length of what is left of the vector). Only
  documents with one of the terms taken are candidates, and each must reach the bound by its
  own entries and the length of the rest;
* survivors are scored again from all their entries, in integers.

Bounds are floating-point numbers rounded up; equal scores are never cut. The best of all
tasks are ranked by a window over ten rows from each task. Two passes read the documents:
one counts, one searches. The queries go through the driver in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readroute.llm.common import NOT_TERM, pick, spread, text_chunks, word_bounds, word_keys

#: Terms of queries that go through the driver, and over the documents, at a time.
QUERY_TERMS = 4_000_000
#: Entries of vectors in a block, and the step from the longest vector of a bucket to its shortest.
BLOCK_ENTRIES, STEP = 4_000_000, 0.8
#: What floating-point bounds are raised by.
UP = 1 + 1e-9


@dataclass
class Queries:
    """Terms by key, and the queries as lists of their places."""

    ids: pa.Array
    keys: np.ndarray  # sorted
    terms: list[np.ndarray]
    weight: np.ndarray | None = None
    docs: int = 0
    total: int = 0


def occurrences(batch: pa.RecordBatch, keys: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, terms in each, and for each (row, query term) that occurs: row, place of the term, times) of chunks of a batch."""
    for rows, data, offsets in text_chunks(batch, "text"):
        starts, ends, bounds = word_bounds(data, offsets, NOT_TERM)
        own = word_keys(data, starts, ends)
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        n = np.diff(bounds)
        pair, times = np.unique(spread(n)[hit] * max(1, len(keys)) + at[hit], return_counts=True)
        yield rows, n, pair // max(1, len(keys)), pair % max(1, len(keys)), times


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, keys of the different terms) of each text."""
    for batch in batches:
        for rows, data, offsets in text_chunks(batch, "text"):
            starts, ends, bounds = word_bounds(data, offsets, NOT_TERM)
            own = word_keys(data, starts, ends).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([np.unique(own[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.int64()))], names=["id", "terms"])


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Queries]:
    """The queries, about QUERY_TERMS of their terms at a time. Rows alike in id are one query with the terms of all."""
    picked = pick(items, id=id_col, text=text_col)
    kind = picked.schema["id"].dataType.simpleString()
    own = picked.mapInArrow(_terms, f"id {kind}, terms array<long>").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter("size(terms) > 0")
    blocks = 1 + (own.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS
    for k in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k) if blocks > 1 else own
        got = part.toArrow().combine_chunks()
        terms = [np.array(x, np.int64).view(np.uint64) for x in got.column("terms").to_pylist()]
        if terms:
            keys = np.unique(np.concatenate(terms))
            yield Queries(pa.concat_arrays(got.column("id").chunks), keys, [np.searchsorted(keys, t) for t in terms])


def counted(docs: DataFrame, queries: Queries) -> Queries:
    """The queries with the weight of each term, from counts over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(queries.keys)
    n_terms = len(queries.keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        df = np.zeros(n_terms + 2, np.int64)  # documents of each term, documents, terms
        for batch in batches:
            for _, n, _, term, _ in occurrences(batch, keys):
                df[:n_terms] += np.bincount(term, minlength=n_terms)
                df[n_terms:] += int((n > 0).sum()), int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    df = np.zeros(n_terms + 2, np.int64)
    got = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    queries.docs, queries.total = map(int, df[n_terms:])
    queries.weight = np.floor(1000 * np.log((2 * queries.docs + 2) / (2 * df[:n_terms] + 1))).astype(np.int64)
    return queries


class Best:
    """The k best (score, id) of one query so far, best first."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 0

    def add(self, scores: np.ndarray, ids: pa.Array, places: np.ndarray) -> None:
        keep = scores >= max(1, self.least)
        if keep.sum() > self.k:  # what the k-th of these leaves
            keep &= scores >= np.partition(scores[keep], -self.k)[-self.k]
        for score, place in zip(scores[keep].tolist(), places[keep].tolist(), strict=True):
            self.rows.append((-score, (x := ids[place].as_py()) is not None, x))
        if keep.any():
            self.rows.sort(key=lambda r: r if r[1] else r[:2])
            del self.rows[self.k :]
            if len(self.rows) == self.k:
                self.least = -self.rows[-1][0]


class Block:
    """Impact vectors of some documents, longest first, with the entries of each term in that order."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        square = np.bincount(doc, impact.astype(np.float64) ** 2, n_docs)
        self.docs = np.argsort(-square, kind="stable")
        self.square = square[self.docs]
        self.length = np.sqrt(self.square) * UP
        place = np.empty(n_docs, np.int64)
        place[self.docs] = np.arange(n_docs)
        at = place[doc]
        order = np.lexsort((at, term))
        self.at, self.impact = at[order], impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        # buckets: from a vector down to STEP times its length; vectors without an entry are in none
        self.buckets, lo, full = [], 0, int(np.searchsorted(-self.square, 0))
        while lo < full:
            hi = int(np.searchsorted(-self.length[:full], -STEP * self.length[lo], "right"))
            self.buckets.append((lo, max(hi, lo + 1)))
            lo = self.buckets[-1][1]

    def entries(self, term: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, impacts) of a term within a bucket."""
        a, b = self.bounds[term], self.bounds[term + 1]
        a, b = a + np.searchsorted(self.at[a:b], (lo, hi))
        return self.at[a:b], self.impact[a:b]

    def search(self, terms: np.ndarray, best: Best, ids: pa.Array) -> None:
        for lo, hi in self.buckets:
            if np.sqrt(len(terms)) * self.length[lo] * UP < best.least:
                return
            lists = [x for x in (self.entries(int(t), lo, hi) for t in terms) if len(x[0])]
            if not lists:
                continue
            most = np.array([x[1].max() for x in lists])
            order = np.argsort(-most, kind="stable")
            left = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what terms from the k-th on add at most
            by_length = np.sqrt(len(lists) - np.arange(len(lists) + 1)) * self.length[lo] * UP
            enough = int(np.argmax(np.minimum(left, by_length) < max(1, best.least)))
            if not enough:
                continue  # not even all terms reach the bound
            taken = [lists[k] for k in order[:enough]]
            at = np.concatenate([x[0] for x in taken]) - lo
            value = np.concatenate([x[1] for x in taken])
            have = np.bincount(at, value.astype(np.float64), hi - lo)
            used = np.bincount(at, value.astype(np.float64) ** 2, hi - lo)
            rest = np.sqrt(np.maximum(self.square[lo:hi] * UP - used, 0) * (len(lists) - enough))
            reach = have * UP + np.minimum(rest * UP, left[enough])
            places = np.flatnonzero((have > 0) & (reach >= best.least))
            scores = np.zeros(len(places), np.int64)
            for own, impact in lists:
                k = np.searchsorted(own, places + lo)
                k[k == len(own)] = 0
                scores += np.where(own[k] == places + lo, impact[k], 0)
            best.add(scores, ids, self.docs[places + lo])


def lexical_search(items: DataFrame, docs: DataFrame, k: int = 10, item_id_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id", text_col: str = "text", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """The `k` best documents of each item: (item id, rank, id, score), from rank 1 on.

    Terms are the runs of characters other than ASCII ones that are no letter or digit,
    A-Z in lower case. An item's terms count once each; rows of one item id are one item with
    the terms of all. A document scores the sum over these terms of w * ((10**9 * tf) div
    (1000 * tf + 8 * m)), with w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 10 + (90 * n * N)
    div L (N: documents with a term, L: their terms, n: the document's). Scores of 0 are not
    returned; equal ones are in the order of ids, null first. Null and empty texts have no
    terms. Repeated ids are documents of their own. Texts of any length count whole; other
    columns are not read, whatever their names.
    """
    picked = pick(docs, id=id_col, text=text_col)
    spark = docs.sparkSession
    item_kind, kind = items.select(item_id_col).schema[0].dataType.simpleString(), picked.schema["id"].dataType.simpleString()
    found = None
    for queries in query_blocks(items, item_id_col, item_text_col):
        held = spark.sparkContext.broadcast(counted(picked, queries))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q: Queries = held.value
            best = [Best(k) for _ in q.terms]
            parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
            n_docs = n_entries = 0

            def run() -> None:
                ids = pa.concat_arrays([p[0] for p in parts])
                block = Block(*(np.concatenate([p[c] for p in parts]) for c in (1, 2, 3)), len(ids), len(q.keys))
                for terms, own in zip(q.terms, best, strict=True):
                    block.search(terms, own, ids)
                parts.clear()

            for batch in batches:
                for rows, n, doc, term, tf in occurrences(batch, q.keys):
                    m = 10 + (90 * n[doc] * q.docs) // max(1, q.total)
                    impact = q.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                    parts.append((rows.column(0), doc + n_docs, term, impact))
                    n_docs, n_entries = n_docs + rows.num_rows, n_entries + len(doc)
                    if n_entries > block_entries:
                        run()
                        n_docs = n_entries = 0
            if parts:
                run()
            rows = [(i, x, -s) for i, b in enumerate(best) for s, _, x in b.rows]
            if rows:
                which, ids, scores = zip(*rows)
                yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(which, pa.int64())), pa.array(ids, batch.schema.field(0).type), pa.array(scores, pa.int64())], names=["item", "id", "score"])

        one = picked.mapInArrow(search, f"item {item_kind}, id {kind}, score long")
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = spark.createDataFrame([], f"item {item_kind}, id {kind}, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(F.col("item").alias(item_id_col), "rank", F.col("id").alias(id_col), "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_FOLDED}, '{_TERM}') AS terms FROM documents WHERE text IS NOT NULL),
t AS (SELECT row, unnest(terms) AS term FROM d), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
v AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * n_docs) // total))) AS impact FROM tf JOIN w USING (term) JOIN d USING (row), c),
s AS (SELECT item_id, row, doc_id, sum(impact)::BIGINT AS score FROM v JOIN q USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""
