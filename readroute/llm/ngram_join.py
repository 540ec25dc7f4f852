"""N-gram Jaccard self-join: classes of texts whose word-shingle sets are alike.

Two texts link if 100 * |A and B| >= 80 * |A or B|. All links are found:

1. Texts of one set form a class; what follows is about distinct sets.
2. Candidates. Sets are put into size bands so that linked sets are in the same band
   or in neighbours, and differ in at most d(band) shingles. The space of hashes is cut
   into more than d parts, so a linked pair agrees on a whole part; its digest is a key
   that both emit. A set whose shingles fall into d parts or fewer could agree on empty
   parts only, but with another such set alone: these are dealt anew among themselves,
   with other salts, until no set is left.
3. Sets under one key are joined into candidate components, which bound the tiles.
4. Tiles. Within a tile sets are ordered by size; for each the window of possible
   partners is screened by hashed bitmaps, whose bit counts bound the overlap from
   above, and what passes is verified by intersecting sorted arrays. A pair that is
   connected already is not looked at again, so a tile gives a forest, not all pairs.
   A large candidate component is cut into blocks, then representatives of what is
   joined meet in blocks dealt anew, as long as that joins much; at last all that is
   still apart from the largest part meets every block of sets of about its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.llm.common import materialize, mix64, pick, text_chunks, word_bounds, word_keys
from readroute.llm.components import components, local_forest

SHINGLE = 5
#: Most sets, and shingles, of one block of a tile.
BLOCK_SETS, BLOCK_SHINGLES = 1500, 1_500_000
#: Part keys, at most, that one task of the candidate stage sorts.
KEYS_PER_TASK = 1_500_000
#: Sets up to which the candidates are broadcast to the texts; more are joined by id.
BROADCAST_SETS = 200_000
#: Share of representatives that must be left apart for a round of them to be the last.
SETTLED = 0.9
#: Sets under this size take part with three salts at once.
SMALL = 64
_ODD = np.random.default_rng(77).integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands() -> tuple[np.ndarray, np.ndarray]:
    """Least size of each band, and the most shingles in which a linked pair of its smaller set's band differs."""
    least = [4]
    while least[-1] < 1 << 40:
        least.append(int(least[-1] * 1.25) + 1)
    return np.array(least), np.array([(b - 1) // 4 for b in least[1:]])


LEAST, DIFFER = _bands()
PARTS = DIFFER + 1 + np.maximum(8, DIFFER // 5 + 4)


def linked(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """100 * shared >= 80 * union, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle keys of each text in one array, and the bounds of each text."""
    starts, ends, bounds = word_bounds(data, offsets)
    words = word_keys(data, starts, ends)
    if len(words) >= n:
        keys = words[: len(words) - n + 1] * _ODD[0]
        for k in range(1, n):
            keys += words[k : len(words) - n + 1 + k] * _ODD[k]
        keys = mix64(keys)
    else:
        keys = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a >= n:
            own = np.sort(keys[a : b - n + 1])
            if len(own) > 1:
                own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            own = mix64((words[a:b] * _ODD[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.append(0, np.cumsum(sizes))


def set_ids(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for an empty one."""
    sums = np.append(np.uint64(0), np.cumsum(mix64(keys ^ np.uint64(0x5851F42D4C957F2D))))
    size = np.diff(bounds)
    ids = mix64(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64)).view(np.int64)
    return np.where(size > 0, ids, 0)


def part_keys(keys: np.ndarray, bounds: np.ndarray, band: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set index, digest) of the filled parts, and on how many each set agrees with a partner at least.

    Sets of band -1 take no part. Salt 0 cuts by the sorted keys themselves.
    """
    own = np.repeat(np.arange(len(band)), np.diff(bounds))
    take = band[own] >= 0
    own, keys = own[take], keys[take]
    if salt:
        keys = mix64(keys ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        order = np.lexsort((keys, own))
        own, keys = own[order], keys[order]
    parts = PARTS[band[own]].astype(np.uint64)
    part = ((keys >> np.uint64(32)) * parts) >> np.uint64(32)
    if not len(own):
        return own, keys, np.zeros(len(band), np.int64)
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (part[1:] != part[:-1])))
    digest = np.add.reduceat(mix64(keys ^ np.uint64(0xDA942042E4DD58B5)), first)
    owner = own[first]
    digest = mix64(digest + part[first] * np.uint64(0xA0761D6478BD642F) + (band[owner].astype(np.uint64) * np.uint64(64) + np.uint64(salt)) * np.uint64(0xE7037ED1A0B428DB))
    return owner, digest, np.bincount(owner, minlength=len(band)) - DIFFER[band.clip(0)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_chunks(batch, "text"):
            keys, bounds = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(bounds)), pa.array(set_ids(keys, bounds))], names=["id", "h", "n", "sid"])


def _emit(salts: list[int], only: list[int] | None, tasks: int):
    """Blobs of part keys by task (kind 0), what each scheme of a set needs (1), unsafe sets and their bands (2).

    A set is unsafe in a band if it may have a partner with which it agrees on no part. Sets that
    may link to one of SMALL shingles or more meet it with the first salt only. A scheme of a set is a band and a salt, written as salt place * 2 + band parity, as
    a set is in two neighbouring bands only.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, digests, dealt, unsafe, seen, n = [], [], [], [], set(), 0
            for _, data, offsets in text_chunks(batch, "text"):
                keys, bounds = shingle_sets(data, offsets)
                ids, size = set_ids(keys, bounds), np.diff(bounds)
                new = np.array([i not in seen and not seen.add(i) for i in ids.tolist()])  # one of each set
                upper = np.searchsorted(LEAST, size, "right") - 1
                for band in (upper, upper - 1):
                    band = np.where(new & (band >= 0), band, -1)
                    if only is not None:
                        band = np.where(np.isin(band, only), band, -1)
                    safe = np.zeros(len(band), bool)
                    for place, salt in enumerate(salts):
                        own_band = np.where(size < SMALL, band, -1) if place else band
                        owner, digest, need = part_keys(keys, bounds, own_band, salt)
                        takes = own_band >= 0
                        safe |= takes & (need > 0) & ((size * 5 // 4 < SMALL) | (place == 0))
                        entries.append((ids[takes], own_band[takes] % 2 + 2 * place, np.maximum(need[takes], 1)))
                        dealt.append((n + np.cumsum(takes) - 1)[owner])
                        digests.append(digest)
                        n += int(takes.sum())
                    left = ~safe & (band >= 0)
                    unsafe.append((ids[left], band[left]))
            left = [np.concatenate([u[k] for u in unsafe]) if unsafe else np.zeros(0, np.int64) for k in range(2)]
            out = [(2, int(left[0][0]) % tasks, _pack(left[0], np.zeros(0, np.uint32), left[1].astype(np.uint8)))] if len(left[0]) else []
            if n:
                sid, scheme, need = (np.concatenate([e[k] for e in entries]) for k in range(3))
                entry, digest = np.concatenate(dealt).astype(np.uint32), np.concatenate(digests)
                to = ((digest >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(to, kind="stable")  # keys of an entry stay together
                cut = np.searchsorted(to[order], np.arange(tasks + 1))
                out.append((1, int(sid[0]) % tasks, _pack(sid, need.astype(np.uint32), scheme.astype(np.uint8))))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    at = order[cut[k] : cut[k + 1]]
                    own = entry[at]
                    first = np.append(True, own[1:] != own[:-1])
                    run = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                    first = np.flatnonzero(run % 31 == 0)  # a count takes five bits
                    count = np.diff(np.append(first, len(at)))
                    code = (scheme[own[first]] << 5 | count).astype(np.uint8)
                    out.append((0, k, _pack(sid[own[first]], digest[at].astype(np.uint32), code)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["kind", "task", "blob"])

    return emit


def _pack(longs: np.ndarray, ints: np.ndarray, bytes_: np.ndarray) -> bytes:
    return np.array([len(longs), len(ints), len(bytes_)], np.int64).tobytes() + longs.tobytes() + ints.tobytes() + bytes_.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, k = np.frombuffer(blob, np.int64, 3).tolist()
    return np.frombuffer(blob, np.int64, n, 24), np.frombuffer(blob, np.uint32, m, 24 + 8 * n), np.frombuffer(blob, np.uint8, k, 24 + 8 * n + 4 * m)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, scheme, token, holders, null) of the keys that several sets of a task have; (sid, scheme, null,
    null, need); and (sid, band, null, null, 0) of unsafe sets."""

    def out(sid, scheme, token=None, holders=None, need=None) -> pa.RecordBatch:
        n = len(scheme)
        columns = [pa.nulls(n, kind) if x is None else pa.array(x).cast(kind) for x, kind in ((sid, pa.int64()), (scheme, pa.int32()), (token, pa.int64()), (holders, pa.int32()), (need, pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["sid", "scheme", "token", "holders", "need"])

    sids, schemes, tokens = [], [], []
    for batch in batches:
        for kind, task, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sid, ints, code = _unpack(blob)
            if kind == 2:
                yield out(sid, code, need=np.zeros(len(sid)))
                continue
            if kind == 1:
                yield out(sid, code, need=ints)
                continue
            count = code & 31
            sids.append(np.repeat(sid, count))
            schemes.append(np.repeat(code >> 5, count))
            tokens.append(ints.astype(np.int64) | task << 32)
    if not tokens:
        return
    sid, scheme, token = np.concatenate(sids), np.concatenate(schemes), np.concatenate(tokens)
    del sids, schemes, tokens
    order = np.lexsort((sid, token))
    # one row of each set under a key, then keys with several sets
    order = order[np.append(True, (token[order][1:] != token[order][:-1]) | (sid[order][1:] != sid[order][:-1]))]
    same = token[order][1:] == token[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    if not len(order):
        return
    first = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1]))
    runs = np.diff(np.append(first, len(order)))
    holders = np.repeat(runs, runs)
    for lo in range(0, len(order), 1 << 17):
        at = order[lo : lo + (1 << 17)]
        yield out(sid[at], scheme[at], token[at], holders[lo : lo + (1 << 17)])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): joins the sets under one token of the partition."""
    rows = [(np.array(b.column(0)), np.array(b.column(1))) for b in batches]
    if not rows:
        return
    token, sid = (np.concatenate([r[k] for r in rows]) for k in range(2))
    order = np.argsort(token)
    token, sid = token[order], sid[order]
    same = (token[1:] == token[:-1]) & (sid[1:] != sid[:-1])
    node, root = local_forest(sid[1:][same], sid[:-1][same])
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])


def key_tasks(sizes: DataFrame, only: list[int] | None = None) -> int:
    """Tasks for the part keys of the sets (n), or of those in the bands `only`: an upper bound by KEYS_PER_TASK.

    A set of n shingles is in a band that differs in 5n/16 at most and in one of n/4, and has
    a key for each part that it fills. Small sets so have several keys a shingle, large ones 0.6.
    """
    n = F.col("n")
    filled = [F.least(n, differ + 1 + F.greatest(F.lit(8), differ / 5 + 4)) for differ in (n * 5 / 16, n / 4)]
    if only is not None:
        sizes = sizes.filter(reduce(Column.__or__, [n.between(int(LEAST[b]), int(LEAST[b + 2]) - 1) for b in only]))
    keys = sizes.agg(F.sum((filled[0] + filled[1]) * F.when(n < SMALL, 3).otherwise(1))).first()[0] or 0
    return max(4, math.ceil(keys / KEYS_PER_TASK))


def candidate_edges(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(u, v) between ids of sets: a forest over everything that may link; sizes: (id, h, n, sid) of each text (id, text, h)."""
    salts, only, out = [0, 1, 2], None, None
    while True:
        tasks = key_tasks(sizes, only)
        blobs = texts.select("text").mapInArrow(_emit(salts, only, tasks), "kind int, task int, blob binary")
        found = materialize(blobs.repartitionById(tasks, F.col("task")).mapInArrow(_match, "sid long, scheme int, token long, holders int, need int"))
        held = F.collect_list(F.when(F.col("token").isNotNull(), F.struct("holders", "token")))
        schemes = found.filter("need is null or need > 0").groupBy("sid", "scheme").agg(held.alias("held"), F.max("need").alias("need"))
        # two sets that agree on `need` keys at least agree on one of the others and their rarest: the rest join no one
        rare = F.slice(F.array_sort("held"), F.lit(1), F.size("held") - F.col("need") + 1)
        alive = schemes.filter(F.size("held") >= F.col("need")).select(F.explode(F.transform(rare, lambda x: x["token"])).alias("token"), "sid")
        edges = alive.repartitionById(tasks, F.shiftright("token", 32).cast("int")).mapInArrow(_forest, "u long, v long")
        out = edges if out is None else out.unionAll(edges)
        unsafe = found.filter("need = 0")
        only = [r[0] for r in unsafe.select("scheme").distinct().collect()]  # bands: under 120
        if not only:
            return out
        # what is unsafe can miss such sets only, so no others are dealt anew: a text of each
        sizes = materialize(sizes.join(unsafe.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.min(F.struct("id", "h")).alias("rep")).select("rep.id", "rep.h", "n", "sid"))
        few = sizes.select(F.col("id").alias("rep_id"), F.col("h").alias("rep_h"))
        few = F.broadcast(few) if sizes.count() <= BROADCAST_SETS else few
        texts = materialize(texts.join(few, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("h") == F.col("rep_h")), "left_semi"))
        salts = [salts[-1] + k for k in (1, 2, 3)]


class Bitmaps:
    """Hashed bitmaps of sets, wide enough for the largest."""

    def __init__(self, sets: list[np.ndarray]):
        bits = 64
        while bits < 2 * max(map(len, sets)) and bits < 1 << 15:
            bits *= 2
        flags = np.zeros((len(sets), bits), bool)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flags[rows, (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)] = True
        self.words = np.packbits(flags, axis=1).view(np.uint64)
        self.ones = np.bitwise_count(self.words).sum(1, dtype=np.int64)

    def most_shared(self, i: int, lo: int, hi: int, size: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlap of set i with sets lo..hi."""
        both = np.bitwise_count(self.words[i] & self.words[lo:hi]).sum(1, dtype=np.int64)
        return np.minimum(size[i] - (self.ones[i] - both), size[lo:hi] - (self.ones[lo:hi] - both))


def tile_links(sets: list[np.ndarray], label: np.ndarray, query: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what `label` has apart; with `query`, of pairs with such a set only."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sets, size, label = [sets[i] for i in order], size[order], label[order].copy()
    asked = None if query is None else query[order]
    if len(sets) < 2 or (label == label[0]).all():
        return []
    maps, out = Bitmaps(sets), []
    for i in range(len(sets) - 1):
        hi = int(np.searchsorted(size, size[i] * 5 // 4, "right"))
        open_ = label[i + 1 : hi] != label[i]
        if asked is not None and not asked[i]:
            open_ &= asked[i + 1 : hi]
        if not open_.any():
            continue
        most = maps.most_shared(i, i + 1, hi, size)
        may = np.flatnonzero(open_ & linked(most, size[i], size[i + 1 : hi]))
        for j in (may[np.argsort(-most[may], kind="stable")] + i + 1).tolist():
            if label[j] == label[i]:
                continue
            a, b = sets[i], sets[j]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            if linked(int((b[at] == a).sum()), size[i], size[j]):
                out.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows of one tile: (tile, sid, label, query, text), sorted by tile."""
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        distinct = {}
        for _, sid, label, query, text in held:
            keys = distinct[sid][2] if sid in distinct else keys_of(text)
            distinct[sid] = (label, query or distinct.get(sid, (0, False))[1], keys)
        sids = np.array(list(distinct), np.int64)
        label = np.array([x[0] for x in distinct.values()], np.int64)
        query = np.array([x[1] for x in distinct.values()], bool)
        links = tile_links([x[2] for x in distinct.values()], label, None if query.all() else query)
        u, v = [a for a, _ in links], [b for _, b in links]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(sids[u]), pa.array(sids[v])], names=["u", "v"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[-1][0]:
                yield close()
            held.append(row)
    if held:
        yield close()


def keys_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]))[0]


def tile_edges(rows: DataFrame) -> DataFrame:
    """(u, v) links of (tile, sid, label, query, text) rows."""
    dealt = rows.select("tile", "sid", "label", "query", "text").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_tiles, "u long, v long")


def _block(of: Column, blocks: Column, salt: int = 5) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), of), blocks)


def _blocks() -> Column:
    """Blocks that the sets of a group need."""
    return F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES))


def set_links(texts: DataFrame, sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v) verified links that join every pair of linked sets; sets: (sid, n, rep), rep: id and text hash of one row."""
    member = materialize(components(edges).select(F.col("node").alias("sid"), F.col("component").alias("comp")).join(sets, "sid"))
    chosen = member.select("rep", "sid", "comp", "n")
    chosen = F.broadcast(chosen) if member.count() <= BROADCAST_SETS else chosen
    same = F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("h") == F.col("rep.h"))
    held = materialize(texts.join(chosen, same).select("sid", "comp", "n", "text").dropDuplicates(["sid"]))
    many = materialize(member.groupBy("comp").agg(_blocks().alias("blocks")).filter("blocks > 1"))
    large = many.count() > 0
    own = held.join(many, "comp", "left") if large else held.withColumn("blocks", F.lit(None).cast("long"))
    tile = F.xxhash64("comp", F.when(F.col("blocks").isNotNull(), _block(F.col("sid"), F.col("blocks"))).otherwise(0))
    links = materialize(tile_edges(own.select(tile.alias("tile"), "sid", F.col("sid").alias("label"), F.lit(True).alias("query"), "text")))
    if not large:
        return links
    big = materialize(held.join(many.select("comp"), "comp"))  # what has more than one block
    apart, salt = None, 5
    while True:  # representatives of what is joined meet in fewer blocks, dealt anew each time
        heads = _labelled(big, links).filter("sid = label")
        before, apart, salt = apart, heads.count(), salt + 1
        if before is not None and apart > SETTLED * before:
            break
        shape = heads.groupBy("comp").agg(_blocks().alias("parts"))
        heads = heads.join(shape, "comp").select(F.xxhash64("comp", _block(F.col("sid"), F.col("parts"), salt)).alias("tile"), "sid", "label", F.lit(True).alias("query"), "text")
        links = materialize(links.unionAll(tile_edges(heads)))
    # linked sets are of one size band or of neighbours: what is apart from the largest part meets these only
    now = materialize(_labelled(big, links).withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25)))))
    main = now.groupBy("comp", "label").agg(F.count("*").alias("k")).groupBy("comp").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    rest = now.join(main, "comp").filter("label <> main")
    near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))
    blocks = now.groupBy("comp", "band").agg(_blocks().alias("blocks"))
    asked = rest.groupBy("comp", "band").agg(_blocks().alias("asks"))
    ask = rest.join(asked, ["comp", "band"]).withColumn("ask", _block(F.col("sid"), F.col("asks"))).withColumn("met", near)
    ask = ask.join(blocks.withColumnRenamed("band", "met"), ["comp", "met"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = now.join(blocks, ["comp", "band"]).withColumn("block", _block(F.col("sid"), F.col("blocks"))).withColumnRenamed("band", "met").withColumn("band", F.explode(F.sequence(F.col("met") - 1, F.col("met") + 1)))
    meet = meet.join(asked, ["comp", "band"]).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)))
    both = ask.withColumn("query", F.lit(True)), meet.withColumn("query", F.lit(False))
    tile = F.xxhash64("comp", "band", "ask", "met", "block").alias("tile")
    across = both[0].select(tile, "sid", "label", "query", "text").unionByName(both[1].select(tile, "sid", "label", "query", "text"))
    return links.unionAll(tile_edges(across))


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """`sets` with the least set of what each is joined to as its label."""
    found = components(links).select(F.col("node").alias("sid"), F.col("component").alias("label"))
    return sets.drop("label").join(found, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each whole text.

    n_shingles: size of its set of distinct five-word shingles, A-Z folded; a text of
    fewer words is one shingle, one without words has none and is its own component.
    component_id: least id reachable by links, itself included; a null id is never the
    least unless all are null. Rows of one id are each joined by their own text. Texts of
    any length are read whole; other columns are not read, whatever their names.
    Ids are whole numbers, or texts of such; others fail. Shingles and sets are told apart by 64-bit hashes.
    """
    picked = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("h"))
    sized = materialize(picked.mapInArrow(_sets, "id long, h long, n long, sid long").hint("rebalance"))  # small rows: few files
    full = sized.filter("n > 0")
    sets = full.groupBy("sid").agg(F.first("n").alias("n"), F.min("id").alias("low"), F.min(F.struct("id", "h")).alias("rep"))
    edges = candidate_edges(picked, full)
    joined = components(set_links(picked, sets.drop("low"), edges)).select(F.col("node").alias("sid"), "component")
    least = sets.join(joined, "sid", "left").select("sid", F.coalesce("component", "sid").alias("component"), "low")
    lowest = least.join(least.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("sid", "component_id")
    found = sized.join(lowest, "sid", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\x0c\r]+') AS words FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS s FROM w
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM shared s JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * s.n >= 80 * (a.n + b.n - s.n)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, v FROM reach JOIN links ON r = u
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""
