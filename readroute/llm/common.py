"""Shared pieces of the text operators: keys of the row split, scratch tables and
array scans over the UTF-8 bytes of whole texts.

A word is a run of bytes other than space and 0x09-0x0D; UTF-8 never uses these
bytes inside another character, so a scan of bytes finds the same words as one of
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.sources.scratch import scratch_path

#: Bytes of text that the array scans handle at once; a longer text is one chunk.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_KEYS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def place(names: list[str], wanted: str) -> int:
    """Where the column `wanted` is: one of exactly that name before one that differs in case."""
    near = [i for i, c in enumerate(names) if c.lower() == wanted.lower()]
    if not near:
        raise ValueError(f"no column {wanted} among {names}")
    return next((i for i in near if names[i] == wanted), near[0])


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with its columns named c0, c1, ... by place, so no name of theirs can clash."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """The chosen columns under new names, whatever the names of the others are."""
    return numbered(docs).select(*[F.col(f"c{place(docs.columns, old)}").alias(new) for new, old in columns.items()])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes that part terms: all of ASCII but letters and digits.
NOT_TERM = np.zeros(256, bool)
NOT_TERM[:128] = True
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def split_key(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared scratch folder and read it back: cuts lineage."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_key(docs: DataFrame) -> DataFrame:
    """`docs` with numbered columns and a 128-bit key (k1, k2) of what is in each row; rows alike share it.

    Nulls count by their place. Columns that can't be hashed (maps) are left out.
    """
    flat = numbered(docs)
    taken = [F.col(f.name) for f in flat.schema.fields if "map<" not in f.dataType.simpleString()]
    content = [*taken, F.concat(*[F.col(c).isNull().cast("string") for c in flat.columns])]
    return flat.withColumns({"k1": F.xxhash64(*content), "k2": F.xxhash64(F.lit(1), *content)})


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys over all bits (in place where possible)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def text_chunks(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows with about `max_bytes` of text.

    Gives (rows, bytes of their texts, offset of each text and the end). Null texts
    are empty. Memory of the scans so follows the chunk, not the Arrow batch.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts):
        return
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, len(texts))
        yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word and, per text, the index of its first word (and the total).

    `gaps` marks the bytes that part words.
    """
    inside = ~gaps[data]
    first = inside.copy()
    gap = ~inside
    first[1:] &= gap[:-1]
    last = inside.copy()
    last[:-1] &= gap[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit key of each word, A-Z lower-cased if `fold`, the same in every task."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[LOWER[data] if fold else data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def bounded_sample(rows: DataFrame, columns: list[str], rate: Column) -> DataFrame:
    """Rows drawn by a hash of the columns, at `rate`, one of each that are alike in them: the same in every run."""
    key = F.xxhash64(F.lit(17), *columns)
    drawn = rows.withColumn("drawn", key).filter(F.pmod("drawn", F.lit(1 << 30)) < rate * (1 << 30))
    return drawn.dropDuplicates(["drawn"]).drop("drawn")


def spread(counts: np.ndarray) -> np.ndarray:
    """The index of each text, repeated for each of its words."""
    return np.repeat(np.arange(len(counts)), counts)


def text_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` between the bounds of each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
