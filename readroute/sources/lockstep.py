"""FASTQ files read in step, without a shuffle of reads.

One job counts the lines that begin in each range of bytes of each file. From the sums
before each range it is known where a record of a file is, so every task reads the same
records of all files (or neighbouring mates of one): it opens each file at the last range
that begins before them and skips the lines up to them. Plain text and BGZF can be read
so; a gzip file of another kind has one range only, and such files are joined instead.
"""

from __future__ import annotations

import bisect
import itertools
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readroute.sources.bgzf import Range, count_lines, line_lists, range_size, ranges

_PARTS = ("head", "bases", "plus", "quals")
RECORD = "struct<" + ",".join(f"{p}:string" for p in _PARTS) + ">"
#: Fragments in a batch.
BATCH = 1 << 13


@dataclass
class Counted(InputPartition):
    stream: int
    place: int
    part: Range


class _Counts(DataSourceReader):
    def __init__(self, streams: list[list[str]], size: int):
        self.streams, self.size = streams, size

    def partitions(self) -> list[Counted]:
        return [Counted(k, n, r) for k, files in enumerate(self.streams) for n, r in enumerate(r for f in files for r in ranges(f, self.size))]

    def read(self, partition: Counted | None) -> Iterator[tuple]:
        if partition is None:  # files without a byte have no range
            return
        yield partition.stream, partition.place, partition.part.path, partition.part.start, partition.part.end, partition.part.packed, count_lines(partition.part)


class LineCounts(DataSource):
    """(stream, place, path, start, end, packed, n): the lines that begin in each range of the files of each stream."""

    @classmethod
    def name(cls) -> str:
        return "readroute_line_counts"

    def schema(self) -> str:
        return "stream int, place int, path string, start long, end long, packed boolean, n long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Counts([s.split("\n") for s in self.options["streams"].split("\n\n")], int(self.options["range"]))


@dataclass
class Stretch(InputPartition):
    """The fragments [first, last) (None: to the end), and for each stream the ranges to read on from and the lines to skip."""

    first: int
    last: int | None
    sources: list[tuple[list[Range], int]]


def stretch_lines(parts: list[Range]) -> Iterator[bytes]:
    """The lines from the first of some ranges on: the rest of its file, then the files after it."""
    return itertools.chain.from_iterable(own for part in parts for own in line_lists(part, on=True))


class _Stretches(DataSourceReader):
    def __init__(self, stretches: list[Stretch], per: int):
        self.stretches, self.per = stretches, per

    def partitions(self) -> list[Stretch]:
        return self.stretches

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        lines = [itertools.islice(stretch_lines(parts), skip, None) for parts, skip in partition.sources]
        first, step = partition.first, 4 * self.per
        while partition.last is None or first < partition.last:
            n = BATCH if partition.last is None else min(BATCH, partition.last - first)
            got = [records([*itertools.islice(x, n * step)], self.per) for x in lines]
            most = max(len(g[0]) for g in got)
            if not most:
                return
            columns = []
            for own in got:
                for k in range(self.per):
                    columns.append(pa.StructArray.from_arrays([pad(own[4 * k + c], most) for c in range(4)], names=list(_PARTS)))
            ids = pa.array(range(first, first + most), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["fid", *[f"r{k}" for k in range(len(columns))]])
            first += most


def records(lines: list[bytes], per: int) -> list[list[bytes | None]]:
    """Columns head, bases, plus, quals of each of the `per` records of a fragment; blank lines at the end don't count."""
    while lines and not lines[-1].strip(b"\r"):
        lines.pop()
    if len(lines) % 4:  # qualities of an empty read
        lines += [b""] * (4 - len(lines) % 4)
    if any(x.endswith(b"\r") for x in lines[:1]):
        lines = [x.removesuffix(b"\r") for x in lines]
    step = 4 * per
    out = [lines[k::step] for k in range(step)]
    return [x + [None] * (len(out[0]) - len(x)) for x in out]


def pad(texts: list[bytes | None], n: int) -> pa.Array:
    texts = texts + [None] * (n - len(texts))
    try:
        return pa.array(texts, pa.string())
    except (pa.ArrowInvalid, UnicodeDecodeError):
        return pa.array([x and x.decode("utf-8", "replace") for x in texts], pa.string())


def stretches(counts: list[tuple], n_streams: int, per: int) -> list[Stretch]:
    """The tasks: as many as the first stream has ranges, each with the same fragments of all streams."""
    parts: list[list[Range]] = [[] for _ in range(n_streams)]
    offsets: list[list[int]] = [[] for _ in range(n_streams)]
    total = [0] * n_streams
    for stream, _, path, start, end, packed, n in sorted(counts, key=lambda c: c[:2]):
        parts[stream].append(Range(path, start, end, packed))
        offsets[stream].append(total[stream])
        total[stream] += n
    if not any(total):
        return []
    longest = max(range(n_streams), key=lambda k: len(parts[k]))
    step = 4 * per
    cuts = sorted({-(-o // step) for o in offsets[longest]} | {0})
    out = []
    for first, last in itertools.zip_longest(cuts, cuts[1:]):
        sources = []
        for own, before in zip(parts, offsets, strict=True):
            k = max(0, bisect.bisect_right(before, first * step) - 1)
            to = len(own) if last is None else bisect.bisect_left(before, last * step)
            # after the first range only those are needed at which a file begins
            sources.append(([r for i, r in enumerate(own[k : max(k + 1, to)]) if i == 0 or r.start == 0], first * step - (before[k] if before else 0)))
        out.append(Stretch(first, last, sources))
    return out


class Lockstep(DataSource):
    """(fid, r0, r1, ...): records of several streams in step, or `per` neighbours of one."""

    @classmethod
    def name(cls) -> str:
        return "readroute_lockstep"

    def schema(self) -> str:
        return "fid long, " + ", ".join(f"r{k} {RECORD}" for k in range(int(self.options["columns"])))

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Stretches(pickle.loads(bytes.fromhex(self.options["stretches"])), int(self.options["per"]))


def fits(streams: Sequence[Sequence[str]], size: int) -> bool:
    """Whether every file can be opened by pyarrow and read in ranges."""
    try:
        return all(r.end is not None for s in streams for f in s for r in ranges(f, size)[:1])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def lockstep(spark: SparkSession, streams: Sequence[Sequence[str]], per: int = 1, size: int | None = None) -> DataFrame | None:
    """(fid, r0, r1, ...) of FASTQ files in step: each stream is the files of one input in order. None if they can't be read so.

    A record that one stream has and another lacks is null there.
    """
    size = size or range_size(spark)
    if not fits(streams, size):
        return None
    for source in (LineCounts, Lockstep):
        spark.dataSource.register(source)
    counts = spark.read.format("readroute_line_counts").option("streams", "\n\n".join("\n".join(s) for s in streams)).option("range", str(size)).load().collect()  # a row for each range
    tasks = stretches([tuple(c) for c in counts], len(streams), per)
    if not tasks:
        tasks = [Stretch(0, 0, [([], 0) for _ in streams])]
    return spark.read.format("readroute_lockstep").option("columns", str(len(streams) * per)).option("per", str(per)).option("stretches", pickle.dumps(tasks).hex()).load()
