"""Gzip read by content, and by many tasks where it is BGZF; lines written as BGZF.

BGZF is gzip of many small members that each say how long they are (the layout of the
SAM specification). So a file is cut into ranges of bytes: a task looks for the first
member that begins in its range, takes all that begin there, and reads on for the rest of
its last line. Other gzip files are one range. Both are Python data sources, so Spark
plans, retries and commits the tasks; files are opened by pyarrow's file systems.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a compressed file that one task reads.
RANGE = 32 << 20
#: Bytes of text in a member, and lines in a batch.
MEMBER, BATCH = 0xFF00, 1 << 15
# The member that ends a BGZF file, and the start of every member.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_MAGIC, _EXTRA = b"\x1f\x8b\x08\x04", b"BC\x02\x00"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def member_size(head: bytes) -> int | None:
    """Bytes of the BGZF member that begins here; None if none does."""
    if head[:4] != _MAGIC or len(head) < 18:
        return None
    end = 12 + struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 4] == _EXTRA and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def is_gzip(path: str) -> bool:
    """Whether a file's content is gzip; False where pyarrow can't open it."""
    try:
        where, name = opened(path)
        with where.open_input_stream(name, compression=None) as f:
            return f.read(2) == b"\x1f\x8b"
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def is_bgzf(path: str) -> bool:
    where, name = opened(path)
    with where.open_input_stream(name, compression=None) as f:
        return member_size(f.read(1 << 12)) is not None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None  # None: to the end, whatever kind of gzip it is
    packed: bool


def first_member(data: bytes, more: bool) -> int | None:
    """Where the first member begins in bytes of the middle of a file: one that is followed by three others, or as many as the file has."""
    at = data.find(_MAGIC)
    while at >= 0:
        here, seen = at, 0
        while seen < 4 and here + 18 <= len(data) and (size := member_size(data[here : here + 512])):
            here, seen = here + size, seen + 1
        if seen == 4 or seen and (here == len(data) and not more):
            return at
        at = data.find(_MAGIC, at + 1)
    return None


def members(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the members from the first that begins in [start, end) on, to the end of the file."""
    where, name = opened(path)
    with where.open_input_file(name) as f:
        size = f.size()
        if start:
            f.seek(start)
            # a member is 64 KiB at most, so five of them show where one begins
            head = f.read(min(size - start, (1 << 16) * 6))
            found = first_member(head, start + len(head) < size)
            if found is None:
                return
            start += found
        held, at = b"", start
        f.seek(start)
        while True:
            if len(held) < 1 << 16:
                held += f.read(1 << 20)
            if not held:
                return
            own = member_size(held[:512])
            if own is None or own > len(held):
                raise ValueError(f"{path}: a broken member at {at}")
            yield at, zlib.decompress(held[:own], 31)
            held, at = held[own:], at + own


def plain(path: str) -> Iterator[bytes]:
    """The text of a gzip file of any kind."""
    where, name = opened(path)
    with where.open_input_stream(name, compression=None) as f:
        machine, held = zlib.decompressobj(31), b""
        while held or (held := f.read(1 << 20)):
            text = machine.decompress(held, 1 << 20)
            held = machine.unconsumed_tail
            if text:
                yield text
            if machine.eof:
                held = machine.unused_data or f.read(1 << 20)
                if held.strip(b"\0"):
                    machine = zlib.decompressobj(31)
                else:
                    return
        if not machine.eof:
            raise ValueError(f"{path}: the gzip data end too soon")


def texts_from(path: str, start: int, end: int | None, packed: bool) -> Iterator[tuple[int, bytes]]:
    """(place, text) of a file from a range's start on, to the end of the file; end None: gzip of any kind, from its start."""
    if end is None:
        yield from ((0, text) for text in plain(path))
    elif packed:
        yield from members(path, start, end)
    else:
        where, name = opened(path)
        with where.open_input_file(name) as f:
            f.seek(start)
            at = start
            # the range ends where a piece does
            while text := f.read(1 << 20 if at >= end else min(1 << 20, end - at)):
                yield at, text
                at += len(text)


def line_lists(part: Range, on: bool = False) -> Iterator[list[bytes]]:
    """Lists of the lines that begin in a range, without their ends: all of the first range's, of others those after its first line break.

    With `on`, also the lines behind the range, to the end of the file.
    """
    held, skip = b"", part.start > 0
    for at, text in texts_from(part.path, part.start, part.end, part.packed):
        if part.end is not None and at >= part.end and (not on or skip):  # the line that goes on behind the range
            cut = text.find(b"\n")
            if cut < 0:
                held += text
                continue
            if not skip:
                yield [held + text[:cut]]
            if not on:
                return
            held, skip, text = b"", False, text[cut + 1 :]
        lines = (held + text).split(b"\n")
        held = lines.pop()
        if skip and lines:
            lines, skip = lines[1:], False
        yield lines
    if held and not skip:
        yield [held]


def range_lines(part: Range) -> Iterator[bytes]:
    return itertools.chain.from_iterable(line_lists(part))


def count_lines(part: Range) -> int:
    """How many lines begin in a range."""
    n, last = int(part.start == 0), b""
    for at, text in texts_from(part.path, part.start, part.end, part.packed):
        if part.end is not None and at >= part.end:
            if text:  # a line break at the end of the range begins a line only if the file goes on
                return n
            continue
        n += text.count(b"\n")
        last = text[-1:] or last
    return n - (last == b"\n") if last else 0


def ranges(path: str, size: int) -> list[Range]:
    """The ranges of a file: plain text and BGZF by bytes, other gzip as a whole."""
    where, name = opened(path)
    n = where.get_file_info(name).size
    packed = is_gzip(path)
    if packed and not is_bgzf(path):
        return [Range(path, 0, None, True)]
    return [Range(path, lo, min(n, lo + size), packed) for lo in range(0, n, size)]


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[Range]:
        return [r for path in self.paths for r in ranges(path, self.size)] or [Range("", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held: list[bytes] = []
        n = 0

        def batch() -> pa.RecordBatch:
            k = len(held)
            rows = [pa.array([partition.path] * k, pa.string()), pa.array([partition.start] * k, pa.int64()), pa.array(range(n, n + k), pa.int64()), pa.array([x.decode("utf-8", "replace") for x in held], pa.string())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=["file", "block", "at", "value"])

        for line in range_lines(partition):
            held.append(line)
            if len(held) == BATCH:
                yield batch()
                n += BATCH
        if held:
            yield batch()


def member(text: bytes) -> bytes:
    """One member of at most 64 KiB."""
    for level in (6, 0):
        machine = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = machine.compress(text) + machine.flush()
        if len(body) + 26 <= 1 << 16:
            break
    return _MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + _EXTRA + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


@dataclass
class _Done(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """One file for each task, under a name of its own until all tasks are done; an empty task leaves none."""

    def __init__(self, folder: str):
        self.folder, self.run = folder.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        from pyspark import TaskContext

        context = TaskContext.get()
        where, top = opened(self.folder)
        name, out, held = None, None, bytearray()
        for batch in iterator:
            for line in batch.column(0):
                held += line.as_py().encode()
                held += b"\n"
                if out is None:
                    name = f"part-{context.partitionId():05d}.{context.taskAttemptId()}.gz"
                    where.create_dir(f"{top}/_{self.run}", recursive=True)
                    out = where.open_output_stream(f"{top}/_{self.run}/{name}", compression=None)
                while len(held) >= MEMBER:
                    out.write(member(bytes(held[:MEMBER])))
                    del held[:MEMBER]
        if out is not None:
            out.write(b"".join([member(bytes(held))] * bool(held)) + END)
            out.close()
        return _Done(name)

    def commit(self, messages: list[_Done | None]) -> None:
        where, top = opened(self.folder)
        where.create_dir(top, recursive=True)
        for m in messages:
            if m is not None and m.name:
                where.move(f"{top}/_{self.run}/{m.name}", f"{top}/{m.name.split('.')[0]}.gz")
        self.abort([])

    def abort(self, messages: list[_Done | None]) -> None:
        where, top = opened(self.folder)
        if where.get_file_info(f"{top}/_{self.run}").type == fs.FileType.Directory:
            where.delete_dir(f"{top}/_{self.run}")


class Gzip(DataSource):
    """Lines of gzip files (option paths, one to a line; range), or lines to BGZF parts below `path`."""

    @classmethod
    def name(cls) -> str:
        return "readroute_gzip"

    def schema(self) -> str:
        return "file string, block long, at long, value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["paths"].split("\n"), int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _Writer(self.options["path"])


def range_size(spark: SparkSession) -> int:
    """Bytes that a task reads: spark.sql.files.maxPartitionBytes, RANGE at most."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return max(1, min(RANGE, int(number) << 10 * " kmgt".index(unit or " ")))


def gzip_lines(spark: SparkSession, paths: list[str], size: int | None = None) -> DataFrame:
    """(file, block, at, value): the lines of gzip files, by ranges where they are BGZF."""
    spark.dataSource.register(Gzip)
    return spark.read.format("readroute_gzip").option("paths", "\n".join(paths)).option("range", str(size or range_size(spark))).load()


def write_lines(lines: DataFrame, folder: str) -> None:
    """The one string column of `lines` as BGZF parts, one for each partition, in the order of partitions; all or nothing."""
    lines.sparkSession.dataSource.register(Gzip)
    lines.write.format("readroute_gzip").mode("append").save(folder)
