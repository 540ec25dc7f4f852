"""BAM: unaligned and aligned records read by many tasks, unaligned ones written.

A BAM file is BGZF, so it is cut into ranges of members. A task reads the records that begin
in its range; where the first of them begins is found by looking for a place from which
records follow each other whose fields fit together. Records are laid out as the SAM
specification says. Each written part is a BAM file of its own, with its destination's header.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType

from readroute.functions.seq import TAG
from readroute.sources.bgzf import END, MEMBER, Range, member, members, opened, range_size, ranges

_HEAD = struct.Struct("<iiBBHHHiiii")
# The 16 base codes, and the types of whole numbers with their layout.
_BASES = "=ACMGRSVTWYHKDBN"
_TO_HEX = {ord(b.lower()): format(k, "x") for k, b in enumerate(_BASES)} | {ord(b): format(k, "x") for k, b in enumerate(_BASES)} | {ord("U"): "8", ord("u"): "8"}
_FROM_HEX = {ord(format(k, "x")): b for k, b in enumerate(_BASES)}
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_UP, _DOWN = bytes(min(255, x + 33) for x in range(256)), bytes(max(0, x - 33) for x in range(256))
#: Records that must follow each other where the first one is looked for.
CHAIN = 8
#: Bytes of the largest record that is looked for, and of text from which two records that follow each other are enough.
LARGEST, PLENTY = 1 << 27, 1 << 20
BATCH = 1 << 13


def read_header(stream: Iterator[bytes]) -> tuple[int, int]:
    """(bytes of the header, reference sequences) from the start of a file."""
    data = b""

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            more = next(stream, None)
            if more is None:
                raise ValueError("the BAM header is cut")
            data += more

    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    n_ref = struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(n_ref):
        need(at + 4)
        size = struct.unpack_from("<i", data, at)[0]
        at += 8 + size
        need(at)
    return at, n_ref


def plausible(data: bytes, at: int, n_ref: int) -> int | None:
    """Where the record that begins at `at` ends, if its fields fit together."""
    if at + 36 > len(data):
        return None
    block, ref, pos, name, _, _, cigar, _, bases, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not 32 <= block <= LARGEST or not name or not -1 <= ref < n_ref or not -1 <= mate < n_ref or pos < -1 or mate_pos < -1 or bases < 0:
        return None
    if 32 + name + 4 * cigar + (bases + 1) // 2 + bases > block:
        return None
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] or not all(33 <= x <= 126 for x in text[:-1])):
        return None
    return at + 4 + block


def first_record(data: bytes, n_ref: int, more: bool) -> int | None:
    """Where the first record begins in text from the middle of a file; None if that takes more of it."""
    for at in range(len(data)):
        here, n = at, 0
        while n < CHAIN and (after := plausible(data, here, n_ref)) is not None:
            here, n = after, n + 1
        if n == CHAIN or n and not more and here == len(data):
            return at
        if n and more and here + 36 > len(data):  # it may be, but its followers aren't there yet
            return at if n > 1 and len(data) > PLENTY else None
    return None


def record_bytes(part: Range, n_ref: int) -> Iterator[bytes]:
    """The records that begin in a range, without their sizes."""
    stream = members(part.path, part.start, part.end)
    data, at, base, limit, more = b"", 0, 0, None, True

    def pull() -> bool:
        nonlocal data, at, base, limit, more
        found = next(stream, None)
        if found is None:
            more = False
            return False
        place, text = found
        base, data, at = base + at, data[at:] + text, 0
        if limit is None and place >= part.end:
            limit = base + len(data) - len(text)
        return True

    if part.start == 0:
        size, _ = read_header(text for _, text in members(part.path, 0, part.end))
        while len(data) < size and pull():
            pass
        at = size
    else:
        found = None
        while found is None and pull():
            if limit == 0:
                return
            found = first_record(data, n_ref, True)
            if found is None and limit is not None and len(data) > 2 * LARGEST:
                raise ValueError(f"{part.path}: no record is found from {part.start} on")
        if found is None:
            found = first_record(data, n_ref, False)
        if found is None:
            return
        at = found
    while True:
        while at + 4 > len(data) and pull():
            pass
        if limit is not None and base + at >= limit or at == len(data):
            return
        size = struct.unpack_from("<i", data, at)[0]
        while at + 4 + size > len(data):
            if not pull():
                raise ValueError(f"{part.path}: the last record is cut")
        yield data[at + 4 : at + 4 + size]
        at += 4 + size


def _tags(data: bytes, at: int) -> list[dict[str, str]]:
    out = []
    while at < len(data):
        tag, kind = data[at : at + 2].decode("ascii", "replace"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode("utf-8", "replace"), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            own = chr(data[at])
            n = struct.unpack_from("<i", data, at + 1)[0]
            layout = struct.Struct(f"<{n}{_NUMBERS[own]}")
            value, at = ",".join([own, *(format(x, "g") if own == "f" else str(x) for x in layout.unpack_from(data, at + 5))]), at + 5 + layout.size
        else:
            layout = struct.Struct(f"<{_NUMBERS[kind]}")
            (x,) = layout.unpack_from(data, at)
            value, at = (format(x, "g") if kind == "f" else str(x)), at + layout.size
            kind = kind if kind == "f" else "i"
        out.append({"tag": tag, "type": kind, "value": value})
    return out


def decode(record: bytes) -> tuple[str, int, str, str | None, list[dict[str, str]]]:
    """(name, flag, bases, qualities, tags)."""
    _, _, name, _, _, cigar, flag, bases, *_ = _HEAD.unpack_from(record)
    at = 32 + name
    text = record[32 : at - 1].decode("ascii", "replace")
    at += 4 * cigar
    half = (bases + 1) // 2
    seq = record[at : at + half].hex().translate(_FROM_HEX)[:bases]
    at += half
    quals = record[at : at + bases]
    return text, flag, seq, None if quals[:1] in (b"\xff", b"") else quals.translate(_UP).decode("latin-1"), _tags(record, at + bases)


def encode(name: str, flag: int, bases: str, quals: str | None, tags: Sequence[Mapping[str, str]]) -> bytes:
    """An unaligned record with its size."""
    shown = name.encode()[:254] + b"\0"
    nibbles = bases.translate(_TO_HEX)
    if len(nibbles) == len(bases) and nibbles.strip("0123456789abcdef"):
        nibbles = "".join(x if x in "0123456789abcdef" else "f" for x in nibbles)
    made = [shown, bytes.fromhex(nibbles + "0" * (len(nibbles) % 2)), quals.encode("latin-1").translate(_DOWN) if quals else b"\xff" * len(bases)]
    for t in tags:
        kind, value = t["type"], t["value"]
        head = t["tag"].encode()
        if kind in "cCsSiI":
            made.append(head + (b"i" if -(1 << 31) <= int(value) < 1 << 31 else b"I") + (struct.pack("<i", int(value)) if -(1 << 31) <= int(value) < 1 << 31 else struct.pack("<I", int(value))))
        elif kind == "f":
            made.append(head + b"f" + struct.pack("<f", float(value)))
        elif kind == "A":
            made.append(head + b"A" + value.encode()[:1])
        elif kind == "B":
            own, *numbers = value.split(",")
            made.append(head + b"B" + own.encode() + struct.pack(f"<i{len(numbers)}{_NUMBERS[own]}", len(numbers), *(float(x) if own == "f" else int(x) for x in numbers)))
        else:
            made.append(head + kind.encode() + value.encode() + b"\0")
    body = _HEAD.pack(-1, -1, len(shown), 0, 4680, 0, flag, len(bases), -1, -1, 0) + b"".join(made)
    return struct.pack("<i", len(body)) + body


def header_bytes(lines: Iterable[str]) -> bytes:
    text = "".join(x + "\n" for x in lines).encode()
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 0)


def empty_file(lines: Iterable[str]) -> bytes:
    """A BAM file without records."""
    head = header_bytes(lines)
    return b"".join(member(head[k : k + MEMBER]) for k in range(0, len(head), MEMBER)) + END


@dataclass
class BamRange(InputPartition):
    part: Range
    n_ref: int


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[BamRange]:
        out = []
        for path in self.paths:
            parts = ranges(path, self.size)
            n_ref = read_header(text for _, text in members(path, 0, 1))[1] if parts else 0
            out += [BamRange(r, n_ref) for r in parts]
        return out

    def read(self, partition: BamRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # files without a byte have no range
            return
        rows: list[tuple] = []
        n = 0
        tags = pa.list_(pa.struct([(c, pa.string()) for c in ("tag", "type", "value")]))

        def batch() -> pa.RecordBatch:
            k = len(rows)
            columns = [pa.array([partition.part.path] * k, pa.string()), pa.array([partition.part.start] * k, pa.int64()), pa.array(range(n, n + k), pa.int64())]
            columns += [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), tags))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "at", "name", "flag", "bases", "quals", "tags"])

        for record in record_bytes(partition.part, partition.n_ref):
            rows.append(decode(record))
            if len(rows) == BATCH:
                yield batch()
                n += BATCH
        if rows:
            yield batch()


@dataclass
class _Parts(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Rows (dest, record) in the order of destinations: a file for each in each task, moved to its place when all tasks are done."""

    def __init__(self, folder: str, headers: dict[str, list[str]], folders: dict[str, str]):
        self.folder, self.headers, self.folders, self.run = folder.rstrip("/"), headers, folders, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Parts:
        context = TaskContext.get()
        where, top = opened(self.folder)
        names: list[str] = []
        now, out, held = None, None, bytearray()

        def end() -> None:
            if out is not None:
                out.write(b"".join([member(bytes(held))] * bool(held)) + END)
                out.close()
                held.clear()

        for batch in iterator:
            for dest, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if dest != now:
                    end()
                    now = dest
                    names.append(f"{self.folders[dest]}/part-{context.partitionId():05d}.{context.taskAttemptId()}.bam")
                    where.create_dir(f"{top}/_{self.run}/{self.folders[dest]}", recursive=True)
                    out = where.open_output_stream(f"{top}/_{self.run}/{names[-1]}", compression=None)
                    held += header_bytes(self.headers[dest])
                held += record
                while len(held) >= MEMBER:
                    out.write(member(bytes(held[:MEMBER])))
                    del held[:MEMBER]
        end()
        return _Parts(names)

    def commit(self, messages: list[_Parts | None]) -> None:
        where, top = opened(self.folder)
        for name in [n for m in messages if m is not None for n in m.names]:
            where.create_dir(f"{top}/{name.rsplit('/', 1)[0]}", recursive=True)
            where.move(f"{top}/_{self.run}/{name}", f"{top}/{name.rsplit('.', 2)[0]}.bam")
        self.abort([])

    def abort(self, messages: list[_Parts | None]) -> None:
        where, top = opened(self.folder)
        if where.get_file_info(f"{top}/_{self.run}").type == fs.FileType.Directory:
            where.delete_dir(f"{top}/_{self.run}")


class Bam(DataSource):
    """Records of BAM files (options paths, range), or records to parts by destination below `path`."""

    @classmethod
    def name(cls) -> str:
        return "readroute_bam"

    def schema(self) -> str:
        return f"file string, block long, at long, name string, flag int, bases string, quals string, tags array<{TAG}>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["paths"].split("\n"), int(self.options["range"]))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        import json

        return _Writer(self.options["path"], json.loads(self.options["headers"]), json.loads(self.options["folders"]))


def records(spark: SparkSession, paths: list[str], size: int | None = None) -> DataFrame:
    """(file, block, at, name, flag, bases, quals, tags) of BAM files, by ranges."""
    spark.dataSource.register(Bam)
    return spark.read.format("readroute_bam").option("paths", "\n".join(paths)).option("range", str(size or range_size(spark))).load()


@F.arrow_udf(BinaryType())
def encoded(name: pa.Array, flag: pa.Array, bases: pa.Array, quals: pa.Array, tags: pa.Array) -> pa.Array:
    """Each record in bytes."""
    rows = zip(*(x.to_pylist() for x in (name, flag, bases, quals, tags)), strict=True)
    return pa.array([encode(n, f, b or "", q, t or ()) for n, f, b, q, t in rows], pa.binary())


def write(made: DataFrame, folder: str, headers: Mapping[str, Sequence[str]], folders: Mapping[str, str]) -> None:
    """Rows (dest, record), ordered within partitions, as BAM parts below folder/folders[dest]/; all or nothing."""
    import json

    made.sparkSession.dataSource.register(Bam)
    made.write.format("readroute_bam").mode("append").option("headers", json.dumps({d: list(x) for d, x in headers.items()})).option("folders", json.dumps(dict(folders))).save(folder)
