"""One file for each destination.

The upstream plan runs once: each task sorts its own records by destination and leaves a
segment for each in a staging folder. A second job joins the segments of a destination in
the order of its fragments, a task for each destination, behind its own header; those that
got no record are made by the same job. Plain text, BGZF and BAM can all be joined as
bytes. Files take their places when all of them are there, so a run that fails leaves none.

A destination's file is written by one task, as a file has to be; where outputs are larger
than that allows, sinks.write() leaves them in parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from readroute.sources import bam, sinks
from readroute.sources.bgzf import END, MEMBER, member, opened

#: Bytes that are copied at once.
COPY = 8 << 20


@dataclass
class Segment(WriterCommitMessage):
    """The segments of a task: (dest, first fragment, last fragment, file)."""

    found: list[tuple[str, int, int, str]]


def packed(dest: str) -> bool:
    """Whether a destination's file is BGZF."""
    return dest.endswith((".gz", ".bam"))


class _Writer(DataSourceArrowWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        context = TaskContext.get()
        where, top = opened(self.staging)
        where.create_dir(top, recursive=True)
        found: list[list] = []
        out, held = None, bytearray()

        def flush(last: bool) -> None:
            while len(held) >= MEMBER or last and held:
                out.write(member(bytes(held[:MEMBER])) if packed(found[-1][0]) else bytes(held[:MEMBER]))
                del held[:MEMBER]

        for batch in iterator:
            for dest, fid, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not found or dest != found[-1][0]:
                    if out is not None:
                        flush(True)
                        out.close()
                    found.append([dest, fid, fid, f"{context.partitionId()}-{context.taskAttemptId()}-{len(found)}"])
                    out = where.open_output_stream(f"{top}/{found[-1][3]}", compression=None)
                found[-1][2] = fid
                held += data
                flush(False)
        if out is not None:
            flush(True)
            out.close()
        return Segment([tuple(f) for f in found])

    def commit(self, messages: list[Segment | None]) -> None:
        where, top = opened(self.staging)
        where.create_dir(top, recursive=True)
        rows = [f for m in messages if m is not None for f in m.found]
        table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("dest", "first", "last", "name"))}, schema=pa.schema([("dest", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("name", pa.string())]))
        with where.open_output_stream(f"{top}/segments", compression=None) as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)

    def abort(self, messages: list[Segment | None]) -> None:
        remove(self.staging)


def remove(folder: str) -> None:
    where, top = opened(folder)
    if where.get_file_info(top).type == fs.FileType.Directory:
        where.delete_dir(top)


class Segments(DataSource):
    """Rows (dest, fid, data), sorted within partitions, to segments in a staging folder."""

    @classmethod
    def name(cls) -> str:
        return "readroute_segments"

    def schema(self) -> str:
        return "dest string, fid long, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _Writer(self.options["path"])


def head_of(dest: str, kind: str, header: Sequence[str]) -> bytes:
    """What a destination's file begins with."""
    if kind == "bam":
        text = bam.header_bytes(header)
        return b"".join(member(text[k : k + MEMBER]) for k in range(0, len(text), MEMBER))
    return "".join(f"{x}\n" for x in header).encode() if kind == "sam" else b""


def write_files(records: DataFrame, folder: str, headers: Mapping[str, Sequence[str]], declared: Sequence[str], default: str = "fastq", in_order: bool = False) -> None:
    """The records of each declared destination as one file, folder/destination, in the order of fragments.

    `in_order`: the fragments of each partition come before those of the next, as where
    files are read in step; else they are dealt so first. Formats and headers are those
    of sinks.write(), and what ends in .gz is BGZF. A destination may be in a folder of its own.
    """
    for d in declared:
        if not d or d.startswith("/") or ".." in d.split("/"):
            raise ValueError(f"{d}: not a file below the output folder")
    spark, staging = records.sparkSession, f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"
    spark.dataSource.register(Segments)
    line = sinks.lines(records, None, default).withColumn("data", F.concat("line", F.lit("\n")).cast("binary"))
    if any(sinks.kind_of_path(d, default) == "bam" for d in declared):
        own = sinks.kind_of(default) == "bam"
        line = line.filter(~own).select("dest", "fid", "ordinal", "data").unionByName(records.filter(own).select("dest", "fid", "ordinal", sinks.bam_record().alias("data")))
    if not in_order:
        line = line.repartitionByRange("fid")
    try:
        line.sortWithinPartitions("dest", "fid", "ordinal").select("dest", "fid", "data").write.format("readroute_segments").mode("append").save(staging)
        _merge(spark, folder.rstrip("/"), staging, headers, declared, default)
    finally:
        remove(staging)


def _merge(spark, folder: str, staging: str, headers: Mapping[str, Sequence[str]], declared: Sequence[str], default: str) -> None:  # noqa: ANN001
    where, top = opened(staging)
    with where.open_input_file(f"{top}/segments") as f:
        found = pa.ipc.open_file(f).read_all().sort_by([("dest", "ascending"), ("first", "ascending")]).to_pylist()
    names: dict[str, list[str]] = {d: [] for d in declared}
    last: dict[str, int] = {}
    for s in found:
        if s["dest"] in last and s["first"] < last[s["dest"]]:
            raise ValueError(f"{s['dest']}: fragments are not in the order of partitions")
        last[s["dest"]] = s["last"]
        names[s["dest"]].append(s["name"])
    rows = [(k, d, head_of(d, sinks.kind_of_path(d, default), headers.get(d, ())), own) for k, (d, own) in enumerate(names.items())]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = opened(staging)
        for batch in batches:
            for k, dest, head, own in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                attempt = f"{top}/merged-{k}-{TaskContext.get().taskAttemptId()}"
                with where.open_output_stream(attempt, compression=None) as out:
                    out.write(head)
                    for name in own:
                        with where.open_input_stream(f"{top}/{name}", compression=None) as f:
                            while data := f.read(COPY):
                                out.write(data)
                    if packed(dest):
                        out.write(END)
                yield pa.RecordBatch.from_arrays([pa.array([dest]), pa.array([attempt])], names=["dest", "file"])

    n = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    made = spark.createDataFrame(rows, "k int, dest string, head binary, own array<string>").repartition(n, "k").mapInArrow(merge, "dest string, file string").collect()
    _, final = opened(folder)
    for r in made:
        if "/" in r["dest"]:
            where.create_dir(f"{final}/{r['dest'].rsplit('/', 1)[0]}", recursive=True)
        where.move(r["file"], f"{final}/{r['dest']}")
