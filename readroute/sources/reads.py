"""Read files as DataFrames: FASTQ, FASTA and SAM text, plain or gzip, in file order.

Lines get their place in the file from the block that they are in and their place
inside it, so a large plain file is read by many tasks; only the line counts of the
blocks meet in one place.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import BinaryIO
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readroute.functions.seq import FRAGMENT, READ, TAG, comment_tags, first_token, mate_key, revcomp, without_alignment_tags
from readroute.sources import bam
from readroute.sources.bgzf import gzip_lines, is_bgzf, is_gzip
from readroute.sources.lockstep import lockstep
from readroute.sources.scratch import scratch_path

_EXTENSIONS = {"fq": "fastq", "fastq": "fastq", "fa": "fasta", "fasta": "fasta", "fna": "fasta", "sam": "sam", "bam": "bam"}


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, in order by name."""
    return sorted(map(unquote, spark.read.text(path).inputFiles()))


def _raw_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, at, value): lines with their order in each block of a file.

    Gzip is known by its content: BGZF is read by many tasks, and so is a file whose name
    doesn't say that it is gzip by the same source; other .gz files are a task each.
    """
    if files and is_gzip(files[0]) and (not files[0].endswith(".gz") or is_bgzf(files[0])):
        return gzip_lines(spark, files)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(files).select(*place, F.monotonically_increasing_id().alias("at"), "value")


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a file or of a folder of parts, read no further than needed."""
    out: list[str] = []
    for part in _files(spark, path):
        out += [r.value for r in _raw_lines(spark, [part]).limit(n - len(out)).collect()]
        if len(out) == n:
            break
    return out


def sniff(spark: SparkSession, path: str) -> str:
    """fastq, fasta, sam, bam or empty, from the first line; by extension if there is none."""
    first = first_lines(spark, path, 1)
    if not first:
        name = path.lower().removesuffix(".gz").rsplit(".", 1)[-1]
        return "empty" if name not in _EXTENSIONS else _EXTENSIONS[name]
    if first[0].startswith("BAM\x01"):
        return "bam"
    if first[0].startswith(">"):
        return "fasta"
    if re.match("@[A-Z]{2}\t", first[0]):
        return "sam"
    if first[0].startswith("@"):
        return "fastq"
    raise ValueError(f"{path}: neither FASTQ, FASTA nor SAM text")


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, block, at, line): the lines of a file or of a folder of parts; (file, block, first, n, offset): its blocks in order."""
    lines = _raw_lines(spark, _files(spark, path)).select("file", "block", "at", F.regexp_replace("value", "\r$", "").alias("line"))
    return lines, _offsets(lines)


def _offsets(rows: DataFrame) -> DataFrame:
    """(file, block, first, n, offset): how many rows come before each block."""
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row for each block


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line): the lines of one file, or of a folder of parts by name, and their place in it."""
    lines, blocks = _blocks(spark, path)
    return lines.join(F.broadcast(blocks), ["file", "block"]).select((F.col("at") - F.col("first") + F.col("offset")).alias("ord"), "line")


def _read(name: Column, bases: Column, quals: Column, tags: Column) -> Column:
    return F.struct(name.alias("name"), bases.alias("bases"), quals.alias("quals"), tags.alias("tags")).cast(READ)


def _comment(head: Column) -> Column:
    return F.when(head.rlike("[ \t]"), F.regexp_replace(head, "^[^ \t]*[ \t]+", ""))


_PARTS = ["head", "bases", "plus", "quals"]


def _four(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, head, bases, plus, quals) of the records whose four lines follow each other in a block."""
    kept = None
    for batch in batches:
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        at = np.asarray(batch.column(0))
        first = np.flatnonzero(at % 4 == 0)
        first = first[first + 3 < len(at)]
        first = first[at[first + 3] == at[first] + 3]
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(at[first] // 4), *[batch.column(1).take(pa.array(first + k)) for k in range(4)]], names=["ord", *_PARTS])
        kept = batch.slice(max(0, len(at) - 3)) if len(at) else kept  # a record may go on in the next batch


def fastq_records(spark: SparkSession, path: str) -> DataFrame:
    """(ord, head, bases, plus, quals): records are put together where their lines are; only those cut by the end of a block are shuffled.

    Blank lines after the last record don't count.
    """
    lines, blocks = _blocks(spark, path)
    blocks = blocks.withColumn("end", F.col("offset") + F.col("n"))
    ord_ = F.col("at") - F.col("first") + F.col("offset")
    numbered = lines.join(F.broadcast(blocks), ["file", "block"]).withColumn("ord", ord_)
    over = F.expr("floor(ord / 4) * 4 < offset or floor(ord / 4) * 4 + 4 > end")
    inside = numbered.filter(~over).select("ord", "line").mapInArrow(_four, "ord long, " + ", ".join(f"{p} string" for p in _PARTS))
    edges = numbered.filter(over).groupBy(F.floor(F.col("ord") / 4).alias("ord")).agg(*[F.max(F.when(F.col("ord") % 4 == k, F.col("line"))).alias(n) for k, n in enumerate(_PARTS)])
    return inside.unionByName(edges).filter("coalesce(head, '') <> '' or coalesce(bases, '') <> '' or coalesce(quals, '') <> ''")


def _fastq_read(path: str, own: Callable[[str], Column]) -> Column:
    """The read of a record's four lines; one that is broken fails the job."""
    head, bases, quals = F.substring(own("head"), 2, 1 << 30), own("bases"), own("quals")
    bad = F.coalesce(F.length(bases) != F.length(quals), F.lit(True)) | ~F.coalesce(own("head").startswith("@") & own("plus").startswith("+"), F.lit(False))
    whole = F.when(bad, F.raise_error(F.concat(F.lit(f"{path}: a broken record: "), F.coalesce(head, F.lit(""))))).otherwise(bases)
    return _read(first_token(head), whole, quals, comment_tags(_comment(head)))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(ord, read) of a FASTQ file; a record whose lengths differ fails the job."""
    return fastq_records(spark, path).select("ord", _fastq_read(path, F.col).alias("read"))


def in_step(spark: SparkSession, paths: Sequence[str], per: int = 1) -> DataFrame | None:
    """(fid, reads): FASTQ files read in step, or `per` neighbours of one, each task the same records of all; None where files can't be read so."""
    found = lockstep(spark, [_files(spark, p) for p in paths], per)
    if found is None:
        return None
    return fragments_of(found, paths, per)


def fragments_of(found: DataFrame, paths: Sequence[str], per: int = 1) -> DataFrame:
    """(fid, reads) of (fid, r0, r1, ...), the lines of records in step; one that is missing or broken fails the job."""
    whole = []
    for k in range(len(paths) * per):
        path, own = paths[k // per], F.col(f"r{k}")
        lacks = f"input {k} has fewer records than another" if per == 1 else "the last mate is missing"
        whole.append(F.when(own.isNotNull() & own["head"].isNotNull(), _fastq_read(path, lambda c, own=own: own[c])).otherwise(F.raise_error(F.lit(lacks)).cast(READ)))
    return found.select("fid", check_names(F.array(*whole)).alias("reads"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ord, read) of a FASTA file, sequences on any number of lines; no qualities."""
    lines = numbered_lines(spark, path)
    heads = lines.filter(F.col("line").startswith(">")).select(F.col("ord").alias("at"))
    # each line's header: the last header at or before it, found within sorted ranges of lines
    span = 1 << 16
    marked = lines.withColumn("range", F.floor(F.col("ord") / span)).withColumn("head", F.when(F.col("line").startswith(">"), F.col("ord")))
    last = heads.groupBy(F.floor(F.col("at") / span).alias("range")).agg(F.max("at").alias("last"))
    carried = last.withColumn("carry", F.max("last").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each range
    ranges = marked.select("range").distinct().join(carried.select("range", "carry"), "range", "left").withColumn("carry", F.coalesce(F.lag(F.last("carry", True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))).over(Window.orderBy("range")), F.lit(None)))
    within = Window.partitionBy("range").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.join(ranges, "range", "left").withColumn("record", F.coalesce(F.last("head", True).over(within), "carry"))
    own = placed.groupBy("record").agg(F.max(F.when(F.col("ord") == F.col("record"), F.col("line"))).alias("head"), F.array_sort(F.collect_list(F.when(F.col("ord") != F.col("record"), F.struct("ord", "line")))).alias("lines"))
    head = F.substring("head", 2, 1 << 30)
    read = _read(first_token(head), F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit(None).cast("string"), comment_tags(_comment(head)))
    return own.select(F.col("record").alias("ord"), read.alias("read"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """(ord, read) of the primary records of a SAM file, in the orientation of the machine."""
    parts = numbered_lines(spark, path).filter("line not like '@%' and line <> ''").withColumn("f", F.split("line", "\t"))
    flag = F.col("f")[1].cast("int")
    parts = parts.filter(flag.bitwiseAND(0x900) == 0)
    bases = F.when(F.col("f")[9] == "*", "").otherwise(F.col("f")[9])
    quals = F.when(F.col("f")[10] != "*", F.col("f")[10])
    fields = F.filter(F.slice("f", 12, 1 << 20), lambda x: F.length(x) > 4)
    tags = F.transform(fields, lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), F.substring(x, 4, 1).alias("type"), F.substring(x, 6, 1 << 30).alias("value"))).cast(f"array<{TAG}>")
    return parts.select("ord", _machine_read(F.col("f")[0], flag, bases, quals, tags).alias("read"))


def _machine_read(name: Column, flag: Column, bases: Column, quals: Column, tags: Column) -> Column:
    """A record's read in the orientation of the machine, without what describes an alignment."""
    back = flag.bitwiseAND(0x10) != 0
    return _read(name, F.when(back, revcomp(bases)).otherwise(bases), F.when(back, F.reverse(quals)).otherwise(quals), without_alignment_tags(tags))


def bam_reads(spark: SparkSession, path: str) -> DataFrame:
    """(ord, read) of the primary records of a BAM file, by ranges of its members."""
    found = bam.records(spark, _files(spark, path)).filter(F.col("flag").bitwiseAND(0x900) == 0)
    ord_ = (F.col("at") - F.col("first") + F.col("offset")).alias("ord")
    read = _machine_read(F.col("name"), F.col("flag"), F.col("bases"), F.col("quals"), F.col("tags"))
    return found.join(F.broadcast(_offsets(bam.records(spark, _files(spark, path)))), ["file", "block"]).select(ord_, read.alias("read"))


def reads(spark: SparkSession, path: str, kind: str | None = None) -> tuple[str, DataFrame]:
    """(format, (ord, read)) with ord 0, 1, ... in file order."""
    kind = kind or sniff(spark, path)
    if kind == "empty":
        return kind, spark.createDataFrame([], f"ord long, read {READ}")
    found = {"fastq": fastq, "fasta": fasta, "sam": sam, "bam": bam_reads}[kind](spark, path)
    if kind == "fastq":
        return kind, found
    return kind, ranked(found)


def ranked(found: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """`ord` as 0, 1, ...: counts of ranges of places are summed, then ranks within each."""
    cut = found.withColumn("range", F.floor(F.col("ord") / rows))
    n = cut.groupBy("range").agg(F.count("*").alias("n"))
    n = n.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    placed = cut.join(F.broadcast(n), "range").withColumn("ord", F.row_number().over(Window.partitionBy("range").orderBy("ord")) - 1 + F.col("offset"))
    return placed.select("ord", "read")


def check_names(reads: Column) -> Column:
    """`reads`, or an error if their names (without /1, /2) differ."""
    same = F.size(F.array_distinct(F.transform(reads, lambda r: mate_key(r["name"])))) <= 1
    return F.when(same, reads).otherwise(F.raise_error(F.concat(F.lit("names differ: "), F.array_join(F.transform(reads, lambda r: r["name"]), ", "))).cast(f"array<{READ}>"))


def zipped(files: Sequence[DataFrame]) -> DataFrame:
    """(fid, reads): one read of each file, by place; unequal files fail the job."""
    joined = files[0].select("ord", F.col("read").alias("r0"))
    for k, f in enumerate(files[1:], 1):
        joined = joined.join(f.select("ord", F.col("read").alias(f"r{k}")), "ord", "full_outer")
    whole = [F.coalesce(f"r{k}", F.raise_error(F.lit(f"input {k} has fewer records than another")).cast(READ)) for k in range(len(files))]
    own = F.array(*whole)
    return joined.select(F.col("ord").alias("fid"), (check_names(own) if len(files) > 1 else own).alias("reads"))


def interleaved(file: DataFrame) -> DataFrame:
    """(fid, reads): pairs of neighbours; an odd one fails the job."""
    pairs = file.groupBy(F.floor(F.col("ord") / 2).alias("fid")).agg(F.array_sort(F.collect_list(F.struct("ord", "read"))).alias("p"))
    both = F.transform("p", lambda x: x["read"])
    whole = F.when(F.size("p") == 2, both).otherwise(F.raise_error(F.lit("the last mate is missing")).cast(f"array<{READ}>"))
    return pairs.select("fid", check_names(whole).alias("reads"))


def looks_interleaved(spark: SparkSession, path: str, kind: str) -> bool:
    """Whether the first two reads of a FASTX file are mates: only as many lines are read as hold their names."""
    n = 5
    while True:
        lines = [x.removesuffix("\r") for x in first_lines(spark, path, n)]
        heads = lines[0:5:4] if kind == "fastq" else [x for x in lines if x.startswith(">")]
        if kind == "fastq" or len(heads) > 1 or len(lines) < n:
            break
        n *= 8  # a FASTA record on many lines
    names = [re.split("[ \t]", x[1:], maxsplit=1)[0] for x in heads[:2]]
    if names and names[0].endswith("/2"):
        raise ValueError(f"the first read is a second mate: {names[0]}")
    if names and names[0].endswith("/1"):
        return True
    return len(names) == 2 and re.sub("/[12]$", "", names[0]) == re.sub("/[12]$", "", names[1])


def from_stream(spark: SparkSession, stream: BinaryIO, lines: int = 1 << 16) -> str:
    """The folder of a stream's text: some lines at a time go to shared storage, in parts by name."""
    folder, head = scratch_path(spark), stream.read(2)
    source = io.BufferedReader(_Joined(head, stream))
    source = gzip.open(source) if head == b"\x1f\x8b" else source
    text, number = io.TextIOWrapper(source, "utf-8", newline="\n"), 0
    while number == 0 or some:
        some = [(x.rstrip("\n"),) for x in islice(text, lines)]
        spark.createDataFrame(some, "value string").coalesce(1).write.text(f"{folder}/part={number:09d}")
        number += 1
    return folder


class _Joined(io.RawIOBase):
    """A stream whose first bytes were read already."""

    def __init__(self, head: bytes, rest: BinaryIO):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.head[: len(buffer)] or self.rest.read(len(buffer))
        self.head = self.head[len(buffer) :]
        buffer[: len(data)] = data
        return len(data)


def open_fragments(spark: SparkSession, paths: Sequence[str], per_record: bool = False) -> tuple[DataFrame, int, list[str]]:
    """(fragments (fid, reads), reads in each, formats) of input files in order."""
    kinds = [sniff(spark, p) for p in paths]
    with_quals = {k != "fasta" for k in kinds if k != "empty"}
    if len(with_quals) > 1:
        raise ValueError("FASTA has no qualities and can't go with other formats")
    pairs = len(paths) == 1 and kinds[0] in ("fastq", "fasta") and not per_record and looks_interleaved(spark, paths[0], kinds[0])
    if set(kinds) == {"fastq"}:
        found = in_step(spark, paths, 2 if pairs else 1)
        if found is not None:
            return found, 2 if pairs else len(paths), kinds
    files = [reads(spark, p, k)[1] for p, k in zip(paths, kinds, strict=True)]
    return (interleaved(files[0]), 2, kinds) if pairs else (zipped(files), len(files), kinds)


def from_columns(df: DataFrame, fid: Column, *reads_: tuple[Column, Column, Column]) -> DataFrame:
    """Fragments from any DataFrame; reads_: (name, bases, quals) of each read."""
    none = F.array().cast(f"array<{TAG}>")
    return df.select(fid.cast("long").alias("fid"), F.array(*[_read(n, b, q, none) for n, b, q in reads_]).alias("reads"))


__all__ = ["FRAGMENT", "check_names", "from_columns", "interleaved", "looks_interleaved", "numbered_lines", "open_fragments", "reads", "sniff", "zipped"]
