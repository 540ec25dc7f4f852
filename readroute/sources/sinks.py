"""Records as FASTQ, FASTA or SAM text, in folders by destination, in input order."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.functions.seq import TAG, render_tags
from readroute.plans.spec import Spec
from readroute.sources import bam
from readroute.sources.bgzf import END, opened

if TYPE_CHECKING:
    from readroute.operators.assemble import Declared

_FORMATS = {"fq": "fastq", "fastq": "fastq", "fa": "fasta", "fasta": "fasta", "fna": "fasta", "sam": "sam", "bam": "bam"}


def output_format(path: str, inputs: Sequence[str] = ("fastq",)) -> str:
    """By extension, else that of the inputs if they agree, else SAM."""
    if path.lower().endswith(".sam.gz"):
        raise ValueError(f"{path}: SAM is not compressed")
    known = _FORMATS.get(path.lower().removesuffix(".gz").rsplit(".", 1)[-1])
    kinds = {k for k in inputs if k != "empty"}
    return known or (kinds.pop() if len(kinds) == 1 else "sam")


def _head() -> Column:
    tags = render_tags(F.col("tags"))
    return F.concat(F.col("name"), F.when(F.length(tags) > 0, F.concat(F.lit("\t"), tags)).otherwise(""))


def fastq_lines() -> Column:
    quals = F.coalesce("quals", F.raise_error(F.concat(F.lit("no qualities for FASTQ: "), F.col("name"))).cast("string"))
    return F.concat(F.lit("@"), _head(), F.lit("\n"), F.col("bases"), F.lit("\n+\n"), quals)


def fasta_lines() -> Column:
    return F.concat(F.lit(">"), _head(), F.lit("\n"), F.col("bases"))


def unmapped_flag() -> Column:
    """4, or 77 and 141 for the two of a pair."""
    n = F.col("mates")
    return F.when(n == 1, 4).when(n > 2, F.raise_error(F.lit("SAM takes two reads a fragment at most")).cast("int")).when(F.col("ordinal") == 1, 77).otherwise(141)


def bam_record() -> Column:
    """The same records in bytes."""
    group = F.struct(F.lit("RG").alias("tag"), F.lit("Z").alias("type"), F.col("read_group").alias("value")).cast(TAG)
    return bam.encoded(F.regexp_replace("name", "/[12]$", ""), unmapped_flag(), "bases", "quals", F.concat("tags", F.array(group)))


def sam_lines() -> Column:
    """Unmapped records."""
    flag = unmapped_flag().cast("string")
    bases = F.when(F.length("bases") > 0, F.col("bases")).otherwise("*")
    quals = F.when(F.length("quals") > 0, F.col("quals")).otherwise("*")
    tags = F.concat_ws("\t", F.when(F.size("tags") > 0, render_tags(F.col("tags"))), F.concat(F.lit("RG:Z:"), F.col("read_group")))
    name = F.regexp_replace("name", "/[12]$", "")
    return F.concat_ws("\t", name, flag, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), bases, quals, tags)


def sam_header(spec: Spec, own: Declared, version: str, command: str) -> list[str]:
    """@HD, one @PG, an @RG for each target of a destination, and the pool's if records of no sample go there."""
    shared = "".join(f"\t{k}:{v}" for k, v in spec.rg_tags)
    groups = [f"@RG\tID:{'.'.join(filter(None, (s, b)))}\tSM:{s}" + (f"\tLB:{b}" if b else "") for s, b in own.targets]
    if own.pooled or not groups:
        groups.append(f"@RG\tID:{spec.pool}\tSM:{spec.pool}\tLB:{spec.pool}")
    return ["@HD\tVN:1.6\tSO:unsorted", f"@PG\tID:readroute\tPN:readroute\tVN:{version}\tCL:{command}", *[g + shared for g in dict.fromkeys(groups)]]


def kind_of(default: str) -> Column:
    """The format of each row's destination: by its extension, else `default`."""
    known = F.create_map(*[F.lit(x) for pair in _FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(F.lower("dest"), r"\.([a-z]+)(\.gz)?$", 1)), F.lit(default))


def kind_of_path(dest: str, default: str) -> str:
    """The format of a destination: by its extension, else `default`."""
    return _FORMATS.get(dest.lower().removesuffix(".gz").rsplit(".", 1)[-1] if "." in dest else "", default)


def lines(records: DataFrame, kind: str | None, default: str = "fastq") -> DataFrame:
    """(dest, fid, ordinal, line), in the format `kind`, or each destination's own."""
    own = F.lit(kind) if kind else kind_of(default)
    line = F.when(own == "sam", sam_lines()).when(own == "fasta", fasta_lines()).otherwise(fastq_lines())
    return records.select("dest", "fid", "ordinal", line.alias("line"))


def folder_name(dest: str) -> str:
    """The folder that Spark gives a destination: special characters as %XX (fixed by Hive's layout)."""
    return "dest=" + "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in dest)


def write(records: DataFrame, folder: str, kind: str | None, headers: Mapping[str, Sequence[str]] | None = None, declared: Sequence[str] | None = None, default: str = "fastq", overwrite: bool = False) -> None:
    """Text parts below folder/dest=.../, sorted by fragment; the first part of SAM begins with its destination's header.

    `kind` None: each destination's format is that of its extension, else `default`.
    Ranges of (dest, fid) are dealt to tasks, so a large destination is many parts, in
    order by name. Declared destinations without records get an empty part (SAM: the
    header). What ends in .gz is compressed. With `overwrite` what is in the folder goes.
    """
    spark = records.sparkSession
    if overwrite:
        spark.createDataFrame([], "value string").write.mode("overwrite").text(folder)
    binary = [d for d in (declared if declared is not None else headers or ()) if (kind or kind_of_path(d, default)) == "bam"]
    if binary:
        own = F.lit(kind) if kind else kind_of(default)
        dealt = records.filter(own == "bam").select("dest", "fid", "ordinal", bam_record().alias("record")).repartitionByRange("dest", "fid").sortWithinPartitions("dest", "fid", "ordinal")
        bam.write(dealt.select("dest", "record"), folder, {d: headers[d] for d in binary}, {d: folder_name(d) for d in binary})
        leave_empty(spark, folder, binary, {d: bam.empty_file(headers[d]) for d in binary})
        records, declared = records.filter(own != "bam"), [d for d in declared if d not in set(binary)] if declared is not None else None
        if declared is not None and not declared:
            return
    made = lines(records, kind, default)
    if headers:
        rows = [(d, k, x) for d, own in headers.items() if declared is None or d in declared for k, x in enumerate(own)]
        known = spark.createDataFrame(rows, "dest string, ordinal int, line string").filter((F.lit(kind) if kind else kind_of(default)) == "sam")
        made = known.select("dest", F.lit(-1).cast("long").alias("fid"), "ordinal", "line").unionByName(made)
    packed = F.col("dest").endswith(".gz")
    for gz in sorted({d.endswith(".gz") for d in declared or []} or {False}):
        own = made.filter(packed == gz) if declared and len({d.endswith(".gz") for d in declared}) > 1 else made
        dealt = own.repartitionByRange("dest", "fid").sortWithinPartitions("dest", "fid", "ordinal")
        dealt.select("dest", F.col("line").alias("value")).write.mode("append").partitionBy("dest").option("compression", "gzip" if gz else "none").text(folder)
    leave_empty(spark, folder, declared or [])


def leave_empty(spark: SparkSession, folder: str, declared: Sequence[str], contents: Mapping[str, bytes] | None = None) -> None:
    """A part without records for each declared destination that has none: made as a file, or by a job where pyarrow can't write."""
    try:
        where, top = opened(folder)
        there = {unquote(f.base_name) for f in where.get_file_info(fs.FileSelector(top, allow_not_found=True))}
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        where, there = None, {unquote(part) for f in spark.read.text(folder).inputFiles() for part in re.findall("/(dest=[^/]*)/", unquote(f))}
    for d in declared:
        if unquote(name := folder_name(d)) in there:
            continue
        if where is None:
            spark.createDataFrame([], "value string").coalesce(1).write.option("compression", "gzip" if d.endswith(".gz") else "none").text(f"{folder}/{name}")
            continue
        where.create_dir(f"{top}/{name}", recursive=True)
        end = ".bam" if contents else ".txt.gz" if d.endswith(".gz") else ".txt"
        with where.open_output_stream(f"{top}/{name}/part-00000{end}", compression=None) as f:
            f.write(contents[d] if contents else END if d.endswith(".gz") else b"")
