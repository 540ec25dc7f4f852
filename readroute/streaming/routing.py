"""Routing of a stream of fragments: each micro-batch is one run, as fragments don't depend on each other.

What a batch writes lies in a folder of its number, so a batch that is run again after a
failure takes the place of what it wrote before, and the reports, sums over the batches'
totals, count it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from readroute.operators import metrics
from readroute.plans.demux import Demux
from readroute.plans.spec import Spec
from readroute.sources import sinks
from readroute.sources.lockstep import RECORD, pad, records
from readroute.sources.reads import fragments_of

VERSION = "0.1"


def fastq_stream(spark: SparkSession, folder: str, per: int = 1, files_at_once: int | None = None) -> DataFrame:
    """A stream of (fid, reads) of the FASTQ files that come into a folder, `per` neighbouring records a fragment.

    A file is read whole when it has come, as sequencers and loaders leave them; its records
    keep their order. Files that end in .gz are unpacked.
    """
    lines = spark.readStream.format("text").option("wholetext", True)
    if files_at_once:
        lines = lines.option("maxFilesPerTrigger", files_at_once)
    whole = lines.load(folder).select(F.col("_metadata.file_path").alias("file"), "value")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                columns = records((text or b"").split(b"\n"), per)
                n = len(columns[0])
                made = [pa.StructArray.from_arrays([pad(columns[4 * k + c], n) for c in range(4)], names=["head", "bases", "plus", "quals"]) for k in range(per)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(range(n), pa.int64()), *made], names=["file", "place", *[f"r{k}" for k in range(per)]])

    found = whole.mapInArrow(parted, "file string, place long, " + ", ".join(f"r{k} {RECORD}" for k in range(per)))
    fid = F.shiftleft(F.pmod(F.xxhash64("file"), F.lit(1 << 30)), 32) + F.col("place")
    return fragments_of(found.withColumn("fid", fid), [folder], per)


def route_stream(fragments: DataFrame, spec: Spec, files: int, folder: str, text: bool = False, totals: str | None = None) -> DataStreamWriter:
    """A writer, not started, that puts the records of (fid, reads) fragments below `folder` by batch and destination.

    As Parquet, or with `text` in the format of each destination. `totals` names a folder
    for what reports() sums up.
    """

    def one(batch: DataFrame, number: int) -> None:
        run = Demux(batch, spec, files)
        if text:
            sinks.write(run.records(), f"{folder}/batch={number}", None, run.headers(VERSION, "stream"), run.destinations(), run.kind, overwrite=True)
        else:
            run.records().repartitionByRange("dest", "fid").sortWithinPartitions("dest", "fid", "ordinal").write.mode("overwrite").partitionBy("dest").parquet(f"{folder}/batch={number}")
        if totals:
            run.totals().coalesce(1).write.mode("overwrite").parquet(f"{totals}/batch={number}")

    return fragments.writeStream.foreachBatch(one)


def reports(spark: SparkSession, totals: str, spec: Spec, files: int) -> tuple[DataFrame, DataFrame]:
    """(per-sample report, summary) of all batches so far."""
    found = spark.read.option("basePath", totals).parquet(f"{totals}/batch=*")
    sums = found.groupBy("target", "disposition").agg(*[F.sum(c).alias(c) for c in found.columns if c not in ("target", "disposition", "batch")])
    return metrics.per_sample(sums, spec), metrics.summary(sums, spec, files)
