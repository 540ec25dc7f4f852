"""Command line: `python -m readroute.cli READS... --group ... --out FOLDER`.

Paths are Spark paths, `-` is the standard input. Records are written below --out by
destination (--pattern), in the format of the pattern's extension; without a pattern, or
with `-`, they go to the standard output. Metrics are small TSV folders.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from readroute.operators.metrics import WARN_UNASSIGNED
from readroute.plans.analyze import analyze
from readroute.plans.demux import Demux
from readroute.plans.spec import SpecError, parse, pattern_parts
from readroute.sources import files as files_of
from readroute.sources import reads, sinks

VERSION = "0.1"
log = logging.getLogger("readroute")


def pool_name(paths: list[str]) -> str:
    """The common start of the file names, without separators at its end."""
    common = os.path.commonprefix([os.path.basename(p).split(".")[0] for p in paths])
    return common.rstrip("._- ") or "pool"


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="readroute", description="Route and annotate sequencing reads.")
    p.add_argument("--version", action="version", version=f"readroute {VERSION}")
    p.add_argument("reads", nargs="*")
    p.add_argument("--in", dest="numbered", action="append", default=[], metavar="N=PATH")
    for name in ("group", "extract", "sample", "remove", "tag"):
        p.add_argument(f"--{name}", action="append", default=[])
    for name in ("template", "rg-tag"):
        p.add_argument(f"--{name}", action="append", nargs="+", default=[])
    for name in ("pool", "sample-sheet", "sample-from-group", "out", "pattern", "unassigned", "metrics-per-sample", "metrics-summary"):
        p.add_argument(f"--{name}")
    p.add_argument("--qc-tag", nargs="?", const="ZS")
    p.add_argument("--require-samples-explain-all-tags", action="store_true")
    p.add_argument("--per-record", action="store_true")
    p.add_argument("--single-files", action="store_true", help="one file for each destination instead of a folder of parts")
    a = p.parse_args(argv)
    if sum(map(bool, (a.sample, a.sample_sheet, a.sample_from_group))) > 1:
        p.error("--sample, --sample-sheet and --sample-from-group exclude each other")
    return a


def inputs(a: argparse.Namespace) -> list[str]:
    if a.reads and a.numbered:
        raise SpecError("inputs are positional or numbered, not both")
    pairs = dict((int(k), v) for k, _, v in (x.partition("=") for x in a.numbered))
    paths = a.reads or [pairs[k] for k in sorted(pairs)] or ["-"]
    if paths.count("-") > 1:
        raise SpecError("the standard input is one input at most")
    if (a.numbered and sorted(pairs) != list(range(len(a.numbered)))):
        raise SpecError("inputs are numbered from 0 on without a gap")
    return paths


def log_run(run: Demux, paths: list[str]) -> None:
    """What goes in and what comes out."""
    out = run.destinations() or ["<stdout>"]
    log.info("pool %s: %d inputs, %d outputs, %d groups, %d extracts, %d templates, %d tags", run.spec.pool, len(paths), len(out), len(run.spec.groups), len(run.spec.extracts), len(run.spec.templates), len(run.spec.tags))
    for i, (path, kind) in enumerate(zip(paths, run.kinds, strict=True)):
        log.info("  input %d: %s (%s)", i, "<stdin>" if path == "-" else path, kind)
    for i, dest in enumerate(out):
        log.info("  output %d: %s (%s)", i, dest, sinks.output_format(dest, run.kinds))


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """The exit code: 0, 1 for what can't be run or read, 2 for arguments that make no sense."""
    try:
        a = arguments(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("readroute").getOrCreate()
    text = lambda path: spark.read.text(path, wholetext=True).first()[0]
    try:
        paths = inputs(a)
        flat = lambda lists: [x for y in lists for x in y]
        screen = a.pattern in (None, "-", "/dev/stdout")
        spec = analyze(
            parse(a.group, a.extract, flat(a.template), a.tag, a.sample, text(a.sample_sheet) if a.sample_sheet else None, a.sample_from_group, a.remove, a.pool or pool_name(paths), None if screen else a.pattern, a.unassigned, a.qc_tag, a.require_samples_explain_all_tags, flat(a.rg_tag)),
            text,
        )
        named = {m: "".join(spec.pool if n else x for x, n in pattern_parts(m, ("pool",))) for m in (a.metrics_per_sample, a.metrics_summary) if m is not None}
        read = [reads.from_stream(spark, sys.stdin.buffer) if p == "-" else p for p in paths]
        fragments, files, kinds = reads.open_fragments(spark, read, a.per_record)
        run = Demux(fragments, spec, files, len(paths), kinds)
        records = run.records()
    except (SpecError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except AnalysisException as e:
        print(f"error: failed to open an input file: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    for w in spec.warnings:
        log.warning(w)
    log_run(run, paths)
    default = "sam" if (default := sinks.output_format("-", kinds)) == "bam" and screen else default
    headers = run.headers(VERSION, " ".join(["readroute", *argv]))
    if screen:
        for line in [*(headers["out"] if default == "sam" else ()), *(r.line for r in sinks.lines(records.filter("dest = 'out'"), default).orderBy("fid", "ordinal").toLocalIterator())]:
            print(line)
        records = records.filter("dest <> 'out'")
    if a.out and a.single_files:
        files_of.write_files(records, a.out, headers, run.destinations(), default)
    elif a.out:
        sinks.write(records, a.out, None, headers, run.destinations(), default)
    if not named:
        return 0
    sums = run.totals()
    sums = spark.createDataFrame(sums.collect(), sums.schema)  # a row for each target and disposition
    tsv = lambda df, path: df.coalesce(1).write.option("header", True).option("sep", "\t").csv(path)
    if a.metrics_per_sample:
        tsv(run.per_sample(sums).orderBy("target").drop("target"), named[a.metrics_per_sample])
    if a.metrics_summary:
        tsv(run.summary(sums), named[a.metrics_summary])
    r = run.summary(sums).first()
    if r.total_reads and r.reads_unassigned / r.total_reads >= WARN_UNASSIGNED:
        log.warning("%d of %d fragments are unassigned", r.reads_unassigned, r.total_reads)
    return 0


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(message)s", stream=sys.stderr)
    sys.exit(main(sys.argv[1:]))
