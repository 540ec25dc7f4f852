"""Queries through files: what the tables' keys give is written as FASTQ, FASTA or SAM and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from readroute.functions import seq
from readroute.plans.analyze import analyze
from readroute.plans.demux import Demux
from readroute.plans.spec import parse
from readroute.registry import fragments, query, run, spread
from readroute.sources import sinks
from readroute.sources.bgzf import write_lines
from readroute.sources.files import write_files
from readroute.sources.reads import open_fragments
from readroute.sources.scratch import scratch_path


def _written(spark, sf_dir, pattern: str, kind: str, **spec) -> str:
    """The folder of a run's records."""
    d = run(spark, sf_dir, out=pattern, **spec)
    folder = scratch_path(spark)
    sinks.write(d.records(), folder, None, d.headers("1", "query") if kind == "sam" else None, d.destinations())
    return folder


@query("fastq_pair_files", "SELECT fid - 1 AS place, b1, q1, b2, q2 FROM (SELECT row_number() OVER (ORDER BY fid) AS fid, b1, q1, b2, q2 FROM r)")
def fastq_pair_files(spark, sf_dir):
    """Two FASTQ files written, then read in step."""
    folder = _written(spark, sf_dir, "R%ordinal.fq", "fastq")
    back, _, _ = open_fragments(spark, [f"{folder}/dest=R{k}.fq" for k in (1, 2)])
    return back.select(F.col("fid").alias("place"), F.col("reads")[0]["bases"].alias("b1"), F.col("reads")[0]["quals"].alias("q1"), F.col("reads")[1]["bases"].alias("b2"), F.col("reads")[1]["quals"].alias("q2"))


@query("fastq_interleaved_file", "SELECT 'o' || fid AS name, b1, b2, q2 FROM r")
def fastq_interleaved_file(spark, sf_dir):
    """Raw reads of removed fragments go to one file, mates together, and are found to be interleaved."""
    folder = _written(spark, sf_dir, "none%ordinal.fq", "fastq", groups=["i={A,C,G,T}", "i::loc=0:0:1,anchor=5p"], remove=["i=gone.fq"])
    back, files, _ = open_fragments(spark, [f"{folder}/dest=gone.fq"])
    assert files == 2
    return back.select(seq.mate_key(F.col("reads")[0]["name"]).alias("name"), F.col("reads")[0]["bases"].alias("b1"), F.col("reads")[1]["bases"].alias("b2"), F.col("reads")[1]["quals"].alias("q2"))


@query("fasta_file", "SELECT 'o' || fid || '/1' AS name, substr(b1, 3) || b2 AS bases, NULL::VARCHAR AS quals, 'RX:Z:' || substr(b1, 1, 2) AS tags FROM r")
def fasta_file(spark, sf_dir):
    folder = _written(spark, sf_dir, "all.fa", "fasta", extracts=["u=0:0:2", "x=0:2:end", "y=1:0:end"], templates=["x+y"], tags=["RX=u", "RX::qual=none"])
    back, _, _ = open_fragments(spark, [f"{folder}/dest=all.fa"], per_record=True)
    return back.select(F.col("reads")[0]["name"].alias("name"), F.col("reads")[0]["bases"].alias("bases"), F.col("reads")[0]["quals"].alias("quals"), seq.render_tags(F.col("reads")[0]["tags"]).alias("tags"))


_INDEX = {"groups": ["i={A,C,G,T}", "i::loc=0:0:1,anchor=5p"]}


@query("sam_file", "SELECT 'o' || fid AS name, substr(b1, 5) AS b1, substr(q1, 5) AS q1, b2, 'BC:Z:' || substr(b1, 1, 4) || chr(9) || 'QT:Z:' || substr(q1, 1, 4) || chr(9) || 'RG:Z:s' || CASE WHEN substr(b1, 1, 1) IN ('A', 'C') THEN '1' ELSE '2.x' END AS tags FROM r")
def sam_file(spark, sf_dir):
    """Pairs with tags and read groups as SAM lines, read back in pairs by name."""
    folder = _written(spark, sf_dir, "%pool.sam", "sam", **_INDEX, samples=["s1=i::A,C", "s2::x=i::G,T"], extracts=["c=0:0:4", "x=0:4:end", "y=1:0:end"], templates=["x", "y"], tags=["BC=c"])
    back, _, _ = open_fragments(spark, [f"{folder}/dest=pool.sam"])
    own = back.select(F.col("reads")[0].alias("r"), F.col("fid")).groupBy("r.name").agg(F.min_by("r", "fid").alias("a"), F.max_by("r", "fid").alias("b"))
    return own.select("name", F.col("a.bases").alias("b1"), F.col("a.quals").alias("q1"), F.col("b.bases").alias("b2"), seq.render_tags(F.col("a.tags")).alias("tags"))


@query("sam_lines_read", """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 16 WHEN 2 THEN 256 ELSE 77 END AS flag, translate(md5('' || event_id), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s, translate(md5('q' || event_id), '0123456789abcdef', '!#+5:?ABCDEFGHIJ') AS q, event_type FROM events)
SELECT 'e' || event_id AS name, CASE WHEN flag = 16 THEN translate(reverse(s), 'ACGT', 'TGCA') ELSE s END AS bases, CASE WHEN flag = 16 THEN reverse(q) ELSE q END AS quals, 'XZ:Z:' || event_type AS tags FROM e WHERE flag <> 256""")
def sam_lines_read(spark, sf_dir):
    """SAM text of the events: secondary lines go, reversed ones turn back, alignment tags fall away."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type"))
    digits = lambda what, to: F.translate(F.md5(F.concat(F.lit(what), F.col("event_id").cast("string")).cast("binary")), "0123456789abcdef", to)
    flag = F.element_at(F.array(*map(F.lit, ["4", "16", "256", "77"])), (F.col("event_id") % 4 + 1).cast("int"))
    line = F.concat_ws("\t", F.concat(F.lit("e"), F.col("event_id").cast("string")), flag, *map(F.lit, ["*", "0", "0", "*", "*", "0", "0"]), digits("", "ACGTACGTACGTACGT"), digits("q", "!#+5:?ABCDEFGHIJ"), F.lit("NM:i:3"), F.concat(F.lit("XZ:Z:"), "event_type"))
    folder = scratch_path(spark)
    head = spark.createDataFrame([("@HD\tVN:1.6",)], "value string").coalesce(1)
    head.unionByName(e.select(line.alias("value"))).write.text(f"{folder}/events.sam")
    back, _, _ = open_fragments(spark, [f"{folder}/events.sam"])
    return back.select(F.col("reads")[0]["name"].alias("name"), F.col("reads")[0]["bases"].alias("bases"), F.col("reads")[0]["quals"].alias("quals"), seq.render_tags(F.col("reads")[0]["tags"]).alias("tags"))


@query("fasta_lines_read", "WITH d AS (SELECT doc_id, replace(replace(text, '>', ' '), chr(13), ' ') AS text FROM documents WHERE text IS NOT NULL) SELECT 'd' || doc_id AS name, replace(text, chr(10), '') AS bases FROM d")
def fasta_lines_read(spark, sf_dir):
    """Whole documents as FASTA records whose sequence lines are theirs, on any number of lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    folder = scratch_path(spark)
    docs.select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" a comment\n"), F.regexp_replace("text", "[>\r]", " ")).alias("value")).write.text(f"{folder}/documents.fa")
    back, _, _ = open_fragments(spark, [f"{folder}/documents.fa"], per_record=True)
    return back.select(F.col("reads")[0]["name"].alias("name"), F.col("reads")[0]["bases"].alias("bases"))


@query("raw_bins_by_source", "SELECT dest, count(*) AS n, CAST(sum(length(b)) AS BIGINT) AS bases FROM (SELECT CASE substr(b1, 1, 1) WHEN 'A' THEN 'gone.fq' WHEN 'C' THEN 'out' ELSE 'un.' || k || '.fq' END AS dest, CASE k WHEN 0 THEN b1 ELSE b2 END AS b FROM r, (VALUES (0), (1)) v(k)) GROUP BY 1")
def raw_bins_by_source(spark, sf_dir):
    """Two inputs: %source parts the unassigned by input, a removal's own pattern takes mates together; assigned fragments have no pattern, so they are one stream."""
    d = run(spark, sf_dir, **_INDEX, samples=["s=i::C"], remove=["i::A=gone.fq"], unassigned="un.%source.fq")
    return d.records().groupBy("dest").agg(F.count("*").alias("n"), F.sum(F.length("bases")).alias("bases"))


@query("raw_bin_of_one_input", "SELECT CASE WHEN substr(b1, 1, 1) = 'C' THEN 'out' ELSE 'un.0.fq' END AS dest, count(*) AS n FROM r, (VALUES (0), (1)) v(k) GROUP BY 1")
def raw_bin_of_one_input(spark, sf_dir):
    """One interleaved input is one source: mates stay together."""
    spec = analyze(parse(**_INDEX, samples=["s=i::C"], unassigned="un.%source.fq"))
    return Demux(fragments(spark, sf_dir), spec, 2, 1).records().groupBy("dest").agg(F.count("*").alias("n"))


@query("destinations", "WITH t(dest) AS (VALUES ('s1.x20.R1.fq'), ('s1.x20.R2.fq'), ('s2.libx20.R1.fq'), ('s2.libx20.R2.fq'), ('un.0.fq'), ('un.1.fq')) SELECT dest, (SELECT count(*) FROM orders) * CASE WHEN dest LIKE 'un%' THEN 1 ELSE 0 END AS n FROM t")
def destinations(spark, sf_dir):
    """Every declared destination, those without records too: a sample asks for two first bases at once, so no fragment is its own.

    Twelve of one base alone would not do: of nine million orders three begin so.
    """
    groups = ["g={AAAAAAAAAAAA,CCCCCCCCCCCC}", "g::loc=0:0:12,anchor=5p", "h={A,C}", "h::loc=0:0:1,anchor=5p"]
    d = run(spark, sf_dir, groups=groups, samples=["s1=g::AAAAAAAAAAAA+h::C", "s2::lib=g::CCCCCCCCCCCC+h::A"], out="%sample%2E%sub_samplex20.R%ordinal.fq", unassigned="un.%source.fq")
    declared = spark.createDataFrame([(x,) for x in d.destinations()], "dest string")
    return declared.join(d.records().groupBy("dest").agg(F.count("*").alias("n")), "dest", "left").select("dest", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("sam_headers", """WITH t(dest, line, rg) AS (VALUES ('s1.sam', '@RG' || chr(9) || 'ID:s1' || chr(9) || 'SM:s1' || chr(9) || 'PL:X', 's1'), ('s2.sam', '@RG' || chr(9) || 'ID:s2.x' || chr(9) || 'SM:s2' || chr(9) || 'LB:x' || chr(9) || 'PL:X', 's2.x'), ('un.sam', '@RG' || chr(9) || 'ID:pool' || chr(9) || 'SM:pool' || chr(9) || 'LB:pool' || chr(9) || 'PL:X', 'pool')),
n AS (SELECT CASE substr(translate(md5(o_orderkey || ':1'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 1) WHEN 'A' THEN 's1' WHEN 'C' THEN 's2.x' ELSE 'pool' END AS rg, 2 * count(*) AS records FROM orders GROUP BY 1) SELECT dest, line, coalesce(records, 0) AS records FROM t LEFT JOIN n USING (rg)""")
def sam_headers(spark, sf_dir):
    """The read groups that each written SAM file declares, and how many of its records have them."""
    folder = _written(spark, sf_dir, "%sample.sam", "sam", **_INDEX, samples=["s1=i::A", "s2::x=i::C"], unassigned="un.sam", rg_tags=["PL=X"])
    back = spark.read.option("basePath", folder).text(folder)
    heads = back.filter(F.col("value").startswith("@RG")).select("dest", F.col("value").alias("line"), F.regexp_extract("value", "ID:([^\t]*)", 1).alias("rg"))
    found = back.filter(~F.col("value").startswith("@")).groupBy("dest", F.regexp_extract("value", "RG:Z:([^\t]*)", 1).alias("rg")).agg(F.count("*").alias("records"))
    return heads.join(found, ["dest", "rg"], "full_outer").select("dest", "line", F.coalesce("records", F.lit(0).cast("long")).alias("records"))


@query("bgzf_file", "SELECT 'o' || fid || '/1' AS name, b1, q1, row_number() OVER (ORDER BY fid) - 1 AS place FROM r")
def bgzf_file(spark, sf_dir):
    """Reads written as BGZF, read back by a task for each range of members."""
    reads = fragments(spark, sf_dir).select("fid", F.col("reads")[0].alias("r"))
    folder = f"{scratch_path(spark)}/reads.fq.gz"
    line = F.concat_ws("\n", F.concat(F.lit("@"), "r.name"), "r.bases", F.lit("+"), "r.quals")
    write_lines(reads.repartitionByRange("fid").sortWithinPartitions("fid").select(line.alias("value")), folder)
    back, _, _ = open_fragments(spark, [folder], per_record=True)
    return back.select(F.col("reads")[0]["name"].alias("name"), F.col("reads")[0]["bases"].alias("b1"), F.col("reads")[0]["quals"].alias("q1"), F.col("fid").alias("place"))


@query("bam_file", "SELECT 'o' || fid AS name, substr(b1, 5) AS b1, substr(q1, 5) AS q1, b2, 'BC:Z:' || substr(b1, 1, 4) || chr(9) || 'QT:Z:' || substr(q1, 1, 4) || chr(9) || 'RG:Z:s' || CASE WHEN substr(b1, 1, 1) IN ('A', 'C') THEN '1' ELSE '2.x' END AS tags FROM r")
def bam_file(spark, sf_dir):
    """Pairs with tags and read groups as BAM, read back by ranges, in pairs by name."""
    folder = _written(spark, sf_dir, "%pool.bam", "sam", **_INDEX, samples=["s1=i::A,C", "s2::x=i::G,T"], extracts=["c=0:0:4", "x=0:4:end", "y=1:0:end"], templates=["x", "y"], tags=["BC=c"])
    back, _, _ = open_fragments(spark, [f"{folder}/dest=pool.bam"])
    own = back.select(F.col("reads")[0].alias("r"), F.col("fid")).groupBy("r.name").agg(F.min_by("r", "fid").alias("a"), F.max_by("r", "fid").alias("b"))
    return own.select("name", F.col("a.bases").alias("b1"), F.col("a.quals").alias("q1"), F.col("b.bases").alias("b2"), seq.render_tags(F.col("a.tags")).alias("tags"))


@query("single_files", ", k AS (SELECT fid, CASE substr(b1, 1, 1) WHEN 'A' THEN 's1.fq.gz' WHEN 'C' THEN 's2.fq.gz' ELSE 'un.bam' END AS dest, b1, b2 FROM r), o AS (SELECT dest, fid, CASE WHEN dest = 'un.bam' THEN b1 ELSE substr(b1, 5) END AS b, 1 AS k FROM k UNION ALL SELECT dest, fid, b2, 2 FROM k WHERE dest = 'un.bam') SELECT dest, row_number() OVER (PARTITION BY dest ORDER BY fid, k) - 1 AS place, b AS bases FROM o")
def single_files(spark, sf_dir):
    """One file for each destination, BGZF and BAM, in the order of fragments: every record and its place."""
    d = run(spark, sf_dir, **_INDEX, samples=["s1=i::A", "s2=i::C"], extracts=["x=0:4:end"], templates=["x"], out="%sample.fq.gz", unassigned="un.bam")
    folder = scratch_path(spark)
    write_files(d.records(), folder, d.headers("1", "query"), d.destinations())
    back = [open_fragments(spark, [f"{folder}/{x}"], per_record=True)[0].select(F.lit(x).alias("dest"), F.col("fid").alias("place"), F.col("reads")[0]["bases"].alias("bases")) for x in d.destinations()]
    return back[0].unionByName(back[1]).unionByName(back[2])
