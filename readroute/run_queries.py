"""Queries of whole runs: tag tables and sample sheets made from the tables, outcomes, streams, the command line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute import cli
from readroute.functions import seq
from readroute.operators.qc import qc_json
from readroute.plans.analyze import analyze
from readroute.plans.demux import Demux
from readroute.plans.spec import parse
from readroute.registry import BASES, HEX, QUALS, query, run, spread, synthetic
from readroute.sources import sinks
from readroute.sources.reads import from_columns
from readroute.sources.scratch import scratch_path
from readroute.streaming.routing import fastq_stream, reports, route_stream


def _code(key: Column) -> Column:
    """A barcode of eight bases."""
    return F.substring(F.translate(F.md5(F.concat(F.lit("n"), key.cast("string")).cast("binary")), HEX, BASES), 1, 8)


def _sql_code(key: str) -> str:
    return f"substr(translate(md5('n' || {key}), '{HEX}', '{BASES}'), 1, 8)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read for each customer: the barcode of the nation, then bases of its own."""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"))
    key = F.col("c_custkey")
    bases = F.concat(_code(F.col("c_nationkey")), F.substring(synthetic(key, "c", BASES), 1, 16))
    return from_columns(c, key, (F.concat(F.lit("c"), key.cast("string")), bases, F.substring(synthetic(key, "d", QUALS), 1, 24)))


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The nations with their regions and barcodes: a row for each of the 25, as a tag table would hold them."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name", _code(F.col("n_nationkey")).alias("code")).orderBy("n_nationkey").collect()


def _name(text: str) -> str:
    return text.replace(" ", "_")


@query("tag_table_samples", f"WITH s AS (SELECT replace(n_name, ' ', '_') AS sample, replace(r_name, ' ', '_') AS sub_sample, count(c_custkey) AS reads FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON {_sql_code('c_nationkey')} = {_sql_code('n_nationkey')} GROUP BY 1, 2) SELECT 'pool' AS pool, sample, sub_sample, reads, printf('%.6f', reads / (SELECT count(*) FROM customer)) AS frac_of_pool, printf('%.6f', CASE WHEN reads > 0 THEN 4 / 24 ELSE 0 END) AS frac_bases_unextracted FROM s")
def tag_table_samples(spark, sf_dir):
    """Samples from a tag table with sub-samples, and their report."""
    table = "\n".join(["# nations", "id\tbarcode\tsub_sample", *[f"{_name(r.n_name)}\t{r.code}\t{_name(r.r_name)}" for r in _nations(spark, sf_dir)]])
    spec = analyze(parse(groups=["bc=nations.tsv", "bc::loc=0:0:8,anchor=5p"], extracts=["body=0:12:end", "code=@bc"], templates=["body"], tags=["BC=code"], sample_from_group="bc"), {"nations.tsv": table}.__getitem__)
    return Demux(_customers(spark, sf_dir), spec, 1).per_sample().drop("target")


@query("sample_sheet", f"WITH s AS (SELECT r_name, n_name, {_sql_code('n_nationkey')} AS code FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2) SELECT replace(r_name, ' ', '_') AS sample, replace(n_name, ' ', '_') AS sub_sample, CASE WHEN s.code IS NULL THEN 'unassigned' ELSE 'assigned' END AS disposition, count(*) AS reads FROM customer LEFT JOIN s ON {_sql_code('c_nationkey')} = s.code GROUP BY ALL")
def sample_sheet(spark, sf_dir):
    """Samples from a sheet that leaves one region out."""
    rows = _nations(spark, sf_dir)
    table = "id\tseq\n" + "\n".join(f"n{r.n_nationkey}\t{r.code}" for r in rows)
    left_out = spark.read.parquet(f"{sf_dir}/region.parquet").filter("r_regionkey = 2").first().r_name
    sheet = "sample\tsub_sample\tbc\n" + "\n".join(f"{_name(r.r_name)}\t{_name(r.n_name)}\tn{r.n_nationkey}" for r in rows if r.r_name != left_out)
    spec = analyze(parse(groups=["bc=t.tsv", "bc::loc=0:0:8,anchor=5p"], sample_sheet=sheet), {"t.tsv": table}.__getitem__)
    return Demux(_customers(spark, sf_dir), spec, 1).routed().groupBy("sample", "sub_sample", "disposition").agg(F.count("*").alias("reads"))


BUCKETS = 400


def _long_code(text: Column) -> Column:
    """A barcode of sixteen bases."""
    return F.substring(F.translate(F.md5(text.cast("binary")), HEX, BASES), 1, 16)


@query("route_ten_thousand_samples", f"WITH c AS (SELECT 's' || c_nationkey || '_' || c_custkey % {BUCKETS} AS sample FROM customer), t AS (SELECT 's' || n_nationkey || '_' || b AS sample, 'b' || b AS sub_sample FROM nation, range({BUCKETS}) v(b)), n AS (SELECT sample, count(*) AS reads FROM c GROUP BY 1) SELECT 'pool' AS pool, sample, sub_sample, coalesce(reads, 0) AS reads, printf('%.6f', coalesce(reads, 0) / (SELECT count(*) FROM customer)) AS frac_of_pool, '0.000000' AS frac_bases_unextracted FROM t LEFT JOIN n USING (sample)")
def route_ten_thousand_samples(spark, sf_dir):
    """A sample for each of 25 x 400 pairs of barcodes: the report has a row for all of them."""
    nations = [r.n_nationkey for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect()]  # 25 rows
    codes = spark.createDataFrame([(f"n{n}",) for n in nations] + [(f"b{b}",) for b in range(BUCKETS)], "id string").select("id", _long_code(F.col("id")).alias("code")).collect()
    table = {k: "id\tseq\n" + "\n".join(f"{r.id}\t{r.code}" for r in codes if r.id[0] == k) for k in "nb"}
    sheet = "sample\tsub_sample\ti\tj\n" + "\n".join(f"s{n}_{b}\tb{b}\tn{n}\tb{b}" for n in nations for b in range(BUCKETS))
    spec = analyze(parse(groups=["i=n", "i::loc=0:0:16,anchor=5p", "j=b", "j::loc=1:0:16,anchor=5p"], sample_sheet=sheet), table.__getitem__)
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"))
    key = F.col("c_custkey")
    read = lambda text: (key.cast("string"), F.concat(_long_code(text), F.lit("ACGT")), F.repeat(F.lit("I"), F.lit(20)))
    reads = from_columns(c, key, read(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), read(F.concat(F.lit("b"), (key % BUCKETS).cast("string"))))
    return Demux(reads, spec, 2).per_sample().drop("target")


_ONE = "substr(b1, 1, 1)"
_FINDS = "CAST((20 - length(replace(substr(b2, 1, 20), 'ACG', ''))) / 3 AS BIGINT)"


@query("qc_outcomes", f"""SELECT fid, '{{"v":1,"outcome":' || CASE
  WHEN n > 1 THEN '"unassigned","reason":"find_constraint","group":"f","constraint":"max_finds_per_group","found":' || n || ',"limit":1,' || g
  WHEN {_ONE} = 'T' THEN '"removed","rule":0,"group":"i","tag":"T",' || g
  WHEN {_ONE} = 'G' THEN '"unassigned","reason":"no_sample",' || g
  WHEN n = 0 THEN '"unassigned","reason":"missing_stream","stream":"x",' || g
  ELSE '"assigned","sample":"s","sub_sample":null,' || g END AS qc
FROM (SELECT *, '"groups":[' || i || f || ']}}' AS g FROM (SELECT fid, b1, {_FINDS} AS n, '{{"g":"i","tag":"' || {_ONE} || '","loc":"0:0:1","obs":"' || {_ONE} || '","sub":0,"ind":0}}' AS i,
  CASE WHEN strpos(substr(b2, 1, 20), 'ACG') > 0 THEN ',{{"g":"f","tag":"ACG","loc":"1:' || (strpos(b2, 'ACG') - 1) || ':' || (strpos(b2, 'ACG') + 2) || '","obs":"ACG","sub":0,"ind":0}}' ELSE '' END AS f FROM r))""")
def qc_outcomes(spark, sf_dir):
    """Every way in which a fragment can end, as JSON."""
    d = run(spark, sf_dir, groups=["i={A,C,G,T}", "i::loc=0:0:1,anchor=5p", "f={ACG}", "f::loc=1:0:20,maxFindsPerGroup=1"], samples=["s=i::A,C"], remove=["i::T"], extracts=["x=@f"], templates=["x"])
    return d.routed().select("fid", qc_json(d.spec).alias("qc"))


@query("groups_out_of_order", "SELECT fid, CASE WHEN substr(b1, 1, 2) = 'AC' AND strpos(substr(b1, 5, 10), 'GT') > 0 AND strpos(b2, 'TTA') > 0 THEN strpos(b2, 'TTA') - 1 END AS start FROM r")
def groups_out_of_order(spark, sf_dir):
    """Groups declared before those that they wait for."""
    d = run(spark, sf_dir, groups=["c={TTA}", "c::loc=1:0,prev=b", "b={GT}", "b::loc=0:4:14,prev=a", "a={AC}", "a::loc=0:0:2,anchor=5p"])
    return d.matched().select("fid", F.col("hit_c.start").cast("long").alias("start"))


@query("fitted_qualities", "SELECT fid, CASE WHEN h THEN 'ACGTACG' END AS bases, CASE WHEN h THEN rpad(substr(q1, 1, 5), 7, substr(q1, 5, 1)) END AS quals FROM (SELECT *, substr(b1, 1, 5) = 'GTACG' AS h FROM r)")
def fitted_qualities(spark, sf_dir):
    """A tag cut by the read's start: the declared bases, and qualities drawn out to their length."""
    d = run(spark, sf_dir, groups=["g={ACGTACG}", "g::loc=0:0:5,partial5=5:0"], extracts=["x=@g"])
    return d.extracted().select("fid", "c_x.bases", "c_x.quals")


_EVENT = f"translate(md5(event_id || ':1'), '{HEX}', '{BASES}')"


@query("stream_routed", f"WITH e AS (SELECT {_EVENT} AS b FROM events) SELECT CASE substr(b, 1, 1) WHEN 'A' THEN 's1.fq' WHEN 'C' THEN 's2.fq' ELSE 'un.fq' END AS dest, count(*) AS n, count(DISTINCT b) AS different FROM e GROUP BY 1")
def stream_routed(spark, sf_dir):
    """The events as a stream of reads, routed batch by batch."""
    folder = scratch_path(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    key = F.col("event_id")
    spread(e).transform(lambda x: from_columns(x, key, (key.cast("string"), synthetic(key, "1", BASES), synthetic(key, "q", QUALS)))).write.parquet(f"{folder}/in")
    spec = analyze(parse(groups=["i={A,C,G,T}", "i::loc=0:0:1,anchor=5p"], samples=["s1=i::A", "s2=i::C"], out="%sample.fq", unassigned="un.fq"))
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    route_stream(stream, spec, 1, f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")
    return back.groupBy("dest").agg(F.count("*").alias("n"), F.count_distinct("bases").alias("different"))


@query("stream_reports", f"WITH e AS (SELECT event_id, {_EVENT} AS b FROM events), t(sample) AS (VALUES ('A1'), ('C1')) SELECT 'pool' AS pool, sample, count(b) AS reads, printf('%.6f', count(b) / (SELECT count(*) FROM e)) AS frac_of_pool, printf('%.6f', CASE WHEN count(b) > 0 THEN 4 / 32 ELSE 0 END) AS frac_bases_unextracted FROM t LEFT JOIN e ON substr(b, 1, 1) || '1' = sample GROUP BY 1, 2")
def stream_reports(spark, sf_dir):
    """FASTQ files that come in two parts, routed by a stream that stops between them: the report of both."""
    folder = scratch_path(spark)
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"))
    key = F.col("event_id")
    line = F.concat_ws("\n", F.concat(F.lit("@"), key.cast("string")), synthetic(key, "1", BASES), F.lit("+"), synthetic(key, "q", QUALS))
    spec = analyze(parse(groups=["i={A1=A,C1=C}", "i::loc=0:0:1,anchor=5p"], sample_from_group="i", extracts=["x=0:4:end"], templates=["x"], out="%sample.fq", unassigned="un.fq"))
    for part in range(2):
        e.filter(key % 2 == part).select(line.alias("value")).write.mode("append").text(f"{folder}/in")
        stream = route_stream(fastq_stream(spark, f"{folder}/in", files_at_once=3), spec, 1, f"{folder}/out", text=True, totals=f"{folder}/totals")
        stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return reports(spark, f"{folder}/totals", spec, 1)[0].drop("target", "sub_sample")


@query("command_line_reports", f"WITH e AS (SELECT {_EVENT} AS b FROM events), t(sample) AS (VALUES ('A1'), ('C1'), ('G1')) SELECT 'p' AS pool, sample, count(b) AS reads, printf('%.6f', count(b) / (SELECT count(*) FROM e)) AS frac_of_pool, '0.125000' AS frac_bases_unextracted FROM t LEFT JOIN e ON substr(b, 1, 1) || '1' = sample GROUP BY 1, 2")
def command_line_reports(spark, sf_dir):
    """A run of the command line over a FASTQ file: its per-sample report, read back."""
    folder = scratch_path(spark)
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"))
    key = F.col("event_id")
    none = F.array().cast("array<struct<tag:string,type:string,value:string>>")
    records = e.select(F.lit("in.fq").alias("dest"), key.alias("fid"), F.lit(1).alias("ordinal"), F.lit(1).alias("mates"), F.lit("p").alias("read_group"), key.cast("string").alias("name"), synthetic(key, "1", BASES).alias("bases"), synthetic(key, "q", QUALS).alias("quals"), none.alias("tags"))
    sinks.write(records, f"{folder}/reads", None)
    argv = ["--in", f"0={folder}/reads/dest=in.fq", "--group", "i={A1=A,C1=C,G1=G}", "--group", "i::loc=0:0:1,anchor=5p", "--sample-from-group", "i", "--extract", "x=0:4:end", "--template", "x", "--pool", "p", "--out", f"{folder}/out", "--pattern", "%sample.fq", "--metrics-per-sample", f"{folder}/%pool.tsv", "--per-record"]
    if cli.main(argv, spark):
        raise RuntimeError("the run failed")
    report = spark.read.option("header", True).option("sep", "\t").schema("pool string, sample string, sub_sample string, reads long, frac_of_pool string, frac_bases_unextracted string").csv(f"{folder}/p.tsv")
    return report.drop("sub_sample")


@query("tags_overlaid", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'XI:i:' || event_id || chr(9) || 'RX:Z:' || substr({_EVENT}, 1, 4) || chr(9) || 'XZ:Z:' || event_type ELSE 'XI:i:' || event_id || chr(9) || 'XZ:Z:' || event_type || chr(9) || 'RX:Z:' || substr({_EVENT}, 1, 4) END AS tags FROM events")
def tags_overlaid(spark, sf_dir):
    """Tags that come with the reads stay, a new one takes the place of an old one or is added at the end."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type"))
    key = F.col("event_id")
    old = F.when(key % 3 == 0, F.lit("RX:Z:OLD"))
    comment = F.concat_ws("\t", F.concat(F.lit("XI:i:"), key.cast("string")), old, F.concat(F.lit("XZ:Z:"), "event_type"))
    read = F.struct(key.cast("string").alias("name"), synthetic(key, "1", BASES).alias("bases"), synthetic(key, "q", QUALS).alias("quals"), seq.comment_tags(comment).alias("tags")).cast(seq.READ)
    spec = analyze(parse(extracts=["u=0:0:4"], tags=["RX=u", "RX::qual=none"]))
    found = Demux(e.select(key.alias("fid"), F.array(read).alias("reads")), spec, 1).records()
    return found.select(F.col("fid").alias("event_id"), seq.render_tags(F.col("tags")).alias("tags"))
