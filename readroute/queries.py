"""Registered queries of the read-routing operators, with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from readroute.functions import seq
from readroute.operators.extract import extract
from readroute.plans.analyze import analyze
from readroute.plans.demux import Demux
from readroute.plans.spec import parse
from readroute.registry import ORACLES, QUERIES, fragments, query, run
from readroute.sources.reads import interleaved, zipped


def _ham(text: str, tags: list[str], limit: int, order: str = "") -> str:
    """SQL: least (cost, index) of tags within the limit as cost * 100 + index, or null."""
    cases = [f"CASE WHEN hamming({text}, '{t}') <= {limit} THEN hamming({text}, '{t}') * 100 + {i} END" for i, t in enumerate(tags)]
    return cases[0] if len(cases) == 1 else f"least({', '.join(cases)})"


@query("synth_reads", "SELECT fid, b1, q1, b2, q2 FROM r")
def synth_reads(spark, sf_dir):
    r = F.col("reads")
    return fragments(spark, sf_dir).select("fid", r[0]["bases"].alias("b1"), r[0]["quals"].alias("q1"), r[1]["bases"].alias("b2"), r[1]["quals"].alias("q2"))


@query("extract_spans", "SELECT fid, substr(b1, 1, 8) AS a, substr(b1, 23, 10) AS t, substr(b2, 6, 25) AS m, substr(q2, 6, 25) AS mq, '' AS e FROM r")
def extract_spans(spark, sf_dir):
    d = run(spark, sf_dir, extracts=["a=0:0:8", "t=0:-10:end", "m=1:5:-2", "e=0:20:10"])
    return d.extracted().select("fid", "s_a.bases", "s_t.bases", "s_m.bases", "s_m.quals", "s_e.bases").toDF("fid", "a", "t", "m", "mq", "e")


@query("revcomp_template", "SELECT fid, translate(reverse(substr(b1, 1, 12)), 'ACGT', 'TGCA') || substr(b2, 1, 4) AS bases, reverse(substr(q1, 1, 12)) || substr(q2, 1, 4) AS quals FROM r")
def revcomp_template(spark, sf_dir):
    d = run(spark, sf_dir, extracts=["a=0:0:12", "b=1:0:4"], templates=["~a+b"])
    return d.records().select("fid", "bases", "quals")


_T3 = ["ACG", "TTT", "CAA"]


@query("anchor5_exact", f"SELECT fid, {_ham('substr(b1, 1, 3)', _T3, 0)} % 100 AS tag FROM r")
def anchor5_exact(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={" + ",".join(_T3) + "}", "g::loc=0:0:3,anchor=5p"])
    return d.matched().select("fid", F.col("hit_g.tag_idx").cast("long").alias("tag"))


@query("anchor5_hamming", f"SELECT fid, m % 100 AS tag, m // 100 AS cost FROM (SELECT fid, {_ham('substr(b1, 3, 3)', _T3, 1)} AS m FROM r)")
def anchor5_hamming(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={" + ",".join(_T3) + "}", "g::loc=0:2:4,anchor=5p,dist=1"])
    return d.matched().select("fid", F.col("hit_g.tag_idx").cast("long").alias("tag"), F.col("hit_g.cost").cast("long").alias("cost"))


@query("anchor3_hamming", f"SELECT fid, m % 100 AS tag, m // 100 AS cost, CAST(CASE WHEN m IS NOT NULL THEN 11 END AS BIGINT) AS start FROM (SELECT fid, {_ham('substr(b2, 12, 3)', _T3, 1)} AS m FROM r)")
def anchor3_hamming(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={" + ",".join(_T3) + "}", "g::loc=1:8:14,anchor=3p,dist=1"])
    return d.matched().select("fid", *[F.col(f"hit_g.{c}").cast("long").alias(n) for c, n in (("tag_idx", "tag"), ("cost", "cost"), ("start", "start"))])


@query("iupac_tag", "SELECT fid, CASE WHEN regexp_full_match(substr(b1, 1, 4), 'T[CT]G[ACGT]') THEN 0 WHEN regexp_full_match(substr(b1, 1, 4), 'A[AG][AC]T') THEN 1 END AS tag, substr(b1, 1, 4) AS seen FROM r")
def iupac_tag(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={TYGN,ARMT}", "g::loc=0:0:4,anchor=5p"], extracts=["seen=0:0:4"])
    return d.extracted().select("fid", F.col("hit_g.tag_idx").cast("int").alias("tag"), F.col("s_seen.bases").alias("seen"))


@query("read_no_call", "SELECT fid, translate(upper(b1), 'T', 'X') AS masked, CASE WHEN hamming(substr(translate(b1, 'T', 'N'), 1, 3), 'TAC') <= 1 THEN hamming(substr(translate(b1, 'T', 'N'), 1, 3), 'TAC') END AS cost FROM r")
def read_no_call(spark, sf_dir):
    frag = fragments(spark, sf_dir).withColumn("reads", F.transform("reads", lambda r: r.withField("bases", F.translate(r["bases"], "T", "N"))))
    d = Demux(frag, analyze(parse(groups=["g={TAC}", "g::loc=0:0:3,anchor=5p,dist=1"])), 2)
    return d.matched().select("fid", seq.mask_no_call(F.col("reads")[0]["bases"]).alias("masked"), F.col("hit_g.cost").cast("long").alias("cost"))


@query("slide_exact", "SELECT fid, CASE WHEN strpos(b1, 'ACGT') > 0 THEN strpos(b1, 'ACGT') - 1 END AS start, CAST((32 - length(replace(b1, 'ACGT', ''))) / 4 AS BIGINT) AS finds FROM r")
def slide_exact(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={ACGT}", "g::loc=0:0"])
    return d.matched().select("fid", F.col("hit_g.start").cast("long").alias("start"), F.size("acc_g").cast("long").alias("finds"))


@query("whole_read_search", "SELECT fid, CASE WHEN strpos(b1, 'GATC') > 0 THEN 0 WHEN strpos(b2, 'GATC') > 0 THEN 1 END AS file, CAST((64 - length(replace(b1, 'GATC', '')) - length(replace(b2, 'GATC', ''))) / 4 AS BIGINT) AS finds FROM r")
def whole_read_search(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={GATC}"])
    return d.matched().select("fid", F.col("hit_g.file").alias("file"), F.size("acc_g").cast("long").alias("finds"))


_T4 = ["ACGT", "TGCA", "CTAG"]


@query("nearest_delta", f"""SELECT fid, CASE WHEN c2 IS NULL OR c2 >= c1 + 1 THEN t1 END AS tag, finds FROM (
  SELECT fid, list_sort(list_filter([{', '.join(f"CASE WHEN hamming(substr(b1, 1, 4), '{t}') <= 2 THEN hamming(substr(b1, 1, 4), '{t}') * 100 + {i} END" for i, t in enumerate(_T4))}], lambda x: x IS NOT NULL)) AS m,
         m[1] // 100 AS c1, m[2] // 100 AS c2, m[1] % 100 AS t1, len(m) AS finds FROM r)""")
def nearest_delta(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={" + ",".join(_T4) + "}", "g::loc=0:0:4,anchor=5p,dist=2,mode=nearest,delta=1"])
    return d.matched().select("fid", F.col("hit_g.tag_idx").cast("long").alias("tag"), F.size("acc_g").cast("long").alias("finds"))


_COUNTS = "CAST((32 - length(replace(b1, 'ACG', ''))) / 3 AS BIGINT) AS na, CAST((32 - length(replace(b1, 'TTC', ''))) / 3 AS BIGINT) AS nt"


@query("find_limits", f"""SELECT fid, CASE WHEN na + nt < 1 THEN 'min_finds_per_group' WHEN na + nt > 3 THEN 'max_finds_per_group' WHEN na > 1 OR nt > 1 THEN 'max_finds_per_tag' END AS failed,
  CASE WHEN na + nt < 1 THEN na + nt WHEN na + nt > 3 THEN na + nt WHEN na > 1 THEN na WHEN nt > 1 THEN nt END AS found,
  CASE WHEN na + nt BETWEEN 1 AND 3 AND na <= 1 AND nt <= 1 THEN 'assigned' ELSE 'unassigned' END AS disposition FROM (SELECT fid, {_COUNTS} FROM r)""")
def find_limits(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={ACG,TTC}", "g::loc=0:0,minFindsPerGroup=1,maxFindsPerGroup=3,maxFindsPerTag=1"], samples=["s=g"])
    return d.routed().select("fid", F.col("failure.constraint").alias("failed"), F.col("failure.found").cast("long").alias("found"), "disposition")


@query("prev_gate", "SELECT fid, CASE WHEN substr(b1, 1, 1) = 'A' AND substr(b1, 3, 2) = 'CG' THEN 2 END AS start FROM r")
def prev_gate(spark, sf_dir):
    d = run(spark, sf_dir, groups=["a={A}", "a::loc=0:0:1,anchor=5p", "b={CG}", "b::loc=0:2:4,anchor=5p,prev=a"])
    return d.matched().select("fid", F.col("hit_b.start").alias("start"))


@query("next_window", "SELECT fid, CASE WHEN substr(b1, 1, 1) = 'A' AND strpos(substr(b1, 4, 12), 'CAG') > 0 THEN strpos(substr(b1, 4, 12), 'CAG') + 2 END AS start FROM r")
def next_window(spark, sf_dir):
    d = run(spark, sf_dir, groups=["a={A}", "a::loc=0:0:1,anchor=5p,next=b:2-14", "b={CAG}"])
    return d.matched().select("fid", F.col("hit_b.start").cast("long").alias("start"))


@query("match_joined", "SELECT fid, CASE substr(b1, 1, 2) || substr(b2, 1, 1) WHEN 'ACG' THEN 0 WHEN 'TTA' THEN 1 END AS tag FROM r")
def match_joined(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={ACG,TTA}", "g::match=a+b"], extracts=["a=0:0:2", "b=1:0:1"])
    return d.matched().select("fid", F.col("hit_g.tag_idx").alias("tag"))


@query("anchored_offsets", """SELECT fid, CASE WHEN p > 0 THEN substr(b1, p + 5, 6) END AS after, CASE WHEN p > 0 THEN substr(b1, greatest(p - 5, 1), least(p - 1, 5)) END AS before,
  CASE WHEN p > 0 THEN substr(b1, p + 3, 32) END AS rest, CASE WHEN p > 0 AND z > 0 AND z >= p + 3 THEN substr(b1, p + 3, z - p - 3) WHEN p > 0 AND z > 0 THEN 'x' ELSE '' END AS between_ FROM (
  SELECT fid, b1, strpos(substr(b1, 1, 12), 'GCA') AS p, CASE WHEN strpos(substr(b1, 16, 17), 'TAG') > 0 THEN strpos(substr(b1, 16, 17), 'TAG') + 15 ELSE 0 END AS z FROM r)""")
def anchored_offsets(spark, sf_dir):
    d = run(spark, sf_dir, groups=["p={GCA}", "p::loc=0:0:12", "z={TAG}", "z::loc=0:15:end"], extracts=["after=@p+2:6", "before=@p-0:5", "rest=@p+0:end", "mid=@p..@z"])
    return d.extracted().select("fid", "s_after.bases", "s_before.bases", "s_rest.bases", "s_mid.bases").toDF("fid", "after", "before", "rest", "between_")


_AT1 = "substr(b1, 1, 1)"
_AT2 = "substr(b2, 1, 1)"
_INDEX = {"groups": ["i={A,C,G,T}", "i::loc=0:0:1,anchor=5p", "j={A,C,G}", "j::loc=1:0:1,anchor=5p"]}


@query("route_samples", f"SELECT fid, CASE WHEN {_AT1} IN ('A', 'C') AND {_AT2} = 'A' THEN 's1' WHEN {_AT1} = 'G' AND {_AT2} IN ('A', 'C', 'G') THEN 's2.lib' WHEN {_AT1} = 'T' THEN 's3' END AS label, CASE WHEN {_AT1} IN ('A', 'C') AND {_AT2} = 'A' OR {_AT1} = 'G' AND {_AT2} <> 'T' OR {_AT1} = 'T' THEN 'assigned' ELSE 'unassigned' END AS disposition FROM r")
def route_samples(spark, sf_dir):
    d = run(spark, sf_dir, **_INDEX, samples=["s1=i::A,C+j::A", "s2::lib=i::G+j", "s3=i::T"])
    label = F.when(F.col("sample").isNotNull(), F.concat_ws(".", "sample", "sub_sample"))
    return d.routed().select("fid", label.alias("label"), "disposition")


@query("remove_first", f"SELECT fid, CASE WHEN {_AT2} = 'C' THEN 'removed' WHEN {_AT1} = 'A' THEN 'assigned' ELSE 'unassigned' END AS disposition, CASE WHEN {_AT2} <> 'C' AND {_AT1} <> 'A' THEN 'no_sample' END AS reason FROM r")
def remove_first(spark, sf_dir):
    return run(spark, sf_dir, **_INDEX, samples=["s=i::A"], remove=["j::C"]).routed().select("fid", "disposition", "reason")


@query("pass_through", f"SELECT fid, CASE WHEN {_AT2} = 'G' THEN 'removed' ELSE 'pass_through' END AS disposition FROM r")
def pass_through(spark, sf_dir):
    return run(spark, sf_dir, **_INDEX, remove=["j::G"]).routed().select("fid", "disposition")


@query("sample_from_group", f"SELECT {_AT1} AS sample, count(*) AS reads FROM r GROUP BY 1")
def sample_from_group(spark, sf_dir):
    return run(spark, sf_dir, **_INDEX, sample_from_group="i").routed().groupBy("sample").agg(F.count("*").alias("reads"))


@query("missing_stream", f"SELECT fid, CASE WHEN {_AT2} = 'T' THEN 'unassigned' ELSE 'assigned' END AS disposition, CASE WHEN {_AT2} = 'T' THEN 'missing_stream' END AS reason FROM r")
def missing_stream(spark, sf_dir):
    d = run(spark, sf_dir, **_INDEX, samples=["s=i"], extracts=["x=@j"], templates=["x"])
    return d.routed().select("fid", "disposition", "reason")


@query("tag_join", "SELECT fid, substr(b1, 1, 4) || '_' || substr(b2, 1, 4) || CASE WHEN substr(b2, 1, 1) <> 'T' THEN '_' || substr(b2, 1, 1) ELSE '' END AS cb, substr(q1, 1, 4) || ' ' || substr(q2, 1, 4) || CASE WHEN substr(b2, 1, 1) <> 'T' THEN ' ' || substr(q2, 1, 1) ELSE '' END AS cy, translate(reverse(substr(b1, 5, 6)), 'ACGT', 'TGCA') AS rx FROM r")
def tag_join(spark, sf_dir):
    d = run(spark, sf_dir, **_INDEX, extracts=["a=0:0:4", "b=1:0:4", "c=@j", "u=0:4:10", "body=0:10:end"], templates=["body"], tags=["CB=a+b+c", "CB::sep=_", "RX=~u", "RX::qual=none"])
    value = lambda t: F.element_at(F.filter("tags", lambda x: x["tag"] == t), 1)["value"]
    return d.records().select("fid", value("CB").alias("cb"), value("CY").alias("cy"), value("RX").alias("rx"))


@query("corrected_and_raw", """SELECT fid, m AS tag, CASE m WHEN 0 THEN 'ACG' WHEN 1 THEN 'TTT' WHEN 2 THEN 'CAA' END AS corrected, CASE WHEN m IS NOT NULL THEN substr(b1, 1, 3) END AS observed, CASE WHEN m IS NOT NULL THEN substr(q1, 1, 3) END AS quals
  FROM (SELECT *, """ + _ham("substr(b1, 1, 3)", _T3, 1) + " % 100 AS m FROM r)")
def corrected_and_raw(spark, sf_dir):
    d = run(spark, sf_dir, groups=["g={" + ",".join(_T3) + "}", "g::loc=0:0:3,anchor=5p,dist=1"], extracts=["x=@g"])
    return d.extracted().select("fid", F.col("hit_g.tag_idx").cast("long").alias("tag"), F.col("c_x.bases").alias("corrected"), F.col("s_x.bases").alias("observed"), F.col("c_x.quals").alias("quals"))


@query("records_by_destination", f"SELECT CASE WHEN {_AT1} = 'A' THEN 's1.R' || k || '.fq' WHEN {_AT1} = 'C' THEN 's2.R' || k || '.fq' ELSE 'un.' || (k - 1) || '.fq' END AS dest, count(*) AS n, CAST(sum(length(CASE WHEN {_AT1} IN ('A', 'C') THEN substr(CASE k WHEN 1 THEN b1 ELSE b2 END, 5) ELSE b1 END)) AS BIGINT) AS bases FROM r, (VALUES (1), (2)) v(k) GROUP BY 1")
def records_by_destination(spark, sf_dir):
    d = run(spark, sf_dir, **_INDEX, samples=["s1=i::A", "s2=i::C"], extracts=["x=0:4:end", "y=1:4:end"], templates=["x", "y"], out="%sample.R%ordinal.fq", unassigned="un.%source.fq")
    return d.records().groupBy("dest").agg(F.count("*").alias("n"), F.sum(F.length("bases")).alias("bases"))


_METRIC = {"samples": ["s1=i::A", "s2::x=i::C", "s3=i::G+j::A,C,G"], "extracts": ["x=0:0:10", "y=0:5:20", "z=1:2:30"], "templates": ["x+z"], "tags": ["RX=y"]}
_METRIC_SQL = f"m AS (SELECT *, CASE WHEN {_AT1} = 'A' THEN 0 WHEN {_AT1} = 'C' THEN 1 WHEN {_AT1} = 'G' AND {_AT2} <> 'T' THEN 2 END AS target FROM r)"


@query("metrics_per_sample", f", {_METRIC_SQL}, t(target, sample, sub_sample) AS (VALUES (0, 's1', NULL), (1, 's2', 'x'), (2, 's3', NULL)) SELECT t.target, 'pool' AS pool, sample, sub_sample, count(m.fid) AS reads, printf('%.6f', count(m.fid) / (SELECT count(*) FROM r)) AS frac_of_pool, printf('%.6f', CASE WHEN count(m.fid) = 0 THEN 0 ELSE 16 / 64 END) AS frac_bases_unextracted FROM t LEFT JOIN m ON m.target = t.target GROUP BY ALL")
def metrics_per_sample(spark, sf_dir):
    return run(spark, sf_dir, **_INDEX, **_METRIC).per_sample()


@query("metrics_summary", f", {_METRIC_SQL} SELECT 'pool' AS pool, count(*) AS total_reads, count(target) AS reads_assigned, 0::BIGINT AS reads_pass_through, count(*) - count(target) AS reads_unassigned, 0::BIGINT AS reads_removed, printf('%.6f', count(target) / count(*)) AS frac_assigned, printf('%.6f', 16 / 64) AS frac_bases_unextracted, '32,32' AS mean_read_len_by_input FROM m")
def metrics_summary(spark, sf_dir):
    return run(spark, sf_dir, **_INDEX, **_METRIC).summary()


@query("zip_two_files", "SELECT fid, b1, b2 FROM r")
def zip_two_files(spark, sf_dir):
    whole = fragments(spark, sf_dir)
    files = [whole.select(F.col("fid").alias("ord"), F.col("reads")[k].alias("read")) for k in range(2)]
    r = F.col("reads")
    return zipped(files).select("fid", r[0]["bases"].alias("b1"), r[1]["bases"].alias("b2"))


@query("interleaved_pairs", "SELECT fid, b1, b2 FROM r")
def interleaved_pairs(spark, sf_dir):
    both = fragments(spark, sf_dir).select("fid", F.posexplode("reads").alias("k", "read"))
    r = F.col("reads")
    return interleaved(both.select((F.col("fid") * 2 + F.col("k")).alias("ord"), "read")).select("fid", r[0]["bases"].alias("b1"), r[1]["bases"].alias("b2"))


@query("name_comments", """WITH e AS (SELECT event_id, 'e' || event_id || '/1' AS name, 'XI:i:' || event_id || chr(9) || 'bad' || chr(9) || 'XZ:Z:' || event_type || chr(9) || 'XF:f:1.5' AS comment FROM events)
SELECT event_id, regexp_replace(name, '/[12]$', '') AS mate, array_to_string(list_filter(string_split(comment, chr(9)), lambda x: x <> 'bad'), chr(9)) AS tags FROM e""")
def name_comments(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.col("event_id").cast("string")
    head = F.concat(F.lit("e"), key, F.lit("/1 XI:i:"), key, F.lit("\tbad\tXZ:Z:"), F.col("event_type"), F.lit("\tXF:f:1.5"))
    comment = F.regexp_replace(head, "^[^ ]* ", "")
    return e.select("event_id", seq.mate_key(seq.first_token(head)).alias("mate"), seq.render_tags(seq.comment_tags(comment)).alias("tags"))


@query("lockstep_conversations", "WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, max(CASE WHEN k = 1 THEN substr(text, 1, 12) END) AS first, max(CASE WHEN k = 2 THEN right(text, 6) END) AS second, count(*) AS reads FROM c GROUP BY 1")
def lockstep_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    read = F.struct(F.col("role").alias("name"), F.col("text").alias("bases"), F.lit(None).cast("string").alias("quals"), F.array().cast(f"array<{seq.TAG}>").alias("tags")).cast(seq.READ)
    own = turns.groupBy(F.col("conv_id").alias("fid")).agg(F.array_sort(F.collect_list(F.struct("turn", read.alias("read")))).alias("t")).select("fid", F.transform("t", lambda x: x["read"]).alias("reads"))
    found = extract(own, parse(extracts=["a=0:0:12", "b=1:-6:end"]))
    return found.select(F.col("fid").alias("conv_id"), F.col("s_a.bases").alias("first"), F.col("s_b.bases").alias("second"), F.size("reads").cast("long").alias("reads"))


@query("qc_json", f"""SELECT fid, '{{"v":1,"outcome":' || CASE WHEN {_AT1} = 'A' THEN '"assigned","sample":"s1","sub_sample":"lib",' ELSE '"unassigned","reason":"no_sample",' END || '"groups":[{{"g":"i","tag":"' || {_AT1} || '","loc":"0:0:1","obs":"' || {_AT1} || '","sub":0,"ind":0}}' || CASE WHEN {_AT2} <> 'T' THEN ',{{"g":"j","tag":"' || {_AT2} || '","loc":"1:0:1","obs":"' || {_AT2} || '","sub":0,"ind":0}}' ELSE '' END || ']}}' AS qc FROM r""")
def qc_json_query(spark, sf_dir):
    from readroute.operators.qc import qc_json

    d = run(spark, sf_dir, **_INDEX, samples=["s1::lib=i::A"], qc_tag="ZS")
    return d.routed().select("fid", qc_json(d.spec).alias("qc"))


from readroute import edit_queries, file_queries, run_queries  # noqa: E402  they add to the registry

__all__ = ["ORACLES", "QUERIES", "edit_queries", "file_queries", "run_queries"]
