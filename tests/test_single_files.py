"""One file for each destination: contents in order, headers, empty ones, nothing left by a run that fails."""

import gzip

import pytest
from pyspark.sql import functions as F

from readroute.plans.analyze import analyze
from readroute.plans.demux import Demux
from readroute.plans.spec import parse
from readroute.sources import reads as rd
from readroute.sources.files import write_files


@pytest.fixture
def run(spark, tmp_path):
    path = tmp_path / "r.fq"
    path.write_text("".join(f"@r{k}\n{'ACGT'[k % 4]}GGGG\n+\nIIIII\n" for k in range(500)))

    def make(out, unassigned="un.sam"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        try:
            fragments, files, kinds = rd.open_fragments(spark, [str(path)])
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert fragments.rdd.getNumPartitions() > 4
        return Demux(fragments, analyze(parse(groups=["g={A,C,TTTT}", "g::loc=0:0,anchor=5p"], samples=["s1=g::A", "s2::l=g::C", "none=g::TTTT"], out=out, unassigned=unassigned)), files, 1, kinds)

    return make


@pytest.mark.parametrize("in_order", [True, False])
def test_files(spark, tmp_path, run, in_order):
    for pattern in ("%sample.fq", "deep/%sample.fq.gz", "%sample.sam", "%sample.bam"):
        d, out = run(pattern), tmp_path / pattern.replace("/", "_").replace("%", "")
        records = d.records() if in_order else d.records().repartition(5)
        write_files(records, str(out), d.headers("1", "cmd"), d.destinations(), in_order=in_order)
        files = sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file())
        assert files == sorted(d.destinations())
        for sample, rest in (("s1", 0), ("s2", 1), ("none", None)):
            name = pattern.replace("%sample", sample)
            if "none" in name and "fq" in pattern:
                assert (gzip.open(out / name).read() if name.endswith(".gz") else (out / name).read_bytes()) == b""
                continue
            back = [r.reads[0].name for r in rd.open_fragments(spark, [str(out / name)], per_record=True)[0].orderBy("fid").collect()]
            assert back == [f"r{k}" for k in range(500) if k % 4 == rest], name
            if pattern.endswith("sam"):
                heads = [x for x in (out / name).read_text().split("\n") if x.startswith("@")]
                assert [x[:3] for x in heads] == ["@HD", "@PG", "@RG"] and f"ID:{'s2.l' if sample == 's2' else sample}\t" in heads[2]
        lines = (out / "un.sam").read_text().split("\n")
        assert lines[2].startswith("@RG\tID:pool") and len(lines) == 3 + 250 + 1


def test_order_is_checked_and_nothing_is_left(tmp_path, run):
    d = run("%sample.fq")
    with pytest.raises(ValueError, match="order of partitions"):
        write_files(d.records().repartition(5), str(tmp_path / "a"), d.headers("1", "c"), d.destinations(), in_order=True)
    bad = d.records().withColumn("bases", F.when(F.col("fid") == 333, F.raise_error(F.lit("stop"))).otherwise(F.col("bases")))
    with pytest.raises(Exception, match="stop"):
        write_files(bad, str(tmp_path / "b"), d.headers("1", "c"), d.destinations(), in_order=True)
    for x in "ab":
        assert not [p for p in (tmp_path / x).glob("*") if not p.name.startswith("_")]
    with pytest.raises(ValueError, match="not a file below"):
        write_files(d.records(), str(tmp_path / "c"), {}, ["../x.fq"])
