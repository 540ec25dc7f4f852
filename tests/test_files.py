import gzip

import pytest
from pyspark.sql import functions as F

from readroute.plans.analyze import analyze
from readroute.plans.demux import Demux
from readroute.plans.spec import parse
from readroute.sources import reads as rd
from readroute.sources import sinks
from readroute.streaming.routing import route_stream


def fq(*records):
    return "".join(f"@{n}\n{b}\n+\n{q}\n" for n, b, q in records)


def write(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def rows(df):
    return [[(r.name, r.bases, r.quals, [tuple(t) for t in r.tags or []]) for r in x.reads] for x in df.orderBy("fid").collect()]


def test_fastq_plain_gzip_and_many_blocks(spark, tmp_path):
    records = [(f"r{i} CB:Z:AC\tbad\tXI:i:{i}", "ACGT" * (i % 5 + 1), "IJKL" * (i % 5 + 1)) for i in range(400)]
    want = [[(f"r{i}", b, q, [("CB", "Z", "AC"), ("XI", "i", str(i))])] for i, (_, b, q) in enumerate(records)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, block in (("a.fq", "1000b"), ("b.fq.gz", old)):
        path = write(tmp_path / name, fq(*records))
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            fragments, files, kinds = rd.open_fragments(spark, [path])
            assert rows(fragments) == want and (files, kinds) == (1, ["fastq"])
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fasta_and_sam(spark, tmp_path):
    fa = write(tmp_path / "a.fa", ">x one\nACGT\nAC\n>y\n\nGG\n>z\n")
    assert rows(rd.open_fragments(spark, [fa])[0]) == [[("x", "ACGTAC", None, [])], [("y", "GG", None, [])], [("z", "", None, [])]]
    sam = write(tmp_path / "a.sam", "@HD\tVN:1.6\n" + "".join("\t".join(x) + "\n" for x in [["p", "4", "*", "0", "0", "*", "*", "0", "0", "AACG", "!#IJ", "NM:i:1", "RX:Z:AC"], ["q", "16", "c", "1", "9", "4M", "*", "0", "0", "AACG", "!#IJ"], ["q", "256", "c", "1", "9", "4M", "*", "0", "0", "A", "I"], ["s", "0", "c", "1", "9", "4M", "*", "0", "0", "A", "*"]]))
    assert rows(rd.open_fragments(spark, [sam])[0]) == [[("p", "AACG", "!#IJ", [("RX", "Z", "AC")])], [("q", "CGTT", "JI#!", [])], [("s", "A", None, [])]]
    with pytest.raises(ValueError, match="FASTA"):
        rd.open_fragments(spark, [fa, sam])


def test_pairs(spark, tmp_path):
    one = write(tmp_path / "1.fq", fq(("a/1", "A", "I"), ("b/1", "C", "I")))
    two = write(tmp_path / "2.fq", fq(("a/2", "G", "I"), ("b/2", "T", "I")))
    short, other = write(tmp_path / "3.fq", fq(("a/2", "G", "I"))), write(tmp_path / "4.fq", fq(("a/2", "G", "I"), ("zz/2", "T", "I")))
    assert [[r[1] for r in x] for x in rows(rd.open_fragments(spark, [one, two])[0])] == [["A", "G"], ["C", "T"]]
    for bad, why in ((short, "fewer records"), (other, "names differ")):
        with pytest.raises(Exception, match=why):
            rd.open_fragments(spark, [one, bad])[0].collect()
    both = write(tmp_path / "5.fq", fq(("a/1", "A", "I"), ("a/2", "G", "I"), ("b/1", "C", "I"), ("b/2", "T", "I")))
    fragments, files, _ = rd.open_fragments(spark, [both])
    assert files == 2 and [[r[1] for r in x] for x in rows(fragments)] == [["A", "G"], ["C", "T"]]
    assert rd.open_fragments(spark, [both], per_record=True)[1] == 1
    odd = write(tmp_path / "6.fq", fq(("a/1", "A", "I"), ("a/2", "G", "I"), ("b/1", "C", "I")))
    with pytest.raises(Exception, match="mate"):
        rd.open_fragments(spark, [odd])[0].collect()
    with pytest.raises(ValueError, match="second mate"):
        rd.open_fragments(spark, [two])


def test_broken_and_empty(spark, tmp_path):
    with pytest.raises(Exception, match="broken record"):
        rd.open_fragments(spark, [write(tmp_path / "x.fq", "@a\nACG\n+\nII\n")])[0].collect()
    with pytest.raises(ValueError, match="neither"):
        rd.sniff(spark, write(tmp_path / "x.txt", "hello\n"))
    empty = write(tmp_path / "e.fq", "")
    fragments, files, kinds = rd.open_fragments(spark, [empty])
    assert fragments.count() == 0 and files == 1
    d = Demux(fragments, analyze(parse(groups=["g={a=AC}"], samples=["s=g"])), 1)
    assert d.records().count() == 0 and d.summary().first().total_reads == 0
    assert [(r.sample, r.reads, r.frac_of_pool) for r in d.per_sample().collect()] == [("s", 0, "0.000000")]


def test_sinks(spark, tmp_path):
    path = write(tmp_path / "r.fq", fq(*[(f"r{i}", "ACGT"[i % 4] + "GGGG", "IABCD") for i in range(20)]))
    fragments, files, kinds = rd.open_fragments(spark, [path])
    spec = analyze(parse(groups=["g={A,C}", "g::loc=0:0:1,anchor=5p"], samples=["s1=g::A", "s2::l=g::C"], extracts=["x=0:1:end", "b=@g"], templates=["x"], tags=["BC=b"], out="%sample.fq", unassigned="un.fq", rg_tags=["PL=X"]))
    run = Demux(fragments, spec, files)
    records = run.records()
    assert sinks.output_format("a.fq.gz") == "fastq" and sinks.output_format("-", kinds) == "fastq" and sinks.output_format("-", ["fastq", "sam"]) == "sam"
    for kind in ("fastq", "fasta", "sam"):
        out = str(tmp_path / kind)
        sinks.write(records, out, kind, run.headers("1", "cmd") if kind == "sam" else None)
        text = {d: "\n".join(r.value for r in spark.read.text(f"{out}/dest={d}").collect()) for d in ("s1.fq", "s2.fq", "un.fq")}
        if kind == "fastq":
            assert text["s1.fq"].startswith("@r0\tBC:Z:A\tQT:Z:I\nGGGG\n+\nABCD\n@r4\t") and text["un.fq"].count("@r") == 10
        elif kind == "fasta":
            assert text["s2.fq"].startswith(">r1\tBC:Z:C\tQT:Z:I\nGGGG\n>r5")
        else:
            assert text["s1.fq"].count("@HD") == 1 and text["s1.fq"].startswith("@HD\tVN:1.6")
            for dest, group in (("s1", "ID:s1\tSM:s1"), ("s2", "ID:s2.l\tSM:s2\tLB:l"), ("un", "ID:pool\tSM:pool\tLB:pool")):
                assert [x for x in text[f"{dest}.fq"].split("\n") if x.startswith("@RG")] == [f"@RG\t{group}\tPL:X"]
                own = {x.rsplit("RG:Z:", 1)[1] for x in text[f"{dest}.fq"].split("\n") if not x.startswith("@")}
                assert own == {group.split("\t")[0].removeprefix("ID:")}
            assert "r1\t4\t*\t0\t0\t*\t*\t0\t0\tGGGG\tABCD\tBC:Z:C\tQT:Z:I\tRG:Z:s2.l" in text["s2.fq"]


def test_stream(spark, tmp_path):
    one = rd.from_columns(spark.range(40).withColumn("b", F.when(F.col("id") % 2 == 0, "ACC").otherwise("GCC")), F.col("id"), (F.lit("n"), F.col("b"), F.lit("III")))
    one.repartition(2).write.parquet(str(tmp_path / "in"))
    spec = analyze(parse(groups=["g={A}", "g::loc=0:0:1,anchor=5p"], samples=["s=g"], out="%sample", unassigned="un"))
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = route_stream(stream, spec, 1, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out/batch=*"))
    assert {r.dest: r["count"] for r in found.groupBy("dest").count().collect()} == {"s": 20, "un": 20}


def test_stream_of_fastq_with_reports(spark, tmp_path):
    """A stream that is stopped and goes on, with a batch run twice: records and reports are those of one run."""
    from readroute.streaming.routing import fastq_stream, reports

    spec = analyze(parse(groups=["g={a=A,c=C,t=T}", "g::loc=0:0:1,anchor=5p"], sample_from_group="g", extracts=["x=0:1:end", "y=1:0:end"], templates=["x", "y"], out="%sample.R%ordinal.fq", unassigned="un.fq"))
    pairs = [(f"r{k}/{m}", "ACG"[k % 3] + "GGT", "IIII") for k in range(90) for m in (1, 2)]
    (tmp_path / "in").mkdir()
    out, totals = str(tmp_path / "out"), str(tmp_path / "totals")

    def go():
        stream = fastq_stream(spark, str(tmp_path / "in"), per=2, files_at_once=2)
        writer = route_stream(stream, spec, 2, out, text=True, totals=totals)
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    for k in range(0, 6):
        write(tmp_path / "in" / f"{k}.fq{'.gz' * (k % 2)}", fq(*pairs[30 * k : 30 * k + 30]))
        if k == 2:
            go()
    go()
    # the last batch once more, as after a failure before its commit
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    per_sample, summary = reports(spark, totals, spec, 2)
    whole = write(tmp_path / "all.fq", fq(*pairs))
    fragments, files, kinds = rd.open_fragments(spark, [whole])
    d = Demux(fragments, spec, files, 1, kinds)
    assert [tuple(r) for r in per_sample.orderBy("target").collect()] == [tuple(r) for r in d.per_sample().orderBy("target").collect()]
    assert summary.first() == d.summary().first()
    for dest in d.destinations():
        want = sorted(r.line for r in sinks.lines(d.records().filter(F.col("dest") == dest), "fastq").collect())
        got = "".join(r.value for x in sorted((tmp_path / "out").glob(f"batch=*/dest={dest}")) for r in spark.read.text(str(x), wholetext=True).collect())
        lines = got.split("\n")[:-1]
        assert sorted("\n".join(lines[k : k + 4]) for k in range(0, len(lines), 4)) == want


def test_command_line(spark, tmp_path, capsys):
    from readroute.cli import main

    path = write(tmp_path / "lib1.fq", fq(("a", "ACCC", "IIII"), ("b", "GCCC", "IIII")))
    tags = write(tmp_path / "tags.tsv", "id\tseq\nt1\tA\n")
    argv = [path, "--group", f"g={tags}", "--group", "g::loc=0:0:1,anchor=5p", "--sample-from-group", "g", "--out", str(tmp_path / "out"), "--pattern", "%pool.%sample.fq", "--unassigned", "un.fq", "--metrics-per-sample", str(tmp_path / "m"), "--metrics-summary", str(tmp_path / "s")]
    assert main(argv, spark) == 0
    assert "@a\n" in spark.read.text(f"{tmp_path}/out/dest=lib1.t1.fq", wholetext=True).first()[0]
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "m")).first().sample == "t1"
    assert main([path, "--group", "g={A}", "--sample", "s=zz"], spark) == 1
    assert "error:" in capsys.readouterr().err


def test_exit_codes(spark, tmp_path, monkeypatch, capsys):
    import io

    from readroute.cli import main

    path = write(tmp_path / "r.fq", fq(("a", "ACCC", "IIII")))
    assert main(["--version"], spark) == 0 and "readroute" in capsys.readouterr().out
    assert main(["--help"], spark) == 0 and "--extract" in capsys.readouterr().out
    assert main([path, "--sample", "s=g::a", "--sample-sheet", "none.tsv"], spark) == 2
    assert main([path, "--unknown"], spark) == 2
    assert main([str(tmp_path / "missing.fq"), "--extract", "x=0:0:end"], spark) == 1
    assert "failed to open" in capsys.readouterr().err
    assert main([path, "--rg-tag", "SM=foo"], spark) == 1 and "may not set" in capsys.readouterr().err
    assert main([path, "--rg-tag", "LONG=foo"], spark) == 1
    monkeypatch.setattr("sys.stdin", type("S", (), {"buffer": io.BytesIO(b"@a\nAC\n+\nII\n")})())
    assert main(["--extract", "x=0:1:end", "--template", "x"], spark) == 0
    assert capsys.readouterr().out == "@a\nC\n+\nI\n"


def test_standard_input_and_output(spark, tmp_path, monkeypatch, capsys):
    import io

    from readroute.cli import main

    text = fq(("a", "ACCC", "IIII"), ("b", "GCCC", "IIII")).encode()
    for data in (text, gzip.compress(text)):
        monkeypatch.setattr("sys.stdin", type("S", (), {"buffer": io.BytesIO(data)})())
        assert main(["-", "--extract", "x=0:1:end", "--template", "x", "--pool", "p"], spark) == 0
        assert capsys.readouterr().out == "@a\nCCC\n+\nIII\n@b\nCCC\n+\nIII\n"
    assert main(["-", "-"], spark) == 1
    monkeypatch.setattr("sys.stdin", type("S", (), {"buffer": io.BytesIO(b"")})())
    assert main(["-"], spark) == 0


def test_declared_destinations_exist(spark, tmp_path):
    path = write(tmp_path / "r.fq", fq(("a", "GCCC", "IIII")))
    fragments, files, kinds = rd.open_fragments(spark, [path])
    spec = analyze(parse(groups=["g={A,C}", "g::loc=0:0:1,anchor=5p"], samples=["s1=g::A", "s2=g::C"], out="%sample%2Dx.sam", unassigned="un/%source.fq.gz"))
    run = Demux(fragments, spec, files, 1, kinds)
    assert run.destinations() == ["s1-x.sam", "s2-x.sam", "un/0.fq.gz"]
    sinks.write(run.records(), str(tmp_path / "out"), None, run.headers("1", "cmd"), run.destinations())
    for d in ("s1-x.sam", "s2-x.sam"):
        assert [r.value[:3] for r in spark.read.text(f"{tmp_path}/out/{sinks.folder_name(d)}").collect()] == ["@HD", "@PG", "@RG"]
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/dest=un%2F0.fq.gz").collect()] == ["@a", "GCCC", "+", "IIII"]
    nothing = Demux(fragments.limit(0), spec, files, 1, kinds)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    sinks.write(nothing.records(), str(tmp_path / "none"), None, None, nothing.destinations())
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 6
    assert spark.read.text(f"{tmp_path}/none/dest=un%2F0.fq.gz").count() == 0 and (tmp_path / "none" / "dest=s1-x.sam").is_dir()


def test_patterns():
    from readroute.plans.spec import SpecError, pattern_parts

    assert pattern_parts("a%20%sub_sample%sample.fq", ["sample", "sub_sample"]) == (("a", False), (" ", False), ("sub_sample", True), ("sample", True), (".fq", False))
    for bad in ("", "a%foo", "%", "%source"):
        with pytest.raises(SpecError):
            pattern_parts(bad, ["pool"])


def test_ordinal_is_needed(spark):
    two = rd.from_columns(spark.range(3), F.col("id"), *[(F.lit(f"n/{k}"), F.lit("ACGT"), F.lit("IIII")) for k in (1, 2)])
    spec = lambda out: analyze(parse(extracts=["x=0:0:2", "y=1:0:2"], templates=["x", "y"], out=out))
    from readroute.plans.spec import SpecError

    with pytest.raises(SpecError, match="ordinal"):
        Demux(two, spec("a.fq"), 2).records()
    assert {r.dest for r in Demux(two, spec("a.%ordinal.fq"), 2).records().collect()} == {"a.1.fq", "a.2.fq"}
    pair = Demux(two, spec("a%ordinal.sam"), 2)
    assert {(r.dest, r.mates) for r in pair.records().collect()} == {("a.sam", 2)} and pair.destinations() == ["a.sam"]


def test_fastq_records_at_the_ends_of_blocks(spark, tmp_path):
    path = write(tmp_path / "e.fq", fq(*[(f"r{i}", "ACGT"[: i % 4 + 1], "@+@I"[: i % 4 + 1]) for i in range(300)]) + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for block in ("37b", "200b", "4000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            rows = rd.fastq(spark, path).orderBy("ord").collect()
            assert [(r.ord, r.read.name, r.read.bases) for r in rows] == [(i, f"r{i}", "ACGT"[: i % 4 + 1]) for i in range(300)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_doubts_and_near_tags():
    import random

    from readroute.plans.analyze import near_pairs, tag_distance

    says = analyze(parse(groups=["g={ACGTACGT}", "g::loc=0:0:4,anchor=5p"], extracts=["x=0:0:2"])).warnings
    assert any("extract x" in w for w in says) and any("group g decides nothing" in w for w in says) and any("longer than its window" in w for w in says) and any("no sample" in w for w in says)
    rng = random.Random(3)
    seqs = list({"".join(rng.choice("ACGT" if rng.random() < 0.98 else "NRY") for _ in range(8)) for _ in range(400)})
    for most in (0, 2, 4, 8):
        want = {(i, j, d) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if (d := tag_distance(seqs[i], seqs[j])) <= most}
        assert set(near_pairs(seqs, most)) == want
