"""BAM records: laid out, read by ranges and written by destination."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from readroute.plans.analyze import analyze
from readroute.plans.demux import Demux
from readroute.plans.spec import parse
from readroute.sources import bam, bgzf, sinks
from readroute.sources import reads as rd


def packed(data, size):
    return b"".join(bgzf.member(data[k : k + size]) for k in range(0, len(data), size)) + bgzf.END


TAGS = [("RX", "Z", "ACGT-TT"), ("XA", "A", "q"), ("NM", "i", "-7"), ("XB", "B", "s,1,-2,3"), ("XF", "f", "1.5"), ("XU", "i", str(3_000_000_000)), ("XH", "H", "1AE3"), ("XG", "B", "f,0.5,2")]


def test_records_round_trip():
    rng = random.Random(1)
    for k in range(300):
        bases = "".join(rng.choice("ACGTNRYKM=") for _ in range(k % 40))
        quals = "".join(chr(33 + rng.randrange(60)) for _ in bases) if k % 3 and bases else None
        tags = [dict(zip(("tag", "type", "value"), t)) for t in rng.sample(TAGS, k % 9)]
        made = bam.encode(f"r{k}", 77, bases, quals, tags)
        assert struct.unpack_from("<i", made)[0] == len(made) - 4
        assert bam.decode(made[4:]) == (f"r{k}", 77, bases, quals, tags)
    assert bam.decode(bam.encode("x", 4, "acgu?", "IIIII", [])[4:])[2] == "ACGTN"


@pytest.mark.parametrize("member", [40, 700, 65000])
def test_each_record_is_in_one_range(tmp_path, member):
    rng = random.Random(member)
    refs = b"".join(struct.pack("<i", 5) + b"chr%d\0" % k + struct.pack("<i", 1000) for k in range(3))
    made = [bam.encode(f"read.{k}", rng.choice([4, 16, 256]), "ACGTTTGA" * rng.randrange(rng.choice([3, 60])), None, [{"tag": "RX", "type": "Z", "value": "A" * rng.randrange(40)}]) for k in range(500)]
    data = b"BAM\x01" + struct.pack("<i", 9) + b"@HD\tVN:1\n" + struct.pack("<i", 3) + refs + b"".join(made)
    path = str(tmp_path / "a.bam")
    for end in (b"", bgzf.END):
        open(path, "wb").write(packed(data, member)[: None if end else -28])
        assert gzip.open(path).read() == data
        for size in (300, 5000, 1 << 20):
            parts = bgzf.ranges(path, size)
            n_ref = bam.read_header(t for _, t in bgzf.members(path, 0, 1))[1]
            assert [r for p in parts for r in bam.record_bytes(p, n_ref)] == [m[4:] for m in made], (member, size)
    open(path, "wb").write(packed(data[:-5], member))
    with pytest.raises(ValueError, match="cut"):
        [r for p in bgzf.ranges(path, 1 << 20) for r in bam.record_bytes(p, 3)]


def test_read_and_written_by_destination(spark, tmp_path):
    fq = "".join(f"@r{k} XI:i:{k}\n{'ACGT'[k % 4]}GGGGN\n+\nI!JKLM\n" for k in range(400))
    (tmp_path / "r.fq").write_text(fq)
    fragments, files, kinds = rd.open_fragments(spark, [str(tmp_path / "r.fq")])
    spec = analyze(parse(groups=["g={A,C,G}", "g::loc=0:0:1,anchor=5p"], samples=["s1=g::A", "s2::l=g::C"], out="%sample.bam", unassigned="un.bam"))
    d = Demux(fragments, spec, files, 1, kinds)
    assert d.kind == "bam"
    sinks.write(d.records(), str(tmp_path / "out"), None, d.headers("1", "cmd"), d.destinations())
    for dest, rest in (("s1", [0]), ("s2", [1]), ("un", [2, 3])):
        folder = str(tmp_path / "out" / f"dest={dest}.bam")
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        try:
            back, n, kind = rd.open_fragments(spark, [folder])
            rows = [r.reads[0] for r in back.orderBy("fid").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert kind == ["bam"] and n == 1
        assert [r.name for r in rows] == [f"r{k}" for k in range(400) if k % 4 in rest]
        group = {"s1": "s1", "s2": "s2.l", "un": "pool"}[dest]
        assert all(r.bases[1:] == "GGGGN" and r.quals == "I!JKLM" and [tuple(t) for t in r.tags] == [("XI", "i", r.name[1:]), ("RG", "Z", group)] for r in rows)
        text = gzip.open(sorted((tmp_path / "out" / f"dest={dest}.bam").glob("*.bam"))[0]).read()
        assert text[:4] == b"BAM\x01" and text.count(b"@RG\t") == 1 and f"@RG\tID:{group}\t".encode() in text
    none = Demux(fragments.limit(0), spec, files, 1, kinds)
    sinks.write(none.records(), str(tmp_path / "none"), None, none.headers("1", "cmd"), none.destinations())
    back, _, kind = rd.open_fragments(spark, [str(tmp_path / "none" / "dest=s1.bam")])
    assert kind == ["bam"] and back.count() == 0
    bad = d.records().withColumn("bases", F.when(F.col("fid") == 333, F.raise_error(F.lit("stop"))).otherwise(F.col("bases")))
    with pytest.raises(Exception, match="stop"):
        sinks.write(bad, str(tmp_path / "bad"), None, d.headers("1", "cmd"), d.destinations())
    assert not [x for x in (tmp_path / "bad").glob("*") if not x.name.startswith("_")]


def test_secondary_and_reversed_records(spark, tmp_path):
    made = [bam.encode(n, f, "AACG", "!#IJ", [{"tag": "NM", "type": "i", "value": "1"}]) for n, f in (("p", 4), ("q", 16), ("q", 256), ("s", 2048))]
    (tmp_path / "x").write_bytes(packed(bam.header_bytes(["@HD\tVN:1.6"]) + b"".join(made), 100))
    rows = [r.reads[0] for r in rd.open_fragments(spark, [str(tmp_path / "x")])[0].orderBy("fid").collect()]
    assert [(r.name, r.bases, r.quals, r.tags) for r in rows] == [("p", "AACG", "!#IJ", []), ("q", "CGTT", "JI#!", [])]
