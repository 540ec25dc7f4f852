"""Gzip by content and by ranges, and files read in step."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from readroute.sources import bgzf, lockstep
from readroute.sources import reads as rd


def packed(text, size=500):
    return b"".join(bgzf.member(text[k : k + size]) for k in range(0, len(text), size)) + bgzf.END


@pytest.fixture
def text():
    rng = random.Random(1)
    return b"".join(bytes(rng.choice(b"ACGTxyz ") for _ in range(rng.choice([0, 3, 40, 700]))) + b"\n" for _ in range(800))


@pytest.mark.parametrize("end", [b"", b"last without a break", b"\n\n"])
@pytest.mark.parametrize("size", [1, 37, 4000, 1 << 20])
def test_ranges_have_each_line_once(tmp_path, text, end, size):
    text = text[: 400 if size < 30 else 9000 if size < 100 else None] + end
    want = text.split(b"\n")
    want = want[:-1] if not want[-1] else want
    for name, data in (("a.txt", text), ("a.gz", packed(text))):
        path = str(tmp_path / name)
        open(path, "wb").write(data)
        parts = bgzf.ranges(path, size)
        assert [x for p in parts for x in bgzf.range_lines(p)] == want
        counts = [bgzf.count_lines(p) for p in parts]
        assert counts == [len([*bgzf.range_lines(p)]) for p in parts]
        some = random.Random(size).sample(range(len(parts)), min(40, len(parts)))
        for k in some:
            assert [x for own in bgzf.line_lists(parts[k], on=True) for x in own] == want[sum(counts[:k]) :]
    assert gzip.decompress(packed(text)) == text and (size > 30 or len(parts) > 100)


def test_gzip_by_content(spark, tmp_path, text):
    body = "".join(f"@r{k}\nACGT\n+\nIIII\n" for k in range(300)).encode()
    want = [f"r{k}" for k in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        for name, data in (("plain", gzip.compress(body)), ("two", gzip.compress(body[:4000]) + gzip.compress(body[4000:])), ("blocks", packed(body)), ("blocks.fq.gz", packed(body)), ("one.fq.gz", gzip.compress(body))):
            path = tmp_path / name
            path.write_bytes(data)
            fragments, _, kinds = rd.open_fragments(spark, [str(path)])
            assert kinds == ["fastq"] and [r[0] for r in fragments.orderBy("fid").select(F.col("reads")[0]["name"]).collect()] == want
            if "blocks" in name:
                assert bgzf.gzip_lines(spark, [str(path)]).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "cut").write_bytes(gzip.compress(body)[:-9])
    with pytest.raises(Exception, match="end too soon"):
        rd.open_fragments(spark, [str(tmp_path / "cut")])[0].collect()


def test_written_lines(spark, tmp_path):
    lines = spark.range(0, 20_000, 1, 5).selectExpr("concat('line ', id, repeat('x', id % 90)) as value")
    folder = str(tmp_path / "out")
    bgzf.write_lines(lines, folder)
    files = sorted(str(x) for x in (tmp_path / "out").iterdir())
    assert len(files) == 5 and all(x.endswith(".gz") for x in files)
    whole = b"".join(gzip.open(x).read() for x in files).decode().split("\n")[:-1]
    assert whole == [r.value for r in lines.collect()]
    assert sorted(r.value for r in spark.read.text(folder).collect()) == sorted(whole)
    bad = spark.range(0, 10, 1, 2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("value"))
    with pytest.raises(Exception, match="no"):
        bgzf.write_lines(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not [x for x in (tmp_path / "bad").iterdir() if not x.name.startswith("_")]


def fastq(names, rng, comment=""):
    out = []
    for n in names:
        size = rng.choice([0, 1, 50])
        out.append(f"@{n}{comment}\n{'A' * size}\n+\n{'I' * size}\n")
    return "".join(out)


@pytest.mark.parametrize("size", ["500b", "128m"])
def test_files_in_step_have_no_shuffle(spark, tmp_path, size):
    rng = random.Random(2)
    names = [f"n{k}" for k in range(200)]
    one, two, both = (tmp_path / x for x in ("1.fq", "2.fq", "b.fq"))
    one.write_text(fastq([f"{n}/1" for n in names], rng))
    two.write_bytes(packed(fastq([f"{n}/2" for n in names], rng, " a longer comment").replace("\n", "\r\n").encode()))
    both.write_text(fastq([f"{n}/{k}" for n in names for k in (1, 2)], rng) + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for paths in ([str(one), str(two)], [str(both)]):
            fragments, files, _ = rd.open_fragments(spark, paths)
            assert files == 2 and "Exchange" not in fragments._jdf.queryExecution().executedPlan().toString()
            rows = fragments.orderBy("fid").select("fid", F.col("reads")[0]["name"].alias("a"), F.col("reads")[1]["name"].alias("b")).collect()
            assert [(r.fid, r.a, r.b) for r in rows] == [(k, f"{n}/1", f"{n}/2") for k, n in enumerate(names)]
        for text, why in (((one.read_text().rsplit("@", 1)[0]), "fewer records"), (one.read_text().replace("n150/", "m/"), "names differ"), (one.read_text() + "@n/1\nA\n+\nI\n", "fewer records"), (one.read_text().replace("@n9/", "n9/"), "broken record")):
            (tmp_path / "bad.fq").write_text(text)
            with pytest.raises(Exception, match=why):
                rd.open_fragments(spark, [str(tmp_path / "bad.fq"), str(two)])[0].collect()
        (tmp_path / "odd.fq").write_text("@a/1\nA\n+\nI\n@a/2\nA\n+\nI\n@b/1\nA\n+\nI\n")
        with pytest.raises(Exception, match="mate is missing"):
            rd.open_fragments(spark, [str(tmp_path / "odd.fq")])[0].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_folders_of_parts_in_step(spark, tmp_path):
    rng = random.Random(3)
    for side in "12":
        (tmp_path / side).mkdir()
        text = fastq([f"n{k}/{side}" for k in range(90)], rng)
        cuts = [0, *sorted(rng.sample([k for k, c in enumerate(text) if text[k - 1] == "\n" and k], 4)), len(text)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / side / f"part-{k}.txt").write_text(text[a:b])
    found = lockstep.lockstep(spark, [rd._files(spark, str(tmp_path / s)) for s in "12"], size=200)
    assert [(r.a, r.b) for r in found.orderBy("fid").selectExpr("r0.head as a", "r1.head as b").collect()] == [(f"@n{k}/1", f"@n{k}/2") for k in range(90)]


def test_other_gzip_is_joined(spark, tmp_path):
    for side in "12":
        with gzip.open(tmp_path / f"{side}.fq.gz", "wt") as f:
            f.write("".join(f"@n{k}/{side}\nAC\n+\nII\n" for k in range(20)))
    assert lockstep.lockstep(spark, [[str(tmp_path / "1.fq.gz")]]) is None
    rows = rd.open_fragments(spark, [str(tmp_path / f"{s}.fq.gz") for s in "12"])[0].collect()
    assert len(rows) == 20 and all(len(r.reads) == 2 for r in rows)
