"""Routing, reports and checks whose plans must not grow with the number of samples and tags."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from readroute.operators import extract, match
from readroute.operators.match import finds_by_tag
from readroute.operators.route import tables
from readroute.plans.analyze import analyze, check_samples, targets
from readroute.plans.demux import Demux
from readroute.plans.spec import Group, Sample, Spec, SpecError, Tag, Term, parse
from readroute.sources.reads import from_columns


def reads_of(spark, rows):
    files = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "fid long, " + ", ".join(f"b{k} string" for k in range(files)))
    return from_columns(df, F.col("fid"), *[(F.concat(F.lit("r"), "fid"), F.col(f"b{k}"), F.repeat(F.lit("I"), F.length(f"b{k}"))) for k in range(files)])


def code(n, size=10):
    return "".join("ACGT"[n >> (2 * k) & 3] for k in range(size))


def test_a_plate_of_1536_samples(spark):
    tags = ",".join(f"t{n}={code(n * 37)}" for n in range(1536))
    spec = analyze(parse(groups=["g={" + tags + "}", "g::loc=0:0:10,anchor=5p"], sample_from_group="g", extracts=["x=@g", "y=0:10:end"], templates=["y"], tags=["CB=x"]))
    d = Demux(reads_of(spark, [(n, code(n * 37) + "ACGT") for n in range(0, 1536, 3)] + [(9999, "A" * 3)]), spec, 1)
    assert {r.fid: r.sample for r in d.routed().select("fid", "sample").collect()} == {n: f"t{n}" for n in range(0, 1536, 3)} | {9999: None}
    report = {r["sample"]: (r.reads, r.frac_of_pool) for r in d.per_sample().collect()}
    assert len(report) == 1536 and report["t3"] == (1, f"{1 / 513:.6f}") and report["t4"] == (0, "0.000000")
    values = {r.fid: r.v for r in d.records().filter("read_group <> 'pool'").select("fid", F.col("tags")[0]["value"].alias("v")).collect()}
    assert values == {n: code(n * 37) for n in range(0, 1536, 3)}


def test_a_hundred_thousand_samples_plan_in_seconds(spark):
    n = 100_000
    tags = tuple(Tag(f"t{k}", code(k, 12)) for k in range(n))
    spec = Spec(groups=(Group("g", tags, loc=(0, 0, 12), anchor="5p"),), samples=tuple(Sample(t.id, None, (Term("g", (t.id,)),)) for t in tags))
    began = time.time()
    check_samples(spec)
    routed = Demux(reads_of(spark, [(k, code(k, 12)) for k in range(0, n, 9999)]), spec, 1)
    plan = routed.routed()
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert {r.fid: r.sample for r in plan.select("fid", "sample").collect()} == {k: f"t{k}" for k in range(0, n, 9999)}
    assert time.time() - began < 60


@pytest.mark.parametrize("rows", [extract.BROADCAST_ROWS, 0])
def test_random_samples_by_trying_each(spark, monkeypatch, rows):
    """Lists of tags, any tag, several groups in any order, overlapping claims: the first declared takes it."""
    monkeypatch.setattr(extract, "BROADCAST_ROWS", rows)
    rng = random.Random(rows)
    groups = tuple(Group(g, tuple(Tag(x, x) for x in "ACGT"), loc=(k, 0, 1), anchor="5p") for k, g in enumerate("ij"))
    for _ in range(6):
        samples = []
        for s in range(rng.randrange(1, 9)):
            chosen = rng.sample("ij", rng.randrange(1, 3))
            samples.append(Sample(f"s{rng.randrange(s + 1)}", rng.choice([None, "x"]), tuple(Term(g, tuple(rng.sample("ACGT", rng.choice([0, 1, 1, 2, 3])))) for g in chosen)))
        spec = Spec(groups=groups, samples=tuple(samples))
        fragments = list(itertools.product("ACGTN", repeat=2))
        d = Demux(reads_of(spark, [(k, *f) for k, f in enumerate(fragments)]), spec, 2)
        got = {r.fid: (r.sample, r.sub_sample) for r in d.routed().select("fid", "sample", "sub_sample").collect()}
        first = {t: n for n, t in enumerate(targets(spec))}
        for k, f in enumerate(fragments):
            met = [first[s.sample, s.sub_sample] for s in samples if all(f["ij".index(t.group)] != "N" and (not t.members or f["ij".index(t.group)] in t.members) for t in s.terms)]
            assert got[k] == (targets(spec)[min(met)] if met else (None, None)), (samples, f)


def test_long_lists_are_one_row():
    tags = tuple(Tag(f"t{k}", code(k, 7)) for k in range(5000))
    groups = tuple(Group(g, tags, loc=(k, 0, 7), anchor="5p") for k, g in enumerate("abc"))
    half = tuple(t.id for t in tags[:2500]), tuple(t.id for t in tags[2500:])
    spec = Spec(groups=groups, samples=(Sample("one", None, tuple(Term(g, half[0]) for g in "abc")), Sample("two", None, (Term("a", half[1]), Term("b", half[0]), Term("c", half[0]))), Sample("any", None, (Term("a", half[1]), Term("b", half[1]), Term("c")))))
    began = time.time()
    check_samples(spec)
    assert sorted(len(t.rows(t.classes())) for t in tables(spec)) == [1, 2] and time.time() - began < 2


def collides(a, b, n):
    if {t.group for t in a.terms} != {t.group for t in b.terms} or (a.sample, a.sub_sample) == (b.sample, b.sub_sample):
        return False
    own = {t.group: set(t.members or n) for t in a.terms}
    return all(own[t.group] & set(t.members or n) for t in b.terms)


def test_collisions_by_comparing_every_pair():
    rng, names = random.Random(7), list("ACGT")
    groups = tuple(Group(g, tuple(Tag(x, x) for x in names)) for g in "ijk")
    seen = set()
    for _ in range(600):
        samples = tuple(Sample(f"s{rng.randrange(3)}", None, tuple(Term(g, tuple(rng.sample(names, rng.choice([0, 1, 1, 2])))) for g in rng.sample("ijk", rng.randrange(1, 4)))) for _ in range(rng.randrange(2, 4)))
        want = any(collides(a, b, names) for a, b in itertools.combinations(samples, 2))
        try:
            check_samples(Spec(groups=groups, samples=samples))
            got = False
        except SpecError as e:
            got = "is claimed by" in str(e)
        assert got == want, samples
        seen.add(want)
    assert seen == {True, False}
    three = Spec(groups=groups, samples=(Sample("x", None, (Term("i", ("A", "C")),)),), explain_all=True)
    with pytest.raises(SpecError, match="no sample takes"):
        check_samples(three)


def test_finds_by_tag(spark):
    rng = random.Random(2)
    rows = [(k, [(rng.randrange(5),) for _ in range(rng.randrange(12))]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, a array<struct<tag_idx:int>>")
    for r in df.select("k", finds_by_tag(F.col("a")).alias("f")).collect():
        own = [x[0] for x in rows[r.k][1]]
        assert [(x.tag, x.n) for x in r.f] == [(t, own.count(t)) for t in sorted(set(own))]


def test_limits_by_tag_of_many_tags(spark):
    """The plan does not grow with the tags, and limits are those of each tag."""
    plans = []
    for n in (40, 4000):
        tags = tuple(Tag(f"t{k}", code(k, 6)) for k in range(n))
        spec = Spec(groups=(Group("g", tags, loc=(0, 0, None), finds=(("maxFindsPerTag", 1), ("minFindsPerTag", 1))),))
        plans.append(len(match.find_failure(spec.groups[0])._jc.toString()))
    assert plans[0] == plans[1]
