"""Cases of single rules: reads, a specification, what must come out."""

import pytest
from pyspark.sql import functions as F

from readroute.functions import seq
from readroute.operators import align, match
from readroute.operators.match import variant_count, variants
from readroute.plans.analyze import analyze, in_order, tag_table
from readroute.plans.demux import Demux
from readroute.plans.spec import Group, SpecError, Tag, parse
from readroute.sources.reads import from_columns


@pytest.fixture
def go(spark):
    def run(reads, quals=None, **spec):
        """reads: texts, or tuples of texts for several files."""
        rows = [(i, *([r] if isinstance(r, str) else r)) for i, r in enumerate(reads)]
        files = len(rows[0]) - 1
        df = spark.createDataFrame(rows, "fid long, " + ", ".join(f"b{k} string" for k in range(files)))
        q = lambda k: F.lit(quals) if quals else F.repeat(F.lit("I"), F.length(f"b{k}"))
        return Demux(from_columns(df, F.col("fid"), *[(F.concat(F.lit("r"), "fid"), F.col(f"b{k}"), q(k)) for k in range(files)]), analyze(parse(**spec)), files)

    return run


def column(df, name):
    return [r[0] for r in df.orderBy("fid").select(name).collect()]


def bases(d, stream="x", kind="c"):
    return column(d.extracted(), f"{kind}_{stream}.bases")


X = {"extracts": ["x=@g"]}

# Cases whose outcomes are given.
MATCHING = [
    # (reads, groups, observed bases)
    (["TGGGTGTTAACCGGTT", "TGGGTGATAACCGGTT"], ["g={TGGGTGTT}", "g::loc=0:0:8"], ["TGGGTGTT", None]),
    (["ATGAGACCCCDDDD", "TTGAGACCCCDDDD", "GGGGGGCCCCDDDD"], ["g={ATGAGA}", "g::loc=0:0:6,dist=1"], ["ATGAGA", "TTGAGA", None]),
    (["ATGACACCCCDDDD", "ATACACCCCDDDD", "ATGGACACCCCDDDD"], ["g={ATGACA}", "g::loc=0:0:8,dist=0:1"], ["ATGACA", "ATACA", "ATGGACA"]),
    (["GGTAGGCCCCDDDD"], ["g={GGGGGG}", "g::loc=0:0:6,dist=2"], ["GGTAGG"]),
    (["GGTAGGCCCCDDDD"], ["g={GGGGGG}", "g::loc=0:0:6,dist=1"], [None]),
    (["TGAGCCCCCDDDD"], ["g={TGAGC,TGAGA}", "g::loc=0:0:5,dist=1,mode=nearest,delta=1"], ["TGAGC"]),
    (["TGAGCCCCCDDDD"], ["g={TGAGC,TGAGA}", "g::loc=0:0:5,dist=1,mode=nearest,delta=2"], [None]),
    (["AATTCCCCDDDD"], ["g={AAAA,TTTT}", "g::loc=0:0:4,dist=2,mode=nearest,delta=1"], [None]),
    (["TGGGTGAACCCC", "TGGGTGCCCCCC", "TGGGTGTACCCC"], ["g={TGGGTGNN}", "g::loc=0:0:8"], ["TGGGTGAA", "TGGGTGCC", "TGGGTGTA"]),
    (["AGTACTCTGGGG"], ["g={AGTACTC,TACTCA}", "g::loc=0:0:8,dist=1,maxFindsPerGroup=1,anchor=5p"], ["AGTACTC"]),
    (["TTTTTACGTA"], ["g={ACGTA}", "g::loc=0:0:10,anchor=3p"], ["ACGTA"]),
    (["ACGTACGTTTTT"], ["g={acgtacgt}", "g::loc=0:0:8"], ["ACGTACGT"]),
    (["CGATCGTTTTTTTTTT"], ["g={ATCGATCG}", "g::loc=0:0:8,partial5=4:0"], ["CGATCG"]),
    (["CGATCGTTTTTTTTTT"], ["g={ATCGATCG}", "g::loc=0:0:8"], [None]),
    (["TTTTTTTTTTTACGTA"], ["g={ACGTACGT}", "g::loc=0:11:end,partial3=4:0"], ["ACGTA"]),
    (["NCGT", "ACGN"], ["g={ACGT}", "g::loc=0:0:4,dist=1,anchor=5p"], ["NCGT", "ACGN"]),
    (["ACGACGTGG", "ACGTNACGT", "AGGTAA"], ["g={ACGTACGT}", "g::loc=0:0:9,anchor=5p,dist=0:1"], ["ACGACGT", "ACGTNACGT", None]),
    (["AC", "A"], ["g={ACG}", "g::loc=0:0:3,anchor=5p"], [None, None]),
]


@pytest.mark.parametrize("case", range(len(MATCHING)))
def test_matching(go, case):
    reads, groups, want = MATCHING[case]
    assert bases(go(reads, groups=groups, **X), kind="s") == want


def test_correction_and_raw(go):
    d = go(["TTGACACCCCDDDD"], groups=["g={ATGACA}", "g::loc=0:0:8,dist=1"], extracts=["x=@g"], templates=["x", "x::raw=true"])
    assert bases(d) == ["ATGACA"] and bases(d, kind="s") == ["TTGACA"]
    assert [r.bases for r in d.records().orderBy("ordinal").collect()] == ["ATGACA", "TTGACA"]


def test_both_strands(go):
    d = go(["GGGGGGGGGGCACGATAAAAAA"], groups=["g={AACGTG,CCGGAA}", "g::loc=0:10:16,both_strands=true,dist=1"], extracts=["x=@g"], templates=["~x"])
    assert bases(d) == ["AACGTG"] and column(d.records(), "bases") == ["CACGTT"]
    assert column(d.matched(), "hit_g.strand") == [1]


def test_windows_and_order(go):
    r = ["AACGTAGGGCCCAAGGGCCCTTTTGGGG"]
    g = ["a={AACGTA}", "a::loc=0:0:6,next=b:8-20", "b={GGGCCC}"]
    assert bases(go(r, groups=g, extracts=["x=@b+0:4"])) == ["TTTT"]
    g = ["b={GGGCCC}", "b::loc=0:6:12", "a={AACGTA}", "a::loc=0:0:6,next=b"]
    assert bases(go(r, groups=g, extracts=["x=@b+0:4"])) == ["AAGG"]
    assert [x.name for x in in_order(parse(groups=g))] == ["a", "b"]
    assert bases(go(["AACGAACAGAGTTTTCCCCCCCCCCAACGAACAGAGGGGG"], groups=["g={AACGAACAGAG}", "g::loc=0:-15:end"], extracts=["x=@g+0:4"])) == ["GGGG"]
    assert bases(go(["ACGTACGTGGGGGGTTTT"], groups=["g={GGGGGG}", "g::loc=0:8:14"], extracts=["x=@g-0:8"])) == ["ACGTACGT"]
    d = go(["AACGTAGGGCCCAAAA", "TTTTTTGGGCCCAAAA"], groups=["a={AACGTA}", "a::loc=0:0:6", "b={GGGCCC}", "b::loc=0:6:12,prev=a"], samples=["S=b"])
    assert column(d.routed(), "disposition") == ["assigned", "unassigned"]


def test_find_limits(go):
    g = ["g={A=AAAAAA,B=CCCCCC,C=GGGGGG}"]
    reads = ["AAAAAACCCCCCTTTTTTTT", "AAAAAATTTTTTTTTTTTTT"]
    assert column(go(reads, groups=[*g, "g::minFindsPerGroup=2"], samples=["S=g"]).routed(), "disposition") == ["assigned", "unassigned"]
    assert column(go(reads, groups=[*g, "g::maxFindsPerGroup=1"], samples=["S=g"]).routed(), "disposition") == ["unassigned", "assigned"]
    assert column(go(reads, groups=[*g, "g::findOne"], remove=["g"]).routed(), "disposition") == ["unassigned", "removed"]


def test_joined_streams(go):
    d = go([("AACCGGTT", "ACGTACGT")], groups=["m={s1=AACCGGTTACGTACGT,s2=ACGTACGTAACCGGTT}", "m::match=a+b"], extracts=["a=0:0:8", "b=1:0:8"], sample_from_group="m")
    assert column(d.routed(), "sample") == ["s1"]


def test_selectors(go):
    g = ["t={t1=AAAAAA,t2=GGGGGG}", "t::loc=0:0:6", "p={p1=CCCA,p2=CCCC}", "p::loc=0:14:18"]
    assert column(go(["AAAAAATTTTTTTTCCCC"], groups=g, samples=["SA=t::t1+p::p1", "SB=t::t1+p::p2"]).routed(), "sample") == ["SB"]


def test_between(go):
    g = ["a={AAAAAA}", "a::loc=0:0:6", "b={TTTTTT}", "b::loc=0:16:22"]
    assert bases(go(["AAAAAACGCGCGTACGTTTTTTGGGG"], groups=g, extracts=["x=@a..@b"])) == ["CGCGCGTACG"]
    assert bases(go(["GGGGGGCGCGCGTACGTTTTTTGGGG"], groups=g, extracts=["x=@a..@b"])) == [""]
    with pytest.raises(Exception, match="out of order"):
        bases(go(["AAAAAACGCGCGTACGTTTTTTGGGG"], groups=g, extracts=["x=@b..@a"]))


def test_tags_and_qualities(go):
    d = go(["ACGTACGTAGTGCATGCAT"], quals="012345678abcdefghij", extracts=["u=0:0:9", "b=0:9:end"], templates=["b"], tags=["RX=u"])
    assert [[t.value for t in r.tags] for r in d.records().collect()] == [["ACGTACGTA", "012345678"]]
    d = go(["AAAACCCCGGGGGGGG"], quals="0123abcdIIIIIIII", extracts=["a=0:0:4", "b=0:4:8", "c=0:8:end"], templates=["c"], tags=["RX=a+b", "RX::qual-sep=_"])
    assert [[t.value for t in r.tags] for r in d.records().collect()] == [["AAAA-CCCC", "0123_abcd"]]


def test_unextracted_share(go):
    d = go(["A" * 100], extracts=["b=0:0:90"], templates=["b"], groups=["g={A}", "g::loc=0:0:1,anchor=5p"], samples=["s=g"])
    assert [r.frac_bases_unextracted for r in d.per_sample().collect()] == ["0.100000"]
    assert d.summary().first().frac_bases_unextracted == "0.100000"


def test_qc(go):
    d = go(["GAAGGGAAAA"], groups=["g={GAAGAG}", "g::loc=0:0,dist=1"], samples=["s=g"], qc_tag="ZS")
    (tag,) = d.records().first().tags
    assert tag.value == '{"v":1,"outcome":"assigned","sample":"s","sub_sample":null,"groups":[{"g":"g","tag":"GAAGAG","loc":"0:0:6","obs":"GAAGGG","sub":1,"ind":0}]}'


ERRORS = [
    dict(groups=["g={AAAA,TTTT}", "g::dist=2"]), dict(groups=["g={AAAA,AAAA}"]), dict(groups=["g={NNN}"]), dict(groups=["g={A}", "g={C}"]), dict(groups=["g::loc=0:0:4"]),
    dict(groups=["g={A}", "g::loc=0:end:4"]), dict(groups=["g={A}", "g::dist=1:0:5"]), dict(groups=["g={AC}", "g::anchor=3p,loc=0:0:4,dist=0:1"]), dict(groups=["g={AC}", "g::anchor=5p"]),
    dict(groups=["g={AC}", "g::delta=1"]), dict(groups=["g={AC}", "g::prev=h"]), dict(groups=["g={AC}", "g::next=g"]), dict(groups=["a={AC}", "a::prev=b", "b={GT}", "b::prev=a"]),
    dict(groups=["g={c1=AC,c2=GT}"], samples=["s=g::c1", "t=g::c1,c2"]), dict(groups=["g={c1=AC,c2=GT}"], samples=["s=g::c1"], require_samples_explain_all_tags=True),
    dict(groups=["g={AC}"], samples=["s=g::zz"]), dict(samples=["s=h"]), dict(extracts=["x=@g"]), dict(templates=["x"]), dict(extracts=["x=0:0:4"], templates=["x,y"]), dict(extracts=["x=~0:0:4"]),
    dict(extracts=["x=0:0:4", "x=0:0:5"]), dict(tags=["R=x"]), dict(out="%sample.fq"), dict(unassigned="%sample.fq"), dict(qc_tag="RX"), dict(rg_tags=["SM=x"]), dict(groups=["g={AC}"], samples=["s=g"], sample_from_group="g"),
    dict(groups=["g={A}"], sample_sheet="sample\tg\nx\t\n"), dict(groups=["g={A}"], sample_sheet="sample\tzz\nx\tA\n"),
]


@pytest.mark.parametrize("case", range(len(ERRORS)))
def test_bad_specifications(case):
    with pytest.raises(SpecError):
        analyze(parse(**ERRORS[case]))


def test_sheet_and_tag_table(go):
    spec = analyze(parse(groups=["i=tags.tsv", "j={G,T}"], sample_sheet="sample\tsub_sample\ti\tj\ns1\tl1\tone\tG\ns1\tl1\tCC\t\ns2\t%pool\tone\tT\n", pool="P"), read_text=lambda p: "#c\nID\tBarcode\n\none\tAA\r\ntwo\tCC\n")
    assert [t.seq for t in spec.group("i").tags] == ["AA", "CC"]
    assert [(s.sample, s.sub_sample) for s in spec.samples] == [("s1", "l1"), ("s1", "l1"), ("s2", "P")]
    with pytest.raises(SpecError):
        tag_table("id\tname\tseq\nx\ty\tAC\n", "g")


def test_strategies_agree():
    """Neighbours of a tag by join give what the search gives at a fixed place."""
    import itertools

    tag, texts = "ARC", ["".join(t) for t in itertools.product("ACGTX", repeat=3)]
    near = variants(tag, 1)
    assert len(near) == variant_count(tag, 0) + sum(v == 1 for v in near.values())
    group = Group("g", (Tag("t", tag),), mismatch=1, total=1, anchor="5p")
    found = align.search(texts, group)
    assert {t: f[0][0] for t, f in zip(texts, found) if f} == near


def test_search_against_brute_force():
    """Every hit is an alignment of its cost; the least cost of a window is found."""
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 16))) for _ in range(150)]
    group = Group("g", (Tag("a", "ACGTA"), Tag("b", "GGTC")), mismatch=2, indel=2, total=2)
    for text, hits in zip(texts, align.search(texts, group), strict=True):
        for i, tag in enumerate(["ACGTA", "GGTC"]):
            own = [h for h in hits if h[3] == i]
            best = min((distance(tag, text[a:b]) for a in range(len(text) + 1) for b in range(a + 1, len(text) + 1)), default=9)
            assert (min(h[0] for h in own) if own else 9) == (best if best <= 2 else 9)
            assert all(distance(tag, text[h[1] : h[5]]) == h[0] == h[6] + h[7] for h in own)


def test_scalars(spark):
    row = spark.createDataFrame([("ACGTNRYacg", "n1/1 c", "AB")], "b string, n string, q string").select(seq.revcomp(F.col("b")).alias("r"), seq.first_token(F.col("n")).alias("f"), seq.fit_quals(F.col("q"), F.lit(4)).alias("p"), seq.fit_quals(F.col("q"), F.lit(1)).alias("c"), seq.mask_no_call(F.col("b")).alias("m")).first()
    assert (row.r, row.f, row.p, row.c, row.m) == ("cgtRYNACGT", "n1/1", "ABBB", "A", "ACGTXXXACG")
    assert seq.degeneracy("ARN") == 8 and seq.tag_class("ARU") == "A[AG]T" and seq.revcomp_text("AACG") == "CGTT"


def test_3p_anchor_above_the_bound_of_variants(go, monkeypatch):
    """Many long tags at the window's end, and the same matches as the join where both can."""
    import random

    rng = random.Random(9)
    tags = ["".join(rng.choice("ACGT") for _ in range(16)) for _ in range(96)]
    assert sum(variant_count(t, 2) for t in tags) > match.FEW_VARIANTS
    near = lambda t: t[:3] + "N" + t[4:9] + ("A" if t[9] != "A" else "C") + t[10:]
    reads = ["GG" + tags[5], "GT" + near(tags[70]), "GG" + tags[5][1:] + "T", tags[1], "GG" + tags[5] + "ACGT"]
    found = bases(go(reads, groups=["g={" + ",".join(tags) + "}", "g::loc=0:0:18,anchor=3p,dist=2"], **X), kind="s")
    assert found == [tags[5], near(tags[70]), None, tags[1], tags[5]]
    reads = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(4, 12))) for _ in range(60)]
    some = dict(groups=["g={ACGTA,ARG,TTC}", "g::loc=0:1:9,anchor=3p,dist=1"], **X)
    first = column(go(reads, **some).extracted(), "acc_g")
    monkeypatch.setattr(match, "FEW_VARIANTS", 0)
    assert column(go(reads, **some).extracted(), "acc_g") == first and any(first)


def test_exact_search_by_columns_is_the_approximate_one(spark, monkeypatch):
    import random

    rng = random.Random(12)
    reads = [None, "", "A", *["".join(rng.choice(rng.choice(["AAAC", "ACGTNacgt"])) for _ in range(rng.randint(1, 30))) for _ in range(150)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "fid long, b string")
    group = analyze(parse(groups=["g={AAC,CA,acgt,AUG}", "g::loc=0:0"])).groups[0]
    found = df.select("fid", match.searched(F.col("b"), group).alias("a"), align.search_column(F.col("b"), group).alias("c")).orderBy("fid").collect()
    assert match.overlaps_itself("ACGA") and not any(match.overlaps_itself(t.seq) for t in group.tags)
    assert [r.a for r in found] == [r.c for r in found] and sum(len(r.a or []) for r in found) > 100


def test_names_with_dots_hyphens_and_case(go):
    """Groups and streams whose names Spark would read as fields, or take for one another."""
    tags = ",".join("".join("ACGT"[k >> (2 * i) & 3] for i in range(4)) for k in range(80))
    d = go(["ACGTAAAA", "TCGTAAAA", "GGGGCCCC"], groups=["a.b={A,C}", "a.b::loc=0:0:1,anchor=5p", "A.b={T}", "A.b::loc=0:0:1,anchor=5p", "x-y={" + tags + "}", "x-y::loc=0:4:8,anchor=5p,prev=a.b"], extracts=["s.1=@a.b", "S.1=@A.b", "t-2=@x-y", "rest=0:4:end"], templates=["rest"], tags=["CB=s.1+t-2", "XA=S.1"], samples=["one=a.b::A+x-y", "two=A.b"], qc_tag="ZS")
    rows = d.records().orderBy("fid").collect()
    assert [r.read_group for r in rows] == ["one", "two"]
    assert [{t.tag: t.value for t in r.tags if t.tag != "ZS"} for r in rows[:2]] == [{"CB": "A-AAAA", "CY": "I IIII"}, {"XA": "T"}]
    assert [t.value for t in rows[0].tags if t.tag == "ZS"][0].count('"g":') == 2
