"""The index of pieces gives what aligning every tag gives, and large sets of tags take no loop."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from readroute.functions.seq import revcomp_text
from readroute.operators import align
from readroute.plans.analyze import analyze
from readroute.plans.demux import Demux
from readroute.plans.spec import Group, Tag, parse
from readroute.sources.reads import from_columns


def random_tag(rng, size, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(size))


def mutated(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        k = rng.randrange(len(text) + 1)
        what = rng.choice("sid")
        if what == "i":
            text.insert(k, rng.choice("ACGT"))
        elif k < len(text):
            text[k : k + 1] = [] if what == "d" else [rng.choice("ACGTN")]
    return "".join(text)


@pytest.mark.parametrize("anchor", [None, "5p"])
def test_index_and_every_tag_agree(monkeypatch, anchor):
    rng = random.Random(str(anchor))
    total = 0
    for trial in range(60):
        letters = rng.choice(["ACGT", "AC", "ACGTRN"])
        tags = list({random_tag(rng, rng.choice([5, 8, 9, 12]), letters) for _ in range(rng.randrange(1, 30))})
        mismatch, indel = rng.randrange(3), rng.randrange(3)
        group = Group("g", tuple(Tag(t, t) for t in tags), mismatch=mismatch, indel=indel, total=rng.randint(max(mismatch, indel), mismatch + indel), anchor=anchor)
        if anchor is None and rng.random() < 0.5:
            group = Group("g", group.tags, mismatch=mismatch, indel=indel, total=group.total, both_strands=rng.random() < 0.7, partial5=rng.choice([None, (3, 0.2)]), partial3=rng.choice([None, (4, 0.0)]))
        texts = ["", "N", *[random_tag(rng, rng.randrange(6), "ACGTN") + mutated(rng, t if rng.random() < 0.8 else revcomp_text(t), rng.randrange(4)).replace("R", "A") + random_tag(rng, rng.randrange(12), letters[:4] + "n") for t in rng.choices(tags, k=25)], random_tag(rng, 150, letters[:4])]
        monkeypatch.setattr(align, "FEW", 0)
        monkeypatch.setattr(align, "CANDIDATES", rng.choice([1 << 21, 50]))
        monkeypatch.setattr(align, "CELLS", rng.choice([1 << 22, 300]))
        monkeypatch.setattr(align, "BASES", rng.choice([1 << 20, 64]))
        own = align.search(texts, group)
        monkeypatch.setattr(align, "FEW", 1 << 30)
        assert own == align.search(texts, group), (trial, group)
        total += sum(map(len, own))
    assert total > 500


def test_long_plateaus_and_repeats(monkeypatch):
    group = Group("g", tuple(Tag(t, t) for t in ["AAAAAAAA", "ACACACAC", "AAAACCCC"]), mismatch=2, indel=2, total=3)
    texts = ["A" * 300, "AC" * 150, "A" * 20 + "C" * 20 + "A" * 20, "CACA" * 4 + "AAAA" * 5]
    monkeypatch.setattr(align, "FEW", 0)
    own = align.search(texts, group)
    monkeypatch.setattr(align, "FEW", 99)
    assert own == align.search(texts, group) and all(own)


def test_fifty_thousand_tags_over_whole_reads():
    rng = np.random.default_rng(3)
    bases = np.array(list("ACGT"))
    tags = ["".join(x) for x in bases[rng.integers(0, 4, (50_000, 16))]]
    chosen = rng.integers(0, 50_000, 2000)
    reads = ["".join(bases[rng.integers(0, 4, 40)]) + tags[k][:7] + tags[k][8:] + "".join(bases[rng.integers(0, 4, 45)]) for k in chosen]
    group = Group("g", tuple(Tag(t, t) for t in tags), mismatch=1, indel=1, total=1)
    began = time.time()
    found = align.search(reads, group)
    assert time.time() - began < 60
    assert all(any(h[3] == k and h[0] == 1 for h in hits) for k, hits in zip(chosen.tolist(), found))


def test_a_million_anchored_tags_with_indels():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 4**16, 1_000_000))
    digits = (codes[:, None] >> (2 * np.arange(16))) & 3
    tags = np.array(list("ACGT"))[digits].view("U16").ravel().tolist()
    chosen = rng.integers(0, len(tags), 3000).tolist()
    reads = [t[:5] + t[6:] + "ACGTAC" if n % 3 == 0 else t[:9] + "T" + t[9:] + "GGG" if n % 3 == 1 else t + "CC" for n, t in enumerate(tags[k] for k in chosen)]
    began = time.time()
    found = align.search(reads, Group("g", tuple(Tag(t, t) for t in tags), mismatch=1, indel=1, total=1, anchor="5p"))
    assert time.time() - began < 60
    for n, (k, hits) in enumerate(zip(chosen, found)):
        best = [h for h in hits if h[3] == k]
        assert best and best[0][0] <= (0 if n % 3 == 2 else 1), (n, tags[k], reads[n], hits)


def test_many_tags_in_a_run(spark):
    rng = random.Random(8)
    tags = list({random_tag(rng, 14) for _ in range(3000)})
    reads = [(k, random_tag(rng, 10) + mutated(rng, tags[k * 7], 1) + random_tag(rng, 12)) for k in range(200)]
    df = spark.createDataFrame(reads, "fid long, b string")
    spec = analyze(parse(groups=["g={" + ",".join(tags) + "}", "g::loc=0:0,dist=1:1:1,mode=nearest"], extracts=["x=@g"], sample_from_group="g"))
    d = Demux(from_columns(df, F.col("fid"), (F.lit("r"), F.col("b"), F.repeat(F.lit("I"), F.length("b")))), spec, 1)
    rows = d.routed().select("fid", "sample", "c_x.bases").collect()
    assert sum(r["sample"] == tags[r.fid * 7] == r.bases for r in rows) > 190


def test_near_pairs_by_comparing_all():
    from readroute.plans.analyze import near_pairs, tag_distance

    rng = random.Random(5)
    for trial in range(60):
        size, letters = rng.choice([1, 4, 8, 17, 35]), rng.choice(["ACGT", "AC", "ACGTN", "ACGTRYN"])
        seqs = list({random_tag(rng, size, letters) for _ in range(rng.randrange(2, 60))})
        seqs += [mutated(rng, s, 0)[:-1] + "A" for s in seqs[:10]]
        for most in (0, 1, 2, 5, 40):
            want = sorted((i, j, d) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if (d := tag_distance(seqs[i], seqs[j])) <= most)
            assert sorted(near_pairs(seqs, most)) == want, (trial, most)


def test_near_pairs_of_many_tags():
    from readroute.plans.analyze import near_pairs

    rng = np.random.default_rng(2)
    codes = np.array(list("ACGT"))[rng.integers(0, 4, (200_000, 16))]
    codes[:2000, 5] = "N"
    codes[2000:2100, :8] = "N"
    seqs = codes.view("U16").ravel().tolist()
    seqs.append(seqs[150_000][:3] + ("A" if seqs[150_000][3] != "A" else "C") + seqs[150_000][4:])
    began = time.time()
    found = [*near_pairs(seqs, 2)]
    assert time.time() - began < 60 and (150_000, 200_000, 1) in found and len(found) == len({f[:2] for f in found})
