import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from readroute.llm.quality import quality
from tests.llm import test_line_dedup, test_ngram_join


def write(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_every_stage_against_brute_force(spark, tmp_path, prose):
    item = prose(25, 999)
    texts = {i: "\n".join(prose(20, 100 * i + k) for k in range(5)) for i in range(90)}
    block = "\n".join(prose(20, 5000 + k) for k in range(3))
    for i in range(10):
        texts[100 + i] = texts[i]  # exact copies
        texts[110 + i] = re.sub(r"^\S+", "changed", texts[20 + i].replace("\n", " "))  # near copies
        texts[120 + i] = texts[30 + i] + "\n" + block  # a shared passage
        texts[130 + i] = texts[40 + i].replace("\n", " " + item + "\n", 1)  # leaks
        texts[140 + i] = re.sub(r"(\w+)", r"\1%%%", texts[50 + i])  # junk
    texts |= {200: None, 201: "", 202: "few words"}
    docs = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    write(spark, tmp_path, docs, [(1, item), (2, prose(25, 998))])
    stages, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, str(tmp_path))
        now = cp.materialize(now)
        stages[name] = (before, {r.doc_id: r for r in now.collect()})
        if name != "bpe":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")).collect() if r.kept}
    assert set(after) == kept and not {200, 201, 202, *range(140, 150)} & kept and set(range(90)) <= kept
    before, after = stages["line_dedup"]
    want = test_line_dedup.brute({i: r.text for i, r in before.items()})
    assert {i: r.text for i, r in after.items()} == {i: t for i, (t, _, gone) in want.items() if not gone or t.strip()}
    before, after = stages["ngram_join"]
    classes = test_ngram_join.brute([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, _, c in classes if i == c}
    before, after = stages["decontamination"]
    assert set(before) - set(after) == {i for i, r in before.items() if item in r.text}
    before, after = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in after.items():
        ids = library.encode(before[i].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {tuple(r) for r in cp.run(spark, str(tmp_path)).collect()} == {tuple(r) for r in after.values()}


def test_empty_documents(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert len(cp.STAGES) == 5


def test_rows_of_one_id_are_judged_each_by_its_text(spark, tmp_path, prose):
    item = prose(25, 999)
    clean = ["\n".join(prose(20, 100 * i + k) for k in range(5)) for i in range(40)]
    leaking, junk, copy = clean[0] + " " + item, "%%% ".join(prose(120, 7).split()), clean[1]
    rows = [(None, t) for t in (*clean, leaking.replace("\n", " "), junk, copy)] + [(5, clean[2]), (5, prose(90, 4321)), (5, junk)]
    docs = [(i, t, "en", "s", len(t)) for i, t in rows] * 2  # each row twice
    rows = rows * 2
    write(spark, tmp_path, docs, [(1, item)])
    read = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as row", "2 as c0", "'x' as TEXT")
    texts = lambda df: sorted((str(r[0]), r[1]) for r in df.collect())
    good = [r for r in rows if r[1] != junk]
    kept = cp.quality_rules(spark, read, str(tmp_path))
    assert kept.columns == read.columns and texts(kept) == sorted((str(i), t) for i, t in good)
    one_each = cp.near_duplicates(spark, kept, str(tmp_path))
    assert sorted(t for _, t in texts(one_each)) == sorted({t for _, t in good})
    assert ("5", clean[2]) in texts(one_each)
    free = cp.decontamination(spark, kept, str(tmp_path))
    assert texts(free) == sorted((str(i), t) for i, t in good if item not in t)
    cut = cp.repeated_lines(spark, kept, str(tmp_path))
    assert sorted(set(texts(cut))) == sorted({(str(i), t) for i, t in good} - {("5", clean[2])})  # null ids come first
