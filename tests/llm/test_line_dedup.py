import duckdb
import pandas as pd

from readroute.llm.line_dedup import ORACLE_SQL, line_dedup
from pyspark.sql import functions as F


def brute(docs):
    """By sets, over {id: text}."""
    seen, out = {}, {}
    for i in sorted(docs, key=lambda x: (x is not None, x)):
        if docs[i] is None:
            out[i] = (None, 0, 0)
            continue
        lines = docs[i].split("\n")
        gone = set()
        for p in range(max(len(lines) - 2, 1)):
            key = tuple(lines[p : p + 3])
            if not "".join(key).strip(" \t\n\x0b\x0c\r"):
                continue
            if key in seen:
                gone |= {p, p + 1, p + 2}
            seen.setdefault(key, (i, p))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone & set(range(len(lines)))))
    return out


TEXTS = {
    0: "a\nb\nc\nd", 1: "x\na\nb\nc\ny", 2: "a\nb\nc\nd", 3: "a\nb", 4: "a\nb", 5: "", 6: None, 7: "r\nr\nr\nr\nr\nr",
    8: "\n\n\n\n", 9: "\n\n\n\nz", 10: "solo", 11: "solo", 12: "b\nc\nd\na\nb\nc", 13: "long\n" * 20000 + "end",
}


def test_against_brute_force(docs_of):
    rows = line_dedup(docs_of(list(TEXTS.items()))).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows} == brute(TEXTS)


def test_random_texts_and_sql(docs_of):
    import random

    rng = random.Random(3)
    docs = {i: "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for i in range(120)}
    docs[500] = None
    frame = docs_of(list(docs.items()))
    found = line_dedup(frame)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found.collect()} == brute(docs)
    documents = pd.DataFrame({"doc_id": list(docs), "text": list(docs.values())})  # noqa: F841
    want = sorted(duckdb.sql(ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in found.select("doc_id", "n_lines", "n_removed", F.md5("text")).collect()) == want


def test_odd_tables(docs_of):
    assert line_dedup(docs_of([])).count() == 0
    rows = docs_of([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc")])
    found = line_dedup(rows.selectExpr("*", "5 as pos", "'x' as id", "7 as n_removed", "'y' as k1"))
    assert sorted((r.doc_id or -1, r.text, r.n_removed) for r in found.collect()) == [(-1, "a\nb\nc", 0), (1, "", 3), (1, "", 3), (2, "", 3)]
    assert found.columns.count("n_removed") == 1 and {"pos", "id", "k1"} <= set(found.columns)
    assert "Python" not in found._jdf.queryExecution().toString()


def test_rows_of_one_id_are_cut_by_their_own_lines(docs_of):
    texts = [(0, "p\nq"), (1, "p\nq\nr\nz"), (1, "k\nl\nm\nn"), (2, "p\nq\nr\nz"), (None, "p\nq\nr\nz"), (None, "one\ntwo\nthree\nfour"), (None, "z\nk\nl\nm\nn")]
    # by row: null ids first, then by id; among the rows of one id each order keeps the unique lines
    found = {(r.doc_id, r.text) for r in line_dedup(docs_of(texts)).collect()}
    assert found == {(None, "p\nq\nr\nz"), (None, "one\ntwo\nthree\nfour"), (None, "z\nk\nl\nm\nn"), (0, "p\nq"), (1, ""), (2, "")}
    each = docs_of(texts).withColumn("row", F.struct("doc_id", F.monotonically_increasing_id()))
    rows = sorted(each.collect(), key=lambda r: (r.row.doc_id is not None, r.row.doc_id or 0, r.row[1]))
    want = brute({k: r.text for k, r in enumerate(rows)})
    got = {tuple(r.row): (r.text, r.n_lines, r.n_removed) for r in line_dedup(each, id_col="row").collect()}
    assert [got[tuple(r.row)] for r in rows] == [want[k] for k in range(len(rows))]


def test_names_of_other_columns(docs_of):
    docs = docs_of(list(TEXTS.items())).selectExpr("*", "'a' as _lines", "'b' as _covered", "'c' as _kept", "9 as N_LINES", "'d' as h", "'e' as starts", "'f' as c0", "'g' as TEXT", "'h' as `a.b c`")
    found = line_dedup(docs)
    assert found.columns == [c for c in docs.columns if c != "N_LINES"] + ["n_lines", "n_removed"]
    rows = [tuple(r) for r in found.collect()]
    assert {r[0]: (r[1], r[-2], r[-1]) for r in rows} == brute(TEXTS)
    assert {r[5:-2] for r in rows} == {("a", "b", "c", "d", "e", "f", "g", "h")}
