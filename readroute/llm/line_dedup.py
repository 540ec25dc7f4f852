"""Line de-duplication over windows of three lines, in DataFrame functions only.

Every run of three consecutive lines is hashed. A window that occurs anywhere else,
in the same text or another, keeps its first occurrence, by (id, position); the
positions that the later ones cover are merged for each text and their lines go. Texts
are told apart by their id and a hash of the text, as an id may stand in several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readroute.llm.common import numbered, place

#: Lines in a window.
WINDOW = 3
_ALL = 1 << 30


def line_windows(texts: DataFrame) -> DataFrame:
    """(id, h, pos, k1, k2) of (id, h, text): the 128-bit key of the window that begins at each line.

    A text of fewer lines is one window. Windows without a word have no row.
    """
    split = texts.filter("text is not null").select("id", "h", F.split("text", "\n").alias("lines"))
    hashed = split.select(
        "id",
        "h",
        F.size("lines").alias("n"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), x.rlike("[^\\x20\\x09-\\x0D]").alias("full"))).alias("a"),
    )
    zipped = hashed.select("id", "h", "n", F.posexplode(F.arrays_zip(F.col("a"), F.slice("a", 2, _ALL).alias("b"), F.slice("a", 3, _ALL).alias("c"))).alias("pos", "w"))
    lines = [F.col(f"w.{x}") for x in "abc"]
    full = F.coalesce(lines[0]["full"], F.lit(False)) | F.coalesce(lines[1]["full"], F.lit(False)) | F.coalesce(lines[2]["full"], F.lit(False))
    return zipped.filter((F.col("pos") <= F.greatest(F.col("n") - WINDOW, F.lit(0))) & full).select(
        "id", "h", "pos", F.xxhash64(*[x["h"] for x in lines]).alias("k1"), F.xxhash64(*[x["g"] for x in lines]).alias("k2")
    )


def later_windows(texts: DataFrame) -> DataFrame:
    """(id, h, starts) of (id, h, text): where later occurrences of repeated windows begin in each text.

    Occurrences are counted before the shuffle. The join back to them has one row for
    each repeated window on one side, so a window that a large part of the texts share
    is split by Spark's skew join.
    """
    windows = line_windows(texts)
    where = F.struct("id", "h", "pos")
    repeated = windows.groupBy("k1", "k2").agg(F.min(where).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(repeated, ["k1", "k2"]).filter(~F.col("first").eqNullSafe(where))
    return later.groupBy("id", "h").agg(F.collect_set("pos").alias("starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with repeated passages cut from their texts, and two counts.

    Added columns (replacing columns of these names, in any case): n_lines, lines of the
    text as it came; n_removed, lines cut. All other columns pass, whatever their names.

    A null text stays null with 0 lines; an empty text is one line; an emptied text is ''.
    Lines are parted by a line feed and compared byte for byte; a text of any length is
    handled whole. Null ids come first in the order. Rows of one id and different texts
    are texts of their own, in the order of a hash of the text; rows alike in id and text
    count as one text and get the same cuts, so give each row an id of its own (any type
    with an order) where such copies should lose theirs.
    """
    names, added = docs.columns, ("n_lines", "n_removed")
    id_at, text_at = place(names, id_col), place(names, text_col)
    rest = [i for i, c in enumerate(names) if c.lower() not in added]
    flat = numbered(docs).withColumn("h", F.xxhash64(F.col(f"c{text_at}")))
    cut = later_windows(flat.select(F.col(f"c{id_at}").alias("id"), "h", F.col(f"c{text_at}").alias("text"))).withColumnRenamed("h", "own")
    joined = flat.join(cut, F.col(f"c{id_at}").eqNullSafe(F.col("id")) & (F.col("h") == F.col("own")), "left")
    text = F.col(f"c{text_at}")
    covered = F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(WINDOW)])))
    found = joined.select(*[f"c{i}" for i in rest], F.when(F.col("starts").isNotNull(), F.split(text, "\n")).alias("lines"), covered.alias("covered"))
    index = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    found = found.withColumn("kept", F.when(F.col("lines").isNotNull(), index))
    after = F.when(F.col("kept").isNull(), text).otherwise(F.array_join(F.transform("kept", lambda i: F.element_at("lines", i + 1)), "\n"))
    n_lines = F.when(F.col("lines").isNotNull(), F.size("lines")).when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)
    n_removed = F.coalesce((F.size("lines") - F.size("kept")).cast("long"), F.lit(0).cast("long"))
    out = found.select(*[after.alias(f"c{i}") if i == text_at else F.col(f"c{i}") for i in rest], n_lines.cast("long").alias("n_lines"), n_removed.alias("n_removed"))
    return out.toDF(*[names[i] for i in rest], *added)


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), starts AS (
  SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 1))) AS pos FROM cut
), windows AS (
  SELECT doc_id, pos, list_slice(lines, pos + 1, pos + 3) AS lines3 FROM starts
), full_windows AS (
  SELECT * FROM windows WHERE regexp_matches(array_to_string(lines3, chr(10)), '[^ \t\n\x0b\x0c\r]')
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY lines3 ORDER BY doc_id, pos) AS nth FROM full_windows
), covered AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM ranked WHERE nth > 1
), all_lines AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(lines) AS content FROM cut
), kept AS (
  SELECT a.doc_id, string_agg(a.content, chr(10) ORDER BY a.line) AS text, count(*) AS n
  FROM all_lines a ANTI JOIN covered c ON a.doc_id = c.doc_id AND a.line = c.line GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(c.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(c.lines), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS text_md5
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
