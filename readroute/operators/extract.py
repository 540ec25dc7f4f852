"""Extracts: named pieces of a fragment's bases and qualities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.functions.seq import column, column_name, cut, endpoint, fit_quals
from readroute.plans.spec import Group, Span, Spec

#: Rows of a table of tags or combinations up to which it is broadcast; a larger one is joined by key.
BROADCAST_ROWS = 500_000
#: Tags of a group up to which they are written into expressions; more are looked up by a join.
LITERAL_TAGS = 64


def small(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def tag_text(group: Group) -> Column:
    """The declared sequence of the tag that a group matched."""
    if len(group.tags) > LITERAL_TAGS:
        return column("tag", group.name)
    return F.try_element_at(F.array(*[F.lit(t.seq) for t in group.tags]), column("hit", group.name)["tag_idx"] + 1)


def with_tag_texts(df: DataFrame, spec: Spec) -> DataFrame:
    """Adds `tag_<group>`, the tag's sequence, for the groups of many tags."""
    for g in spec.groups:
        if len(g.tags) > LITERAL_TAGS:
            known = df.sparkSession.createDataFrame([(i, t.seq) for i, t in enumerate(g.tags)], f"_tag int, `{column_name('tag', g.name)}` string")
            df = df.withColumn("_tag", column("hit", g.name)["tag_idx"]).join(small(known, len(g.tags)), "_tag", "left").drop("_tag")
    return df


def _of(file: Column, start: Column, end: Column) -> Column:
    read = F.try_element_at("reads", file + 1)
    return F.struct(cut(read["bases"], start, end).alias("bases"), cut(read["quals"], start, end).alias("quals"))


def bounds(span: Span) -> tuple[Column, Column, Column]:
    """(file, start, end) of a span; null start where its group has no match."""
    if span.kind == "file":
        length = F.length(F.try_element_at("reads", F.lit(span.file + 1))["bases"])
        start = endpoint(span.start, length)
        return F.lit(span.file), start, F.greatest(start, endpoint(span.end, length))
    hit = column("hit", span.group)
    file = hit["file"]
    if span.kind == "match":
        return file, hit["start"], hit["end"]
    total = F.length(F.try_element_at("reads", file + 1)["bases"])
    if span.kind == "offset" and not span.left:
        start = F.least(hit["end"] + span.offset, total)
        end = total if span.length is None else F.least(start + span.length, total)
        return file, start, end
    if span.kind == "offset":
        end = F.greatest(hit["start"] - span.offset, F.lit(0))
        start = F.lit(0) if span.length is None else F.greatest(end - span.length, F.lit(0))
        return file, F.when(hit.isNotNull(), start), end
    other = column("hit", span.other)
    wrong = (hit["file"] != other["file"]) | (hit["end"] > other["start"])
    start = F.when(wrong, F.raise_error(F.concat(F.lit(f"@{span.group}..@{span.other} is out of order in fragment "), F.col("fid").cast("string"))).cast("int")).otherwise(hit["end"])
    return file, F.when(hit.isNotNull() & other.isNotNull(), start), other["start"]


def stream(span: Span) -> Column:
    """struct<bases,quals>, null if absent; a region between anchors is empty, not absent."""
    file, start, end = bounds(span)
    found = F.when(start.isNotNull(), _of(file, start, end))
    if span.kind == "between":
        return F.coalesce(found, F.struct(F.lit("").alias("bases"), F.lit("").alias("quals")))
    return found


def corrected(span: Span, spec: Spec) -> Column | None:
    """The declared tag instead of a group's own observed bases; qualities are fitted to it."""
    if span.kind != "match":
        return None
    hit = column("hit", span.group)
    bases = tag_text(spec.group(span.group))
    quals = _of(hit["file"], hit["start"], hit["end"])["quals"]
    return F.when(hit.isNotNull(), F.struct(bases.alias("bases"), fit_quals(F.when(hit["strand"] == 1, F.reverse(quals)).otherwise(quals), F.length(bases)).alias("quals")))


def extract(df: DataFrame, spec: Spec) -> DataFrame:
    """Adds `s_<name>` (observed) and `c_<name>` (corrected, else observed) for each extract."""
    if spec.qc_tag or any(span.kind == "match" for _, span in spec.extracts):
        df = with_tag_texts(df, spec)
    columns = {}
    for name, span in spec.extracts:
        columns[column_name("s", name)] = stream(span)
        own = corrected(span, spec)
        columns[column_name("c", name)] = columns[column_name("s", name)] if own is None else own
    return df.withColumns(columns) if columns else df


def unextracted(spec: Spec, files: int) -> tuple[Column, Column]:
    """(bases of the files that the templates draw on, those of them in no piece used)."""
    used = {u.stream for t in (*spec.templates, *spec.tags) for u in t.uses}
    spans = [s for n, s in spec.extracts if n in used]
    total, left = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(files):
        length = F.length(F.try_element_at("reads", F.lit(k + 1))["bases"])
        if not spec.templates:
            total, left = total + F.coalesce(length, F.lit(0)), left
            continue
        pieces = []
        for s in spans:
            file, start, end = bounds(s)
            pieces.append(F.when((file == k) & start.isNotNull() & (end > start), F.struct(start.cast("int").alias("a"), end.cast("int").alias("b"))))
        if not pieces:
            continue
        own = F.array_sort(F.array_compact(F.array(*pieces)))
        zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
        covered = F.aggregate(own, zero, lambda acc, x: F.struct(F.greatest(acc["to"], x["b"]).alias("to"), (acc["n"] + F.greatest(x["b"] - F.greatest(acc["to"], x["a"]), F.lit(0))).alias("n")), lambda acc: acc["n"])
        some = F.size(own) > 0
        total, left = total + F.when(some, length).otherwise(0), left + F.when(some, length - covered).otherwise(0)
    return total.cast("long"), left.cast("long")
