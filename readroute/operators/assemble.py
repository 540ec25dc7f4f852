"""Assembly of output reads: bodies from templates, tags from streams."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.functions.seq import READ, TAG, column, overlay_tags, revcomp
from readroute.operators.qc import qc_json
from readroute.plans.analyze import BIN_PLACES, OUT_PLACES, targets
from readroute.plans.spec import Spec, TagRule, Template, Use, pattern_parts


def piece(use: Use, raw: bool) -> tuple[Column, Column, Column]:
    """(present, bases, quals) of a stream as used."""
    s = column("s" if raw else "c", use.stream)
    bases, quals = (revcomp(s["bases"]), F.reverse(s["quals"])) if use.reverse else (s["bases"], s["quals"])
    return column("s", use.stream).isNotNull(), bases, quals


def body(template: Template) -> Column:
    """The streams joined; qualities only if all have some. Named after the first read."""
    parts = [piece(u, template.raw) for u in template.uses]
    return F.struct(F.col("reads")[0]["name"].alias("name"), F.concat(*[p[1] for p in parts]).alias("bases"), F.concat(*[p[2] for p in parts]).alias("quals"))


def tag_values(rule: TagRule) -> list[Column]:
    """The tag, and its quality tag, as nullable structs."""
    parts = [piece(u, rule.raw) for u in rule.uses]
    some, all_quals = F.lit(False), F.lit(True)
    for present, _, quals in parts:
        some, all_quals = some | present, all_quals & (~present | quals.isNotNull())
    tag = lambda name, value, when: F.when(when, F.struct(F.lit(name).alias("tag"), F.lit("Z").alias("type"), value.alias("value")))
    out = [tag(rule.tag, F.concat_ws(rule.sep, *[F.when(p, b) for p, b, _ in parts]), some)]
    if rule.qual:
        out.append(tag(rule.qual, F.concat_ws(rule.qual_sep, *[F.when(p, q) for p, _, q in parts]), some & all_quals))
    return out


def new_tags(spec: Spec) -> Column:
    made = [t for rule in spec.tags for t in tag_values(rule)]
    if spec.qc_tag:
        made.append(F.struct(F.lit(spec.qc_tag).alias("tag"), F.lit("Z").alias("type"), qc_json(spec).alias("value")))
    none = F.array().cast(f"array<{TAG}>")
    return F.array_compact(F.array(*made)).cast(f"array<{TAG}>") if made else none


def assemble(df: DataFrame, spec: Spec) -> DataFrame:
    """Adds bodies: the output reads of assigned and passed fragments, the raw reads of others.

    Templates give one body each, with new tags alone; without templates the reads
    themselves go out, their own tags overlaid by new ones. Raw reads of removed and
    unassigned fragments carry only the QC tag beside their own.
    """
    none = F.array().cast(f"array<{TAG}>")
    adds = bool(spec.tags or spec.qc_tag)
    if adds:
        df = df.withColumn("_new", new_tags(spec))

    def with_tags(above: Column) -> Column:
        return F.transform("reads", lambda r: r.withField("tags", overlay_tags(F.coalesce(r["tags"], none), above))).cast(f"array<{READ}>")

    reads = F.col("reads").cast(f"array<{READ}>")
    if spec.templates:
        made = F.array(*[body(t).withField("tags", F.col("_new") if adds else none) for t in spec.templates]).cast(f"array<{READ}>")
    else:
        made = with_tags(F.col("_new")) if adds else reads
    raw = with_tags(F.filter("_new", lambda t: t["tag"] == spec.qc_tag)) if spec.qc_tag else reads
    out = F.col("disposition").isin("assigned", "pass_through")
    return df.withColumn("bodies", F.when(out, made).otherwise(raw)).drop("_new")


def pattern(text: str, allowed: tuple[str, ...], values: dict[str, Column]) -> Column:
    """A destination from a pattern; a value that is missing is empty."""
    return F.concat(*[F.coalesce(values.get(x, F.lit(None).cast("string")), F.lit("")) if named else F.lit(x) for x, named in pattern_parts(text, allowed)])


def body_count(spec: Spec, files: int) -> int:
    """Output reads of an assigned fragment."""
    return len(spec.templates) or files


def parts_bodies(spec: Spec, files: int, kind: str) -> bool:
    """Whether each output read of a fragment has a destination of its own: read files hold one read a fragment."""
    return kind not in ("sam", "bam") and body_count(spec, files) > 1


def outputs(df: DataFrame, spec: Spec, files: int = 1, inputs: int | None = None, kind: str = "fastq") -> DataFrame:
    """(dest, fid, ordinal, mates, read_group, name, bases, quals, tags): a row for each record written.

    `kind`: the format of assigned fragments; `inputs`: input files, fewer than `files`
    if one holds both mates. `mates`: records of the fragment in this destination.
    Fragments whose pattern is not given have no rows.
    """
    # the outer form: from the plain one Catalyst infers a filter that repeats all of bodies, as size(bodies) would
    n = F.size("reads") if not spec.templates else F.when(F.col("disposition").isin("assigned", "pass_through"), len(spec.templates)).otherwise(F.size("reads"))
    long = df.select("fid", "disposition", "sample", "sub_sample", "removal", n.alias("n"), F.posexplode_outer("bodies").alias("k", "body")).filter("k is not null")
    sources, apart = inputs or files, parts_bodies(spec, files, kind)
    ordinal = F.col("k") + 1
    own = {"pool": F.lit(spec.pool), "sample": F.col("sample"), "sub_sample": F.col("sub_sample"), "ordinal": (ordinal if apart else F.when(F.col("n") == 1, 1)).cast("string")}
    raw = {"pool": F.lit(spec.pool), "source": (F.col("k") if sources > 1 else F.lit(0)).cast("string")}
    by_source = lambda p: sources > 1 and ("source", True) in pattern_parts(p, BIN_PLACES)

    def binned(p: str | None) -> Column:
        return F.struct(pattern(p, BIN_PLACES, raw).alias("dest"), (F.lit(1) if by_source(p) else F.col("n")).alias("mates")) if p is not None else F.lit(None)

    made = F.struct((pattern(spec.out, OUT_PLACES, own) if spec.out is not None else F.lit("out")).alias("dest"), (F.lit(1) if apart and spec.out is not None else F.col("n")).alias("mates"))
    to = F.when(F.col("disposition").isin("assigned", "pass_through"), made).when(F.col("disposition") == "unassigned", binned(spec.unassigned))
    for i, r in enumerate(spec.removals):
        to = to.when(F.col("removal") == i, binned(r.pattern))
    group = F.coalesce(F.when(F.col("sample").isNotNull(), F.concat_ws(".", "sample", "sub_sample")), F.lit(spec.pool))
    placed = long.withColumn("to", to.cast("struct<dest:string,mates:int>")).filter("to is not null")
    return placed.select("to.dest", "fid", ordinal.alias("ordinal"), "to.mates", group.alias("read_group"), "body.*")


@dataclass
class Declared:
    """What a destination may get: the targets whose records go there, and whether records of no sample do."""

    targets: list[tuple[str, str | None]] = field(default_factory=list)
    pooled: bool = False


def destinations(spec: Spec, files: int, inputs: int, kind: str) -> dict[str, Declared]:
    """Every destination that the patterns declare, those that get no record too; without a pattern `out`."""

    def filled(text: str, allowed: tuple[str, ...], **values: object) -> str:
        return "".join(str(values.get(x) or "") if named and x != "source" else str(values["source"]) if named else x for x, named in pattern_parts(text, allowed))

    found: dict[str, Declared] = {}
    n = body_count(spec, files)
    ordinals = range(1, n + 1) if parts_bodies(spec, files, kind) else [1 if n == 1 else None]
    for target in targets(spec) or [None]:
        sample, sub = target or (None, None)
        for k in ordinals if spec.out is not None else [None]:
            own = found.setdefault(filled(spec.out, OUT_PLACES, pool=spec.pool, sample=sample, sub_sample=sub, ordinal=k) if spec.out is not None else "out", Declared())
            if target is None:
                own.pooled = True
            elif target not in own.targets[-1:]:
                own.targets.append(target)
    for p in [spec.unassigned, *[r.pattern for r in spec.removals]]:
        for k in range(inputs) if p is not None else ():
            found.setdefault(filled(p, BIN_PLACES, pool=spec.pool, source=k), Declared()).pooled = True
    return found
