"""Sequence functions as Spark columns (and a few plan-time helpers on strings).

Bases are strings, qualities strings of Phred+33 characters of the same length, so the
same `substring`, `reverse` and `rpad` serve both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes, the bases each stands for, and their complements.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# The codes in both cases, and their complements in the same order.
_FROM, _TO = "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"

# Tags that describe an alignment and don't outlive it.
ALIGNMENT_TAGS = "AS NM MD SA MC MQ ms XS XA XB XR pa UQ CC CP CG H0 H1 H2 HI IH NH TS".split()

TAG = "struct<tag:string,type:string,value:string>"
READ = f"struct<name:string,bases:string,quals:string,tags:array<{TAG}>>"
FRAGMENT = f"fid long, reads array<{READ}>"


def column_name(kind: str, name: str) -> str:
    """The column of a group or stream; names that differ in case alone have columns that Spark tells apart."""
    upper = sum(1 << k for k, c in enumerate(name) if c.isupper())
    return f"{kind}_{name}" + f"~{upper:x}" * bool(upper)


def column(kind: str, name: str) -> Column:
    return F.col(f"`{column_name(kind, name)}`")


def revcomp_text(bases: str) -> str:
    return bases.translate(str.maketrans(_FROM, _TO))[::-1]


def revcomp(bases: Column) -> Column:
    """Reverse complement; case and IUPAC codes are kept."""
    return F.translate(F.reverse(bases), _FROM, _TO)


def mask_no_call(bases: Column) -> Column:
    """Upper-cased bases with all but A, C, G, T as X, which nothing matches."""
    return F.regexp_replace(F.upper(bases), "[^ACGT]", "X")


def tag_class(tag: str) -> str:
    """A regular expression of the concrete reads that a tag with IUPAC codes fits."""
    return "".join(IUPAC.get(b, "") if len(IUPAC.get(b, "")) == 1 else f"[{IUPAC[b]}]" for b in tag.upper())


def degeneracy(tag: str) -> int:
    """How many concrete sequences a tag stands for."""
    n = 1
    for b in tag.upper():
        n *= len(IUPAC[b])
    return n


def first_token(name: Column) -> Column:
    return F.regexp_extract(name, r"^[^ \t]*", 0)


def mate_key(name: Column) -> Column:
    return F.regexp_replace(name, "/[12]$", "")


def endpoint(at: int | None, length: Column) -> Column:
    """A coordinate: n from the start, -n from the end, None the end itself; clamped."""
    if at is None:
        return length
    return F.least(F.lit(at), length) if at >= 0 else F.greatest(length + at, F.lit(0))


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end), 0-based; empty if end is not after start."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def fit_quals(quals: Column, length: Column) -> Column:
    """Qualities cut to a length, or padded with the last one (Phred 30 if there is none)."""
    last = F.when(F.length(quals) > 0, F.substring(quals, -1, 1)).otherwise(F.lit("?"))
    return F.when(quals.isNotNull(), F.rpad(quals, length, last))


def comment_tags(comment: Column) -> Column:
    """Tags of a name comment: its TAB-separated fields XX:T:VALUE with T of A, i, f or Z."""
    good = r"^[A-Za-z][A-Za-z0-9]:(A:[!-~]|i:[-+]?[0-9]+|f:[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?|Z:[ !-~]*)$"
    fields = F.filter(F.split(F.coalesce(comment, F.lit("")), "\t"), lambda x: x.rlike(good))
    return F.transform(fields, lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), F.substring(x, 4, 1).alias("type"), F.substring(x, 6, 1 << 30).alias("value")))


def without_alignment_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~t["tag"].isin(*ALIGNMENT_TAGS))


def overlay_tags(below: Column, above: Column) -> Column:
    """Tags of `below` with those of `above` put in their place or added."""
    kept = F.transform(below, lambda b: F.coalesce(F.try_element_at(F.filter(above, lambda a: a["tag"] == b["tag"]), F.lit(-1)), b))
    return F.concat(kept, F.filter(above, lambda a: ~F.exists(below, lambda b: b["tag"] == a["tag"])))


def render_tags(tags: Column) -> Column:
    """Tags as TAB-separated TAG:TYPE:VALUE; all whole numbers are of type i."""
    kind = lambda t: F.when(t["type"].isin(*"cCsSiI"), F.lit("i")).otherwise(t["type"])
    return F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["tag"], kind(t), t["value"])), "\t")
