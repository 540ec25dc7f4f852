"""Specification of a run: groups, extracts, templates, tags, samples, removals.

Each piece is written as one short text, as on the command line, and parsed here into
plain values. Nothing is read or computed at this point.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*$")
_SAM_TAG = re.compile(r"[A-Za-z][A-Za-z0-9]$")
# Quality tags that go with sequence tags by default.
QUALITY_TAGS = {"CB": "CY", "CR": "CY", "RX": "QX", "BC": "QT", "OX": "BZ"}


class SpecError(ValueError):
    """A specification that can't be run."""


def _need(ok: object, message: str) -> None:
    if not ok:
        raise SpecError(message)


def percent_decoded(text: str) -> str:
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)


@dataclass(frozen=True)
class Tag:
    id: str
    seq: str
    sub_sample: str | None = None


@dataclass(frozen=True)
class Group:
    """A set of tags to look for, where, and with how many edits."""

    name: str
    tags: tuple[Tag, ...] = ()
    path: str | None = None
    loc: tuple[int, int, int | None] | None = None  # file, start, end (None: the end)
    mismatch: int = 0
    indel: int = 0
    total: int = 0
    nearest: bool = False
    delta: int = 0
    next: tuple[str, int | None, int | None] | None = None
    prev: str | None = None
    finds: tuple[tuple[str, int], ...] = ()  # (constraint, limit)
    both_strands: bool = False
    partial5: tuple[int, float] | None = None
    partial3: tuple[int, float] | None = None
    anchor: str | None = None
    match: tuple[str, ...] = ()
    window_from: tuple[str, int, int] | None = None  # set by a next= of another group

    def limit(self, name: str) -> int | None:
        return dict(self.finds).get(name)


@dataclass(frozen=True)
class Span:
    """Where an extract's bases come from."""

    kind: str  # file, match, offset, between
    file: int = 0
    start: int | None = 0
    end: int | None = None
    group: str = ""
    other: str = ""
    left: bool = False
    offset: int = 0
    length: int | None = None


@dataclass(frozen=True)
class Use:
    """A stream in a template or tag."""

    stream: str
    reverse: bool = False


@dataclass(frozen=True)
class Template:
    uses: tuple[Use, ...]
    raw: bool = False


@dataclass(frozen=True)
class TagRule:
    tag: str
    uses: tuple[Use, ...]
    qual: str | None = None
    sep: str = "-"
    qual_sep: str = " "
    raw: bool = False


@dataclass(frozen=True)
class Term:
    """A group matched, by any of its tags or by one of `members`."""

    group: str
    members: tuple[str, ...] = ()


@dataclass(frozen=True)
class Sample:
    sample: str
    sub_sample: str | None
    terms: tuple[Term, ...]


@dataclass(frozen=True)
class Removal:
    term: Term
    pattern: str | None = None


@dataclass(frozen=True)
class Spec:
    groups: tuple[Group, ...] = ()
    extracts: tuple[tuple[str, Span], ...] = ()
    templates: tuple[Template, ...] = ()
    tags: tuple[TagRule, ...] = ()
    samples: tuple[Sample, ...] = ()
    sample_from_group: str | None = None
    removals: tuple[Removal, ...] = ()
    pool: str = "pool"
    out: str | None = None
    unassigned: str | None = None
    qc_tag: str | None = None
    explain_all: bool = False
    rg_tags: tuple[tuple[str, str], ...] = ()
    warnings: list[str] = field(default_factory=list, compare=False)

    def group(self, name: str) -> Group:
        return next(g for g in self.groups if g.name == name)


def _pairs(text: str) -> Iterable[tuple[str, str]]:
    for part in text.split(","):
        key, eq, value = part.partition("=")
        yield key, value if eq else ""


def _number(text: str, what: str) -> int:
    _need(re.fullmatch(r"\d+", text), f"{what}: {text!r} is not a number")
    return int(text)


def _coordinate(text: str, what: str) -> int | None:
    if text == "end":
        return None
    _need(re.fullmatch(r"-?\d+", text), f"{what}: {text!r} is not a coordinate")
    return int(text)


#: What an output pattern may name, longer names before those they begin with.
PLACES = ("sub_sample", "sample", "source", "ordinal", "pool")


def pattern_parts(text: str, allowed: Iterable[str]) -> tuple[tuple[str, bool], ...]:
    """(text, False) and (name, True) pieces of an output pattern; %XX stands for one character."""
    _need(text, "an output pattern is empty")
    out: list[tuple[str, bool]] = []
    for piece in re.findall("%(?:" + "|".join(PLACES) + ")|%[0-9A-Fa-f]{2}|%|[^%]+", text):
        _need(piece != "%", f"{text}: % is followed by neither a name nor two hex digits")
        named = piece[:1] == "%" and piece[1:] in PLACES
        _need(not named or piece[1:] in allowed, f"{text}: {piece} has no meaning here, only {', '.join(allowed)}")
        out.append((piece[1:], True) if named else (percent_decoded(piece), False))
    return tuple(out)


def inline_tags(text: str, name: str) -> tuple[Tag, ...]:
    """{AAC,b=ACG}: the sequence is the id where none is given."""
    out = []
    for part in filter(None, (p.strip() for p in text[1:-1].split(","))):
        left, eq, right = part.partition("=")
        out.append(Tag(left, right) if eq else Tag(left, left))
    _need(out, f"group {name}: no tags")
    _need(all(t.id and t.seq for t in out), f"group {name}: an empty tag id or sequence")
    return tuple(out)


def _attributes(group: Group, text: str, seen: set[str]) -> Group:
    new: dict[str, object] = {}
    finds = list(group.finds)
    for key, value in _pairs(text):
        _need(key not in seen, f"group {group.name}: {key} is given twice")
        seen.add(key)
        if key == "loc":
            parts = value.split(":")
            _need(len(parts) in (2, 3) and parts[1] != "end", f"group {group.name}: loc={value}")
            new["loc"] = (_number(parts[0], "loc"), _coordinate(parts[1], "loc"), _coordinate(parts[2], "loc") if len(parts) == 3 else None)
        elif key == "dist":
            parts = [_number(p, "dist") for p in value.split(":")]
            _need(1 <= len(parts) <= 3, f"group {group.name}: dist={value}")
            mismatch, indel = parts[0], parts[1] if len(parts) > 1 else 0
            total = (parts[2] if len(parts) == 3 else 0) or mismatch + indel
            _need(max(mismatch, indel) <= total <= mismatch + indel, f"group {group.name}: dist={value} can't be met")
            new |= {"mismatch": mismatch, "indel": indel, "total": total}
        elif key == "mode":
            _need(value in ("all", "nearest"), f"group {group.name}: mode={value}")
            new["nearest"] = value == "nearest"
        elif key == "delta":
            new["delta"] = _number(value, "delta")
        elif key == "next":
            other, colon, window = value.partition(":")
            lo, dash, hi = window.partition("-")
            _need(not colon or dash, f"group {group.name}: next={value}")
            new["next"] = (other, _number(lo, "next"), _number(hi, "next")) if colon else (other, None, None)
            _need(not colon or int(lo) <= int(hi), f"group {group.name}: next={value} is empty")
        elif key == "prev":
            new["prev"] = value
        elif key in ("minFindsPerTag", "maxFindsPerTag", "minFindsPerGroup", "maxFindsPerGroup"):
            finds.append((key, _number(value, key)))
        elif key == "findOne":
            _need(value in ("", "true"), f"group {group.name}: findOne takes no value")
            finds += [("minFindsPerGroup", 1), ("maxFindsPerGroup", 1), ("maxFindsPerTag", 1)]
        elif key == "both_strands":
            _need(value in ("true", "false"), f"group {group.name}: both_strands={value}")
            new["both_strands"] = value == "true"
        elif key in ("partial5", "partial3"):
            least, colon, share = value.partition(":")
            _need(colon and re.fullmatch(r"\d*\.?\d+", share) and float(share) <= 1, f"group {group.name}: {key}={value}")
            new[key] = (_number(least, key), float(share))
        elif key == "anchor":
            _need(value in ("5p", "3p"), f"group {group.name}: anchor={value}")
            new["anchor"] = value
        elif key == "match":
            new["match"] = tuple(value.split("+"))
        else:
            raise SpecError(f"group {group.name}: unknown attribute {key}")
    _need(len({k for k, _ in finds}) == len(finds), f"group {group.name}: a find limit is given twice")
    return replace(group, finds=tuple(finds), **new)


def parse_groups(texts: Iterable[str]) -> tuple[Group, ...]:
    groups: dict[str, Group] = {}
    sources: set[str] = set()
    seen: dict[str, set[str]] = {}
    for text in texts:
        m = re.match(r"([^:=]+)(::|=)(.*)$", text, re.S)
        _need(m and _NAME.match(m[1]), f"group {text!r}: expected NAME=SOURCE or NAME::ATTRIBUTES")
        name, kind, rest = m.groups()
        group = groups.setdefault(name, Group(name))
        if kind == "::":
            groups[name] = _attributes(group, rest, seen.setdefault(name, set()))
            continue
        _need(name not in sources, f"group {name}: two sources")
        sources.add(name)
        groups[name] = replace(group, tags=inline_tags(rest, name)) if rest.startswith("{") and rest.endswith("}") else replace(group, path=rest)
    _need(sources == set(groups), f"groups without tags: {sorted(set(groups) - sources)}")
    return tuple(groups.values())


def parse_extract(text: str) -> tuple[str, Span]:
    name, eq, span = text.partition("=")
    _need(eq and _NAME.match(name), f"extract {text!r}: expected NAME=SPAN")
    _need("~" not in span, f"extract {name}: ~ belongs where a stream is used")
    if m := re.fullmatch(r"@([^.+@-][^+@]*?)\.\.@(.+)", span):
        return name, Span("between", group=m[1], other=m[2])
    if m := re.fullmatch(r"@([A-Za-z_][A-Za-z0-9_.]*)([+-])(\d+):(\d+|end)", span):
        return name, Span("offset", group=m[1], left=m[2] == "-", offset=int(m[3]), length=None if m[4] == "end" else int(m[4]))
    if m := re.fullmatch(r"@([A-Za-z_][A-Za-z0-9_.-]*)", span):
        return name, Span("match", group=m[1])
    parts = span.split(":")
    _need(len(parts) == 3 and parts[1] != "end", f"extract {name}: {span!r}")
    return name, Span("file", file=_number(parts[0], name), start=_coordinate(parts[1], name), end=_coordinate(parts[2], name))


def parse_uses(text: str, what: str) -> tuple[Use, ...]:
    _need("," not in text, f"{what}: streams are joined by +")
    uses = tuple(Use(p.removeprefix("~"), p.startswith("~")) for p in text.split("+"))
    _need(all(_NAME.match(u.stream) for u in uses), f"{what}: {text!r}")
    return uses


def parse_template(text: str) -> Template:
    uses, _, attributes = text.partition("::")
    _need(attributes in ("", "raw=true", "raw=false"), f"template {text!r}")
    return Template(parse_uses(uses, "template"), attributes == "raw=true")


def parse_tags(texts: Iterable[str]) -> tuple[TagRule, ...]:
    uses: dict[str, tuple[Use, ...]] = {}
    attributes: dict[str, dict[str, str]] = {}
    for text in texts:
        body, double, rest = text.partition("::")
        tag, eq, streams = body.partition("=")
        _need(_SAM_TAG.match(tag), f"tag {text!r}: a tag has two characters")
        if eq:
            _need(tag not in uses, f"tag {tag} is given twice")
            uses[tag] = parse_uses(streams, f"tag {tag}")
        own = attributes.setdefault(tag, {})
        for key, value in _pairs(rest) if double else ():
            _need(key in ("qual", "sep", "qual-sep", "raw") and key not in own, f"tag {tag}: {key}")
            own[key] = percent_decoded(value)
    _need(set(attributes) == set(uses), "a tag without streams")
    out = []
    for tag, own in uses.items():
        a = attributes[tag]
        qual = a.get("qual", QUALITY_TAGS.get(tag))
        _need(qual in (None, "none") or _SAM_TAG.match(qual), f"tag {tag}: qual={qual}")
        out.append(TagRule(tag, own, None if qual == "none" else qual, a.get("sep", "-"), a.get("qual-sep", " "), a.get("raw") == "true"))
    return tuple(out)


def parse_selector(text: str) -> tuple[Term, ...]:
    terms = []
    for part in text.split("+"):
        group, double, members = part.partition("::")
        _need(_NAME.match(group) and (not double or members), f"selector {text!r}")
        terms.append(Term(group, tuple(members.split(",")) if double else ()))
    _need(len({t.group for t in terms}) == len(terms), f"selector {text!r}: a group twice")
    return tuple(terms)


def parse_sample(text: str, pool: str) -> Sample:
    label, eq, selector = text.partition("=")
    _need(eq and label and selector, f"sample {text!r}: expected SAMPLE=SELECTOR")
    sample, double, sub = label.partition("::")
    _need(sample and (not double or sub), f"sample {text!r}")
    return Sample(sample, (pool if sub == "%pool" else sub) if double else None, parse_selector(selector))


def parse_removal(text: str) -> Removal:
    selector, eq, pattern = text.partition("=")
    (term,) = parse_selector(selector)
    _need(len(term.members) <= 1, f"remove {text!r}: one tag at most")
    return Removal(term, pattern if eq else None)


def parse_sheet(text: str, pool: str, groups: Iterable[str]) -> tuple[Sample, ...]:
    """A sample sheet: TSV with `sample`, perhaps `sub_sample`, and a column for each group used."""
    lines = [x.rstrip("\r").split("\t") for x in text.split("\n") if x.strip() and not x.startswith("#")]
    _need(len(lines) > 1, "the sample sheet has no rows")
    head = [h.strip() for h in lines[0]]
    _need("sample" in head and len(set(head)) == len(head), "the sample sheet needs one `sample` column")
    columns = [h for h in head if h not in ("sample", "sub_sample")]
    _need(set(columns) <= set(groups), f"sheet columns that are no groups: {sorted(set(columns) - set(groups))}")
    out = []
    for line in lines[1:]:
        row = dict(zip(head, (c.strip() for c in line), strict=False))
        terms = tuple(Term(c, (row[c],)) for c in columns if row.get(c))
        _need(row.get("sample") and terms, f"sheet row {line}: no sample or no tag")
        sub = row.get("sub_sample") or None
        out.append(Sample(row["sample"], pool if sub == "%pool" else sub, terms))
    return tuple(out)


def parse(groups: Iterable[str] = (), extracts: Iterable[str] = (), templates: Iterable[str] = (), tags: Iterable[str] = (), samples: Iterable[str] = (), sample_sheet: str | None = None, sample_from_group: str | None = None, remove: Iterable[str] = (), pool: str = "pool", out: str | None = None, unassigned: str | None = None, qc_tag: str | None = None, require_samples_explain_all_tags: bool = False, rg_tags: Iterable[str] = ()) -> Spec:
    """A Spec from texts; `sample_sheet` is the sheet's content."""
    _need(sum(map(bool, (samples, sample_sheet, sample_from_group))) <= 1, "samples come from one place only")
    own = parse_groups(groups)
    extracted = tuple(map(parse_extract, extracts))
    _need(len({n for n, _ in extracted}) == len(extracted), "an extract is given twice")
    chosen = parse_sheet(sample_sheet, pool, [g.name for g in own]) if sample_sheet else tuple(parse_sample(s, pool) for s in samples)
    rg = tuple(tuple(t.split("=", 1)) for t in rg_tags)
    _need(all(len(t) == 2 and t[0] not in ("ID", "SM", "LB") for t in rg) and len({t[0] for t in rg}) == len(rg), "rg-tag: K=V; it may not set ID, SM or LB, each once")
    _need(all(_SAM_TAG.match(t[0]) for t in rg), "rg-tag: a key has two characters")
    _need(qc_tag is None or (_SAM_TAG.match(qc_tag) and (qc_tag[0] in "XYZ" or re.search("[a-z]", qc_tag))), f"qc tag {qc_tag} is not for local use")
    return Spec(own, extracted, tuple(map(parse_template, templates)), parse_tags(tags), chosen, sample_from_group, tuple(map(parse_removal, remove)), pool, out, unassigned, qc_tag, require_samples_explain_all_tags, rg)
