"""Checks of a specification, tag tables, and the order in which groups are matched."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import combinations_with_replacement, product

from readroute.functions.seq import IUPAC, degeneracy
from readroute.plans.neartags import near_pairs
from readroute.plans.spec import Group, Sample, Spec, SpecError, Tag, Term, _need, pattern_parts

# Names of the columns of a tag table.
ID_COLUMNS, SEQ_COLUMNS = ("id", "tag", "name", "sample_id", "sample"), ("seq", "sequence", "barcode")
#: Concrete sequences that a tag, and a group, may stand for.
TAG_DEGENERACY, GROUP_DEGENERACY = 1 << 20, 10_000_000
#: The same, above which a warning is due.
MANY_OF_TAG, MANY_OF_GROUP = 4096, 100_000
# What the patterns of assigned fragments, and of raw ones, may name.
OUT_PLACES, BIN_PLACES = ("pool", "sample", "sub_sample", "ordinal"), ("pool", "source")
#: Warnings of tags near each other that are written out; of more, their number.
SHOWN = 20


def tag_table(text: str, name: str) -> tuple[Tag, ...]:
    """Tags of a TSV with a header; blank lines and # lines are skipped."""
    lines = [x.rstrip("\r").split("\t") for x in text.split("\n") if x.strip() and not x.startswith("#")]
    _need(len(lines) > 1, f"group {name}: the tag table has no rows")
    head = [h.strip().lower() for h in lines[0]]

    def column(aliases: tuple[str, ...]) -> int | None:
        at = [i for i, h in enumerate(head) if h in aliases]
        _need(len(at) <= 1, f"group {name}: several columns for one field: {[head[i] for i in at]}")
        return at[0] if at else None

    own_id, seq, sub = column(ID_COLUMNS), column(SEQ_COLUMNS), column(("sub_sample",))
    _need(own_id is not None and seq is not None, f"group {name}: the tag table needs an id and a sequence")
    out = []
    for line in lines[1:]:
        cell = lambda i: line[i].strip() if i is not None and i < len(line) else ""  # noqa: B023,E731
        _need(cell(own_id) and cell(seq), f"group {name}: an empty id or sequence in {line}")
        out.append(Tag(cell(own_id), cell(seq), cell(sub) or None))
    return tuple(out)


def resolver(group: Group) -> Callable[[str], int]:
    """Finds the index of a tag by id, else by sequence; of several the first."""
    ids, seqs = {}, {}
    for i, tag in enumerate(group.tags):
        ids.setdefault(tag.id, i)
        seqs.setdefault(tag.seq, i)

    def place(token: str) -> int:
        found = ids.get(token, seqs.get(token))
        _need(found is not None, f"group {group.name} has no tag {token!r}")
        return found

    return place


def tag_distance(a: str, b: str) -> int:
    """Positions at which two tags of one length can't stand for the same base."""
    return sum(not set(IUPAC[x]) & set(IUPAC[y]) for x, y in zip(a.upper(), b.upper(), strict=True))


def check_tags(group: Group, warnings: list[str]) -> None:
    for tag in group.tags:
        _need(set(tag.seq.upper()) <= set(IUPAC), f"group {group.name}: {tag.seq!r} has a symbol that is no base code")
        _need(set(tag.seq.upper()) != {"N"}, f"group {group.name}: {tag.seq!r} fits everything")
        _need(degeneracy(tag.seq) <= TAG_DEGENERACY, f"group {group.name}: {tag.seq!r} stands for too many sequences")
    _need(sum(degeneracy(t.seq) for t in group.tags) <= GROUP_DEGENERACY, f"group {group.name} stands for too many sequences")
    near = 0
    for length in sorted({len(t.seq) for t in group.tags}):
        own = [t.seq for t in group.tags if len(t.seq) == length]
        for i, j, d in near_pairs(own, 2 * group.mismatch):
            _need(d > 0, f"group {group.name}: {own[i]} and {own[j]} can't be told apart")
            message = f"group {group.name}: {own[i]} and {own[j]} can both match one read"
            _need(group.nearest, message)
            near += 1
            if near <= SHOWN:
                warnings.append(message)
    if near > SHOWN:
        warnings.append(f"group {group.name}: {near - SHOWN} more pairs can both match one read")


def check_groups(spec: Spec) -> None:
    names = [g.name for g in spec.groups]
    targets = [g.next[0] for g in spec.groups if g.next]
    _need(len(set(targets)) == len(targets), "a group follows one group at most")
    for g in spec.groups:
        near = g.window_from is not None
        _need(not (g.match and g.loc), f"group {g.name}: match= and loc= exclude each other")
        if g.anchor:
            _need(not g.match and (g.loc or near) and not (g.partial5 or g.partial3) and not g.both_strands, f"group {g.name}: anchor= goes with loc= or a window, and without match=, partial and both_strands")
            _need(not (g.anchor == "3p" and g.indel), f"group {g.name}: a 3p anchor allows no indel")
        _need(g.delta == 0 or g.nearest, f"group {g.name}: delta= needs mode=nearest")
        for other in filter(None, [g.next and g.next[0], g.prev]):
            _need(other in names and other != g.name, f"group {g.name}: no group {other!r}")
        if g.next and g.next[1] is not None:
            target = spec.group(g.next[0])
            _need(not g.match and not target.match and not target.loc, f"group {g.name}: a relative window is neither from nor to a match= group, and its target has no loc=")
        streams = dict(spec.extracts)
        _need(all(s in streams for s in g.match), f"group {g.name}: match= of an unknown stream")


def check_uses(spec: Spec) -> None:
    streams, names = dict(spec.extracts), {g.name: g for g in spec.groups}
    for name, span in spec.extracts:
        for g in filter(None, (span.group, span.other)):
            _need(g in names and not names[g].match, f"extract {name}: no group with a place named {g!r}")
    for t in (*spec.templates, *spec.tags):
        _need(all(u.stream in streams for u in t.uses), f"an unknown stream in {[u.stream for u in t.uses]}")
    for term in [t for s in spec.samples for t in s.terms] + [r.term for r in spec.removals]:
        _need(term.group in names, f"no group {term.group!r}")
    _need(spec.sample_from_group is None or spec.sample_from_group in names, f"no group {spec.sample_from_group!r}")
    sampled = bool(spec.samples or spec.sample_from_group)
    own = pattern_parts(spec.out, OUT_PLACES) if spec.out is not None else ()
    _need(sampled or not {("sample", True), ("sub_sample", True)} & set(own), "%sample needs samples")
    for pattern in [spec.unassigned, *[r.pattern for r in spec.removals]]:
        if pattern is not None:
            pattern_parts(pattern, BIN_PLACES)


def doubts(spec: Spec) -> list[str]:
    """What a specification says without effect, or with one that is hardly meant."""
    out, spans = [], dict(spec.extracts)
    used = {u.stream for t in (*spec.templates, *spec.tags) for u in t.uses} | {s for g in spec.groups for s in g.match}
    out += [f"extract {n} is not used" for n in spans if n not in used]
    asked = {t.group for s in spec.samples for t in s.terms} | {r.term.group for r in spec.removals} | {spec.sample_from_group}
    asked |= {g for s in spans.values() for g in (s.group, s.other)} | {g.prev for g in spec.groups} | {g.name for g in spec.groups if g.next or g.finds}
    out += [f"group {g.name} decides nothing" for g in spec.groups if g.name not in asked and not spec.qc_tag]
    for t in (*spec.templates, *spec.tags):
        if t.raw and not any(spans[u.stream].kind == "match" for u in t.uses):
            out.append(f"raw=true changes nothing for {'+'.join(u.stream for u in t.uses)}")
    if spec.groups and not (spec.samples or spec.sample_from_group or spec.removals):
        out.append("groups are searched, but no sample takes fragments and no rule removes any")
    for g in spec.groups:
        if g.anchor and g.loc and g.loc[2] is not None and (g.loc[1] >= 0) == (g.loc[2] >= 0):
            out += [f"group {g.name}: {t.seq} is longer than its window" for t in g.tags if len(t.seq) > g.loc[2] - g.loc[1]][:1]
        out += [f"group {g.name}: {t.seq} stands for {degeneracy(t.seq)} sequences" for t in g.tags if degeneracy(t.seq) > MANY_OF_TAG]
        if (n := sum(degeneracy(t.seq) for t in g.tags)) > MANY_OF_GROUP:
            out.append(f"group {g.name} stands for {n} sequences")
    return out


def upstream(g: Group, spec: Spec) -> list[str]:
    """Groups that must have matched before this one is looked for."""
    return [*([g.prev] if g.prev else []), *[o.name for o in spec.groups if o.next and o.next[0] == g.name]]


def in_order(spec: Spec) -> tuple[Group, ...]:
    """Groups after those they depend on, else as declared."""
    streams, done, out = dict(spec.extracts), set(), []
    needs = {}
    for g in spec.groups:
        via = [x for s in g.match for x in (streams[s].group, streams[s].other) if x]
        needs[g.name] = {*upstream(g, spec), *via}
    while len(out) < len(spec.groups):
        ready = next((g for g in spec.groups if g.name not in done and needs[g.name] <= done), None)
        _need(ready, "the groups depend on each other in a circle")
        done.add(ready.name)
        out.append(ready)
    return tuple(out)


def check_samples(spec: Spec) -> None:
    """No combination of tags is claimed by two samples; with explain_all every tag of their groups is claimed.

    Samples that ask for the same groups are compared by the classes of their tags (tags that
    the same lists hold), never by all combinations. A group of which any tag will do
    agrees with every list.
    """
    by_groups: dict[tuple[str, ...], list[tuple[tuple, dict[str, frozenset[int]]]]] = {}
    places, used = {g.name: resolver(g) for g in spec.groups}, {}
    for s in spec.samples:
        lists = {t.group: frozenset(map(places[t.group], t.members)) for t in s.terms if t.members}
        by_groups.setdefault(tuple(sorted(t.group for t in s.terms)), []).append(((s.sample, s.sub_sample), lists))
        for t in s.terms:
            used.setdefault(t.group, set()).update(lists.get(t.group, range(len(spec.group(t.group).tags))))
    for groups, samples in by_groups.items():
        kind: dict[str, dict[int, tuple]] = {}  # class of a tag: the lists that hold it
        for g in groups:
            held: dict[int, list[int]] = {}
            for i, tags in enumerate(dict.fromkeys(own[g] for _, own in samples if g in own)):
                for t in tags:
                    held.setdefault(t, []).append(i)
            kind[g] = {t: tuple(i) for t, i in held.items()}
        shapes: dict[tuple[str, ...], list] = {}
        for name, own in samples:
            shapes.setdefault(tuple(g for g in groups if g in own), []).append((name, own))
        for one, two in combinations_with_replacement(shapes, 2):
            common = [g for g in one if g in two]
            taken: dict[tuple, set] = {}
            for k, shape in enumerate((one, two)):
                for name, own in shapes[shape]:
                    for unit in product(*[{kind[g][t]: t for t in own[g]}.items() for g in common]):
                        holders = taken.setdefault(tuple(u[0] for u in unit), set())
                        other = next((n for side, n in holders if n != name and (side != k or one == two)), None)
                        if other:
                            tags = ", ".join(f"{g}::{spec.group(g).tags[t].id}" for g, (_, t) in zip(common, unit, strict=True)) or "any tag"
                            raise SpecError(f"{tags} is claimed by {other[0]} and {name[0]}")
                        if sum(side == k for side, _ in holders) < 2:
                            holders.add((k, name))
    if spec.explain_all and spec.samples:
        for name, seen in used.items():
            left = [t.id for i, t in enumerate(spec.group(name).tags) if i not in seen]
            _need(not left, f"group {name}: no sample takes {left}")


def analyze(spec: Spec, read_text: Callable[[str], str] | None = None) -> Spec:
    """The spec with tag tables read, samples written out and groups in order, or SpecError."""
    groups = []
    for g in spec.groups:
        if g.path is not None:
            _need(read_text, f"group {g.name}: no reader for {g.path}")
            g = replace(g, tags=tag_table(read_text(g.path), g.name))
        for o in spec.groups:
            if o.next and o.next[0] == g.name and o.next[1] is not None:
                g = replace(g, window_from=(o.name, o.next[1], o.next[2]))
        groups.append(g)
    spec = replace(spec, groups=tuple(groups))
    check_groups(spec)
    check_uses(spec)
    for g in spec.groups:
        check_tags(g, spec.warnings)
    spec.warnings.extend(doubts(spec))
    if spec.sample_from_group:
        group = spec.group(spec.sample_from_group)
        spec = replace(spec, samples=tuple(Sample(t.id, t.sub_sample, (Term(group.name, (t.id,)),)) for t in group.tags))
    for r in spec.removals:
        for m in r.term.members:
            resolver(spec.group(r.term.group))(m)
    check_samples(spec)
    return replace(spec, groups=in_order(spec))


def targets(spec: Spec) -> list[tuple[str, str | None]]:
    """Distinct (sample, sub_sample), in the order declared."""
    return list(dict.fromkeys((s.sample, s.sub_sample) for s in spec.samples))
