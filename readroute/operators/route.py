"""Routing: a fragment is removed, assigned to a sample, unassigned or passed through.

Samples are not tried one by one. Those that ask for the same groups become a table of the
combinations of tags that they take, and fragments are joined with it, so the size of the
plan does not hang on the number of samples or tags. Tags of a group that the same samples
list are one class there, so a list of any length is one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.functions.seq import column
from readroute.operators.extract import small
from readroute.plans.analyze import resolver, targets
from readroute.plans.spec import Spec, Term

ROUTE = "struct<target:int,sample:string,sub_sample:string>"


def satisfied(term: Term, spec: Spec) -> Column:
    """The term's group matched, by one of its members if it names any."""
    hit = column("hit", term.group)
    if not term.members:
        return hit.isNotNull()
    place = resolver(spec.group(term.group))
    return F.coalesce(hit["tag_idx"].isin(*sorted({place(m) for m in term.members})), F.lit(False))


@dataclass
class Table:
    """The samples that ask for tags of `named` groups and for any tag of `open_` groups."""

    named: tuple[str, ...]
    open_: tuple[str, ...]
    samples: list[tuple[int, list[frozenset[int]]]] = field(default_factory=list)  # (target, tags by group)

    def classes(self) -> list[dict[int, int]]:
        """Class of each tag, by group: tags that the same lists hold are one class, named by the least of them."""
        out = []
        for k in range(len(self.named)):
            lists = list(dict.fromkeys(tags[k] for _, tags in self.samples))
            held: dict[int, list[int]] = {}
            for i, tags in enumerate(lists):
                for t in tags:
                    held.setdefault(t, []).append(i)
            first: dict[tuple[int, ...], int] = {}
            for t in sorted(held):
                first.setdefault(tuple(held[t]), t)
            out.append({t: first[tuple(i)] for t, i in held.items()})
        return out

    def rows(self, classes: list[dict[int, int]]) -> dict[tuple[int, ...], int]:
        """Combination of classes: the target that takes it, the one declared first if there are several."""
        out: dict[tuple[int, ...], int] = {}
        for target, tags in self.samples:
            for key in product(*[sorted({own[t] for t in of}) for own, of in zip(classes, tags, strict=True)]):
                out[key] = min(target, out.get(key, target))
        return out


def tables(spec: Spec) -> list[Table]:
    """The samples by the groups that they ask for."""
    number = {t: i for i, t in enumerate(targets(spec))}
    places = {g.name: resolver(g) for g in spec.groups}
    found: dict[tuple, Table] = {}
    for s in spec.samples:
        terms = sorted(s.terms, key=lambda t: t.group)
        named, open_ = tuple(t.group for t in terms if t.members), tuple(t.group for t in terms if not t.members)
        tags = [frozenset(map(places[t.group], t.members)) for t in terms if t.members]
        found.setdefault((named, open_), Table(named, open_)).samples.append((number[s.sample, s.sub_sample], tags))
    return list(found.values())


def with_route(df: DataFrame, spec: Spec) -> DataFrame:
    """Adds `route` (target, sample, sub_sample): the first declared sample that takes the fragment."""
    names, spark = targets(spec), df.sparkSession
    found: list[Column] = []
    for n, table in enumerate(tables(spec)):
        # a fragment without a match has a null key, which joins with nothing
        classes, keys = table.classes(), []
        for k, (group, own) in enumerate(zip(table.named, classes, strict=True)):
            key, tag = f"_k{n}_{k}", column("hit", group)["tag_idx"]
            if all(t == c for t, c in own.items()):
                df = df.withColumn(key, tag)
            else:
                df = df.withColumn(f"{key}t", tag).join(small(spark.createDataFrame(list(own.items()), f"{key}t int, {key} int"), len(own)), f"{key}t", "left").drop(f"{key}t")
            keys.append(key)
        met = reduce(lambda a, b: a & b, [column("hit", g).isNotNull() for g in table.open_], F.lit(True))
        if not keys:
            first = min(t for t, _ in table.samples)
            found.append(F.when(met, F.struct(F.lit(first).alias("target"), F.lit(names[first][0]).alias("sample"), F.lit(names[first][1]).cast("string").alias("sub_sample")).cast(ROUTE)))
            continue
        rows = [(*key, (t, *names[t])) for key, t in table.rows(classes).items()]
        taken = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in keys) + f", _r{n} {ROUTE}")
        df = df.join(small(taken, len(rows)), keys, "left").drop(*keys)
        found.append(F.when(met, F.col(f"_r{n}")))
    best = F.lit(None).cast(ROUTE) if not found else found[0] if len(found) == 1 else F.least(*found)
    return df.withColumn("route", best).drop(*[f"_r{n}" for n in range(len(found))])


def route(df: DataFrame, spec: Spec) -> DataFrame:
    """Adds disposition, sample, sub_sample, target (index), removal (index), reason, missing.

    In this order: a broken find limit leaves a fragment unassigned; the first removal
    that applies removes it; without samples it passes; the first sample in declared
    order takes it; else it is unassigned, as it is when a template lacks a stream.
    """
    broken = F.col("failure").isNotNull()
    removal: Column = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(spec.removals))):
        removal = F.when(satisfied(r.term, spec), F.lit(i)).otherwise(removal)
    needed = list(dict.fromkeys(u.stream for t in spec.templates for u in t.uses))
    missing: Column = F.lit(None).cast("string")
    for name in reversed(needed):
        missing = F.when(column("s", name).isNull(), F.lit(name)).otherwise(missing)
    df = with_route(df, spec).withColumns({"removal": F.when(~broken, removal), "missing": missing})
    gone, lacks = F.col("removal").isNotNull(), F.col("missing").isNotNull()
    sampled = bool(spec.samples)
    routed = F.col("route").isNotNull() if sampled else F.lit(True)
    disposition = (
        F.when(broken, "unassigned").when(gone, "removed").when(~routed, "unassigned").when(lacks, "unassigned").otherwise("assigned" if sampled else "pass_through")
    )
    reason = F.when(broken, "find_constraint").when(gone, None).when(~routed, "no_sample").when(lacks, "missing_stream")
    df = df.withColumns({"disposition": disposition, "reason": reason})
    own = F.when(F.col("disposition") == "assigned", F.col("route"))
    return df.withColumns({c: own[c] for c in ("target", "sample", "sub_sample")}).drop("route")
