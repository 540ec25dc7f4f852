"""Matching of groups: windows, strategies, best match, find limits.

Each group adds `acc_<group>` (accepted matches in total order: cost, file, start,
strand, tag, span) and `hit_<group>` (the best one, null if there is none).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.functions.seq import IUPAC, column, column_name, cut, endpoint, mask_no_call
from readroute.operators.align import HIT, search_column
from readroute.operators.extract import stream
from readroute.plans.analyze import upstream
from readroute.plans.spec import Group, Spec

#: Variants of a group's tags up to which they are written out here and broadcast; more are made by Spark and joined by key.
FEW_VARIANTS = 100_000
#: Tags up to which exact ones are looked for by columns alone.
FEW_TAGS = 8


def bases(file: int) -> Column:
    return F.coalesce(F.try_element_at("reads", F.lit(file + 1))["bases"], F.lit(""))


def window(group: Group) -> tuple[Column, Column, Column] | None:
    """(file, start, end) of a group's one window; null start if there is none."""
    if group.window_from:
        name, lo, hi = group.window_from
        up = column("hit", name)
        length = F.length(F.coalesce(F.try_element_at("reads", up["file"] + 1)["bases"], F.lit("")))
        start, end = F.least(up["end"] + lo, length), F.least(up["end"] + hi, length)
        return up["file"], start, end
    if group.loc:
        file, start, end = group.loc
        length = F.length(bases(file))
        lo, hi = endpoint(start, length), endpoint(end, length)
        inside = (F.size("reads") > file) & (lo <= hi)
        return F.lit(file), F.when(inside, lo), F.when(inside, hi)
    return None


def variants(tag: str, edits: int) -> dict[str, int]:
    """Every masked text of the tag's length within `edits` substitutions, and how many it has."""
    out: dict[str, int] = {}
    sure = [IUPAC[b] for b in tag.upper()]
    for n in range(edits + 1):
        for at in combinations(range(len(sure)), n):
            options = [[x for x in "ACGTX" if x not in s] if i in at else list(s) for i, s in enumerate(sure)]
            for text in product(*options):
                out.setdefault("".join(text), n)
    return out


def variant_count(tag: str, edits: int) -> int:
    n = reduce(lambda a, b: a * len(IUPAC[b]), tag.upper(), 1)
    total = 0
    for k in range(edits + 1):
        rest = 1
        for i in range(k):
            rest = rest * (len(tag) - i) // (i + 1) * 4
        total += n * rest
    return total


def _hits(found: Column, file: Column, offset: Column) -> Column:
    fields = lambda x: F.struct(x["cost"].alias("cost"), file.cast("int").alias("file"), (x["start"] + offset).cast("int").alias("start"), x["strand"].alias("strand"), x["tag_idx"].alias("tag_idx"), x["span"].alias("span"), (x["end"] + offset).cast("int").alias("end"), x["subs"].alias("subs"), x["indels"].alias("indels"))
    return F.transform(found, fields)


def _at_place(hits: Column, file: Column, place: Column, n: int) -> Column:
    def one(h: Column) -> Column:
        return F.struct(h["subs"].alias("cost"), file.cast("int").alias("file"), place.alias("start"), F.lit(0).alias("strand"), h["tag_idx"].alias("tag_idx"), F.lit(n).alias("span"), (place + n).alias("end"), h["subs"].alias("subs"), F.lit(0).alias("indels"))

    return F.transform(hits, one)


def finds_by_tag(found: Column) -> Column:
    """(tag, n) of the tags among the hits, by index: the runs of the sorted indices, in one pass over them."""
    tags = F.array_sort(F.transform(found, lambda h: h["tag_idx"]))
    before = F.concat(F.array(F.lit(-1)), F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0))))
    marked = F.transform(F.arrays_zip(tags.alias("tag"), before.alias("old")), lambda x, i: F.when(x["tag"] != x["old"], F.struct(x["tag"].alias("tag"), i.alias("i"))))
    starts = F.array_compact(marked)
    ends = F.concat(F.transform(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda x: x["i"]), F.array(F.size(tags)))
    both = F.arrays_zip(starts.alias("run"), ends.alias("to"))
    return F.transform(F.filter(both, lambda x: x["run"].isNotNull()), lambda x: F.struct(x["run"]["tag"].alias("tag"), (x["to"] - x["run"]["i"]).alias("n")))


_OWN = "array<struct<subs:int,tag_idx:int>>"


def few_variants(df: DataFrame, tags: list[tuple[int, str]], edits: int) -> DataFrame:
    """(key, hits) of every masked text within `edits` substitutions of a tag, to be broadcast."""
    table: dict[str, list] = {}
    for i, seq in tags:
        for word, subs in variants(seq, edits).items():
            table.setdefault(word, []).append((subs, i))
    return F.broadcast(df.sparkSession.createDataFrame([(w, sorted(h)) for w, h in table.items()], f"key string, hits {_OWN}"))


def many_variants(df: DataFrame, tags: list[tuple[int, str]], edits: int) -> DataFrame:
    """The same, written out base by base by Spark, for tag sets of any size."""
    n = len(tags[0][1])
    grown = df.sparkSession.createDataFrame([(i, [IUPAC[b] for b in seq.upper()]) for i, seq in tags], "tag_idx int, sure array<string>")
    grown = grown.repartition(df.sparkSession.sparkContext.defaultParallelism).select("tag_idx", "sure", F.lit("").alias("key"), F.lit(0).alias("subs"))
    for k in range(n):
        new = F.array(*[F.struct(F.concat("key", F.lit(x)).alias("key"), (F.col("subs") + F.when(F.contains(F.col("sure")[k], F.lit(x)), 0).otherwise(1)).alias("subs")) for x in "ACGTX"])
        grown = grown.select("tag_idx", "sure", F.explode(F.filter(new, lambda x: x["subs"] <= edits)).alias("new")).select("tag_idx", "sure", "new.key", "new.subs")
    return grown.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("subs", "tag_idx"))).cast(_OWN).alias("hits"))


def anchored_by_join(df: DataFrame, group: Group, at: tuple[Column, Column, Column]) -> DataFrame:
    """Substitutions at a fixed place: a join on the window's text with the tags' variants, one for each tag length."""
    file, start, end = at
    text = F.coalesce(F.try_element_at("reads", file + 1)["bases"], F.lit(""))
    edits, parts, made = min(group.mismatch, group.total), [], []
    for n in sorted({len(t.seq) for t in group.tags}):
        own = [(i, t.seq) for i, t in enumerate(group.tags) if len(t.seq) == n]
        few = sum(variant_count(s, edits) for _, s in own) <= FEW_VARIANTS
        key, hits = f"_k{n}", f"_h{n}"
        table = (few_variants if few else many_variants)(df, own, edits).toDF(key, hits)
        first = end - n if group.anchor == "3p" else start
        fits = (first >= start) & (first + n <= F.length(text))
        df = df.withColumn(key, F.when(fits, mask_no_call(cut(text, first, first + n)))).join(table, key, "left")
        parts.append(_at_place(F.coalesce(hits, F.array().cast(_OWN)), file, first.cast("int"), n))
        made += [key, hits]
    return df.withColumn(column_name("acc", group.name), F.array_sort(F.concat(*parts).cast(f"array<{HIT}>"))).drop(*made)


def exact_places(text: Column, tag: str, index: int) -> Column:
    """Hits of a plain tag without edits that can't overlap itself: where the text is parted by it."""
    tag, m, zero = tag.upper().replace("U", "T"), len(tag), F.lit(0)
    parts = F.split(mask_no_call(text), tag)
    places = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i), tag)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(zero.alias("cost"), i.alias("start"), zero.alias("strand"), F.lit(index).alias("tag_idx"), F.lit(m).alias("span"), (i + m).alias("end"), zero.alias("subs"), zero.alias("indels")))


def overlaps_itself(tag: str) -> bool:
    """Whether two places of a tag may overlap, or (one base) follow each other as one run."""
    tag = tag.upper().replace("U", "T")
    return len(tag) < 2 or any(tag.startswith(tag[k:]) for k in range(1, len(tag)))


def searched(text: Column, group: Group) -> Column:
    """Accepted matches in a text: by columns for a few plain tags without edits, else by the approximate search."""
    exact = not (group.total or group.anchor or group.both_strands or group.partial5 or group.partial3)
    plain = len(group.tags) <= FEW_TAGS and all(len(IUPAC[b]) == 1 for t in group.tags for b in t.seq.upper()) and not any(overlaps_itself(t.seq) for t in group.tags)
    if not (exact and plain):
        return search_column(text, group)
    return F.when(text.isNotNull(), F.array_sort(F.concat(*[exact_places(text, t.seq, i) for i, t in enumerate(group.tags)])))


def accepted(df: DataFrame, group: Group, spec: Spec, files: int) -> DataFrame:
    name, none = column_name("acc", group.name), F.array().cast(f"array<{HIT}>")
    if group.match:
        streams = [stream(dict(spec.extracts)[s]) for s in group.match]
        joined = F.concat(*[s["bases"] for s in streams])
        return df.withColumn(name, F.coalesce(_hits(searched(F.when(F.length(joined) > 0, joined), group), F.lit(-1), F.lit(0)), none))
    at = window(group)
    if group.anchor and not group.indel:
        df = anchored_by_join(df, group, at)
    elif at:
        file, start, end = at
        text = F.try_element_at("reads", file + 1)["bases"]
        last = F.length(text) if group.anchor == "5p" else end
        whole = start.isNotNull() & (last >= start)
        if group.anchor == "3p":
            whole &= last <= F.length(text)
        found = searched(F.when(whole, cut(text, start, last)), group)
        df = df.withColumn(name, F.coalesce(_hits(found, file, start), none))
    else:
        found = [_hits(searched(F.try_element_at("reads", F.lit(k + 1))["bases"], group), F.lit(k), F.lit(0)) for k in range(files)]
        df = df.withColumn(name, F.array_sort(F.concat(*[F.coalesce(x, none) for x in found])))
    needs = upstream(group, spec)
    if needs:
        met = reduce(lambda a, b: a & b, [column("hit", u).isNotNull() for u in needs])
        df = df.withColumn(name, F.when(met, column("acc", group.name)).otherwise(none))
    return df


def best(group: Group) -> Column:
    """The least match; with mode=nearest and delta, only if no other tag comes near it."""
    found = column("acc", group.name)
    first = F.array_min(found)
    if group.nearest and group.delta:
        other = F.array_min(F.filter(found, lambda x: x["tag_idx"] != first["tag_idx"]))
        first = F.when(other.isNull() | (other["cost"] >= first["cost"] + group.delta), first)
    return F.when(F.size(found) > 0, first)


# Names of the find limits in reports.
LIMIT_NAMES = {"minFindsPerGroup": "min_finds_per_group", "maxFindsPerGroup": "max_finds_per_group", "minFindsPerTag": "min_finds_per_tag", "maxFindsPerTag": "max_finds_per_tag"}


def find_failure(group: Group) -> Column | None:
    """The first find limit that the accepted matches break, as a struct; null if none."""
    found = column("acc", group.name)
    size = F.size(found)

    def fails(name: str, count: Column) -> Column:
        return F.struct(F.lit(group.name).alias("group"), F.lit(LIMIT_NAMES[name]).alias("constraint"), count.cast("int").alias("found"), F.lit(group.limit(name)).alias("limit"))

    checks: list[tuple[Column, Column]] = []
    if group.limit("minFindsPerGroup") is not None:
        checks.append((size < group.limit("minFindsPerGroup"), fails("minFindsPerGroup", size)))
    if group.limit("maxFindsPerGroup") is not None:
        checks.append((size > group.limit("maxFindsPerGroup"), fails("maxFindsPerGroup", size)))
    most, least = group.limit("maxFindsPerTag"), group.limit("minFindsPerTag")
    if most is not None or least is not None:
        runs = finds_by_tag(found)
        over = lambda r: r["n"] > F.lit(most) if most is not None else F.lit(False)
        under = lambda r: r["n"] < F.lit(least) if least is not None else F.lit(False)
        first = F.try_element_at(F.filter(runs, lambda r: over(r) | under(r)), F.lit(1))  # of the tags that occur, by index
        if most is not None:
            checks.append((over(first), fails("maxFindsPerTag", first["n"])))
        if least is not None:
            checks.append((under(first), fails("minFindsPerTag", first["n"])))
    if not checks:
        return None
    out = F.when(*checks[0])
    for c in checks[1:]:
        out = out.when(*c)
    return out


FAILURE = "struct<group:string,constraint:string,found:int,limit:int>"


def match_groups(df: DataFrame, spec: Spec, files: int) -> DataFrame:
    """All groups in order; after a broken find limit the groups that follow stay unmatched."""
    df = df.withColumn("failure", F.lit(None).cast(FAILURE))
    for group in spec.groups:
        df = accepted(df, group, spec, files)
        broken = find_failure(group)
        going = F.col("failure").isNull()
        df = df.withColumn(column_name("hit", group.name), F.when(going, best(group)))
        if broken is not None:
            df = df.withColumn("failure", F.coalesce("failure", broken.cast(FAILURE)))
    return df
