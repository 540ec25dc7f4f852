"""A record's provenance as one JSON text with keys in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readroute.functions.seq import column, cut
from readroute.operators.extract import tag_text
from readroute.plans.spec import Group, Spec


def _text(value: Column) -> Column:
    """A JSON string, or null as the word."""
    return F.coalesce(F.get_json_object(F.to_json(F.struct(F.array(value).alias("x"))), "$.x"), F.lit("[null]")).substr(F.lit(2), F.length(F.coalesce(F.get_json_object(F.to_json(F.struct(F.array(value).alias("x"))), "$.x"), F.lit("[null]"))) - 2)


def group_object(group: Group) -> Column:
    """A matched group: tag, place and observed bases (if it has a place), edits, strand."""
    hit = column("hit", group.name)
    tag = tag_text(group)
    observed = cut(F.try_element_at("reads", hit["file"] + 1)["bases"], hit["start"], hit["end"])
    place = F.when(hit["file"] >= 0, F.concat(F.lit(',"loc":"'), F.concat_ws(":", hit["file"], hit["start"], hit["end"]), F.lit('","obs":"'), observed, F.lit('"'))).otherwise("")
    back = F.when(hit["strand"] == 1, ',"str":"-"').otherwise("")
    made = F.concat(F.lit(f'{{"g":"{group.name}","tag":"'), tag, F.lit('"'), place, F.lit(',"sub":'), hit["subs"].cast("string"), F.lit(',"ind":'), hit["indels"].cast("string"), back, F.lit("}"))
    return F.when(hit.isNotNull(), made)


def qc_json(spec: Spec) -> Column:
    """The whole text: version, outcome, what decided it, and the matched groups."""
    groups = F.concat(F.lit('"groups":['), F.array_join(F.array_compact(F.array(*[group_object(g) for g in spec.groups])), ",") if spec.groups else F.lit(""), F.lit("]}"))
    fail = F.col("failure")
    limit = F.concat(F.lit('"reason":"find_constraint","group":'), _text(fail["group"]), F.lit(',"constraint":'), _text(fail["constraint"]), F.lit(',"found":'), fail["found"].cast("string"), F.lit(',"limit":'), fail["limit"].cast("string"), F.lit(","))
    why = (
        F.when(F.col("reason") == "find_constraint", limit)
        .when(F.col("reason") == "missing_stream", F.concat(F.lit('"reason":"missing_stream","stream":'), _text(F.col("missing")), F.lit(",")))
        .otherwise('"reason":"no_sample",')
    )
    rules = [f'"rule":{i},"group":"{r.term.group}",' + (f'"tag":"{r.term.members[0]}",' if r.term.members else "") for i, r in enumerate(spec.removals)]
    gone = F.try_element_at(F.array(*[F.lit(x) for x in rules]), F.col("removal") + 1) if rules else F.lit("")
    middle = (
        F.when(F.col("disposition") == "assigned", F.concat(F.lit('"sample":'), _text(F.col("sample")), F.lit(',"sub_sample":'), _text(F.col("sub_sample")), F.lit(",")))
        .when(F.col("disposition") == "unassigned", why)
        .when(F.col("disposition") == "removed", gone)
        .otherwise("")
    )
    return F.concat(F.lit('{"v":1,"outcome":"'), F.col("disposition"), F.lit('",'), middle, groups)
