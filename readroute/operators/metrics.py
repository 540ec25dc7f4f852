"""Metrics of a run: one row for each target, and one for the pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readroute.operators.extract import unextracted
from readroute.plans.analyze import targets
from readroute.plans.spec import Spec

#: Share of unassigned fragments from which a run deserves a warning.
WARN_UNASSIGNED = 0.20


def fraction(n: Column, d: Column) -> Column:
    """n / d, 0 if d is, as text of six decimals."""
    return F.format_string("%.6f", F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0)))


def with_unextracted(df: DataFrame, spec: Spec, files: int) -> DataFrame:
    total, left = unextracted(spec, files)
    out = F.col("disposition").isin("assigned", "pass_through")
    return df.withColumns({"bases_routed": F.when(out, total).otherwise(0).cast("long"), "bases_left": F.when(out, left).otherwise(0).cast("long")})


def totals(df: DataFrame, files: int) -> DataFrame:
    """(target, disposition, reads, routed, left, n0, len0, n1, ...): all that the reports need, from one pass; a row for each target and disposition."""
    length = [F.length(F.try_element_at("reads", F.lit(k + 1))["bases"]).cast("long") for k in range(files)]
    return df.groupBy("target", "disposition").agg(
        F.count("*").alias("reads"), F.sum("bases_routed").alias("routed"), F.sum("bases_left").alias("left"),
        *[F.count(x).alias(f"n{k}") for k, x in enumerate(length)], *[F.sum(x).alias(f"len{k}") for k, x in enumerate(length)],
    )


def per_sample(sums: DataFrame, spec: Spec) -> DataFrame:
    """(target, pool, sample, sub_sample, reads, frac_of_pool, frac_bases_unextracted) of totals(), a row for every declared target."""
    names = targets(spec)
    declared = sums.sparkSession.createDataFrame([(i, s, b) for i, (s, b) in enumerate(names)], "target int, sample string, sub_sample string")
    both = sums.select("target", "reads", "routed", "left").unionByName(declared, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    each = both.groupBy("target").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("reads", "routed", "left")], F.max("sample").alias("sample"), F.max("sub_sample").alias("sub_sample"))
    whole = each.withColumn("total", F.sum("reads").over(Window.partitionBy())).filter("target is not null")  # a row for each target
    return whole.select("target", F.lit(spec.pool).alias("pool"), "sample", "sub_sample", "reads", fraction(F.col("reads"), F.col("total")).alias("frac_of_pool"), fraction(F.col("left"), F.col("routed")).alias("frac_bases_unextracted"))


def summary(sums: DataFrame, spec: Spec, files: int) -> DataFrame:
    """One row of totals(): counts of fragments by disposition, shares, and mean read lengths (rounded half up) by input."""
    zero = F.lit(0).cast("long")
    count = lambda what: F.coalesce(F.sum(F.when(F.col("disposition") == what, F.col("reads"))), zero)

    def mean_length(k: int) -> Column:
        n, total = F.coalesce(F.sum(f"n{k}"), zero), F.coalesce(F.sum(f"len{k}"), zero)
        return F.when(n > 0, F.floor((total + F.floor(n / 2)) / n)).otherwise(0).cast("string")

    row = sums.agg(
        F.coalesce(F.sum("reads"), zero).alias("total_reads"), count("assigned").alias("reads_assigned"), count("pass_through").alias("reads_pass_through"), count("unassigned").alias("reads_unassigned"), count("removed").alias("reads_removed"),
        F.coalesce(F.sum("routed"), zero).alias("routed"), F.coalesce(F.sum("left"), zero).alias("left"), F.concat_ws(",", *[mean_length(k) for k in range(files)]).alias("mean_read_len_by_input"),
    )
    return row.select(
        F.lit(spec.pool).alias("pool"), "total_reads", "reads_assigned", "reads_pass_through", "reads_unassigned", "reads_removed",
        fraction(F.col("reads_assigned"), F.col("total_reads")).alias("frac_assigned"), fraction(F.col("left"), F.col("routed")).alias("frac_bases_unextracted"), "mean_read_len_by_input",
    )
