"""The registry of queries, and what several of them share: synthetic reads of the tables' keys.

The tables hold no sequencing reads, so each key gives synthetic ones: the hex digits of
an md5, mapped to bases and to qualities, the same in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.plans.analyze import analyze
from readroute.plans.demux import Demux
from readroute.plans.spec import parse
from readroute.sources.reads import from_columns

HEX, BASES, QUALS = "0123456789abcdef", "ACGTACGTACGTACGT", "!#+5:?ABCDEFGHIJ"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_READS = f"""WITH RECURSIVE r AS (SELECT o_orderkey AS fid,
  translate(md5(o_orderkey || ':1'), '{HEX}', '{BASES}') AS b1, translate(md5(o_orderkey || ':q1'), '{HEX}', '{QUALS}') AS q1,
  translate(md5(o_orderkey || ':2'), '{HEX}', '{BASES}') AS b2, translate(md5(o_orderkey || ':q2'), '{HEX}', '{QUALS}') AS q2 FROM orders)
"""


def query(name: str, sql: str | None = None):
    """Registers a query; its SQL follows the reads `r` unless it is whole."""

    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql if sql.lstrip().startswith("WITH") else SQL_READS + sql
        return run

    return keep


def synthetic(key: Column, part: str, alphabet: str) -> Column:
    return F.translate(F.md5(F.concat(key.cast("string"), F.lit(f":{part}")).cast("binary")), HEX, alphabet)


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores, if a small file gives fewer."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *df.columns) if df.rdd.getNumPartitions() < n else df


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two synthetic reads for each order."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    key = F.col("o_orderkey")
    one = lambda k: (F.concat(F.lit("o"), key.cast("string"), F.lit(f"/{k}")), synthetic(key, f"{k}", BASES), synthetic(key, f"q{k}", QUALS))
    return from_columns(orders, key, one(1), one(2))


def run(spark: SparkSession, sf_dir: str, **spec) -> Demux:
    return Demux(fragments(spark, sf_dir), analyze(parse(**spec)), 2)


def longs(struct: str, *names: str) -> list[Column]:
    """Fields of a struct column as longs under their own names."""
    return [F.col(f"{struct}.{n}").cast("long").alias(n) for n in names]
