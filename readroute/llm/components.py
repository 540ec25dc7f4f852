"""Connected components of an edge table by alternating large and small stars.

Each round is grouped minima and joins, so a node of any degree is spread over tasks;
edges only ever point to smaller nodes, and the rounds end when no edge changes
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014). An edge table of
at most LOCAL_EDGES rows is finished by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readroute.llm.common import materialize


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of an edge list that aren't the least."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


#: Edges up to which one task finds the components of what is left.
LOCAL_EDGES = 500_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(np.array(b.column(0)), np.array(b.column(1))) for b in batches]
    if rows:
        node, root = local_forest(*(np.concatenate([r[k] for r in rows]) for k in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is its least node.

    `edges` are (u, v) longs in any direction; loops and repeats do no harm.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.count() <= LOCAL_EDGES:
        return _with_roots(materialize(now.repartition(1).mapInArrow(_local, "u long, v long")))
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if row == mark:
            break
        mark = row
    return _with_roots(now)


def _with_roots(now: DataFrame) -> DataFrame:
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
