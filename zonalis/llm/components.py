"""Distributed connected components by alternating large-star and small-star steps.

Each step is a minimum per node (summed up on the map side), an equi-join and a
distinct, so no neighbourhood is ever gathered in one place.  A node with very many
neighbours only skews the join, which adaptive execution splits.  Every step is
written to the shared folder, so the lineage stays short and a lost
executor costs a reread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges point from the larger node u to the smaller v.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    ``edges`` has two columns of one orderable type; direction, repeats, loops and nulls do not matter.
    """
    a, b = edges.columns
    start = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialise(start, "edges")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark, old = new, now
        now = materialise(_small_star(_large_star(now)), "edges")
        drop_table(now.sparkSession, old.inputFiles()[0].rpartition("/")[0])


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) that join what the pairs (a, b) of 0..n-1 join: fewer than n."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = np.minimum(new, new[root])
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]
