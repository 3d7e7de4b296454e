"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.storage import drop, store


def local_roots(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """For nodes 0..size-1 the smallest node that the edges (left, right) reach."""
    root = np.arange(size)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component), component being the smallest node reachable.

    Alternates large-star and small-star rounds (each node's larger, then smaller, neighbours move to the
    smallest neighbour) until the edge set no longer changes.  Every round is an aggregation with map-side
    combine and an equi-join, so a hub of any degree is handled; each is stored, so a lost executor costs one
    round at most.  Nodes without an edge, self-loops and edges with a null end have no row in the result.
    """
    now = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct("u", F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        after = store(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        drop(now)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
