"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespan.llm._shared import remove, table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node with an edge to another one.

    Large-star and small-star steps alternate until nothing changes; that takes about the logarithm of the
    longest path. Each round is written to the shared folder, and the one before it is deleted. Minima are partly aggregated before they are
    dealt, and joins can be split where a node has very many edges.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    state = last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = table(small.where("u <> v").distinct(), "components")
        if last is not None:
            remove(last)
        last = now
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same connected components as the edges (a, b), one fewer than nodes in each component."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        differ = lx != ly
        if not differ.any():
            break
        np.minimum.at(label, np.maximum(lx, ly)[differ], np.minimum(lx, ly)[differ])
        while (label[label] != label).any():
            label = label[label]
        x, y = x[differ], y[differ]
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[inner], nodes[label[inner]]
