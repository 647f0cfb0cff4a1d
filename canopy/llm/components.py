"""Connected components of a table of links, by large-star and small-star rounds.

Only the links of a round are shuffled, each node's smallest neighbour is a
partial aggregate, and rounds meet in the shared folder.  A hot node is an
ordinary skewed join key, which adaptive execution splits; no group of links
is ever collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from the larger node ``u`` to the smaller ``v``."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns u and v; the result has every linked node with
    the smallest node of its component: columns node and component."""
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, seen = materialise(links, "links"), None
    while True:
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if tuple(mark) == seen or not mark["n"]:
            break
        seen = tuple(mark)
        state = materialise(_small_star(_large_star(state)), "links", instead_of=state)
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def spanning(n: int, pairs) -> np.ndarray:
    """For each of n items the first item that pairs connect it to."""
    parent = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = parent[i], parent[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return parent
