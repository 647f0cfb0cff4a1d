"""Synthetic trees by arithmetic on a range of numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError


def uniform(spark: SparkSession, depth: int, branching: int | list[int] | Callable[[int], int], roots: int = 1) -> DataFrame:
    """Complete trees: ids from 1 in breadth-first order, with parent ids.  Branching
    is one number, one for each level, or a function of the level."""
    widths = [branching] * (depth - 1) if isinstance(branching, int) else branching[: depth - 1] if isinstance(branching, list) else [branching(i) for i in range(depth - 1)]
    if depth < 1 or len(widths) < depth - 1 or any(w < 0 for w in widths):
        raise ConfigurationError("a tree needs a branching number for each level but the last")
    out, first, count = None, 1, roots
    for level in range(depth):
        n = spark.range(first, first + count)
        parent = F.lit(None).cast("long") if level == 0 else (F.floor((F.col("id") - first) / widths[level - 1]) + above).cast("long")
        part = n.select("id", parent.alias("parent_id"), F.lit(level).alias("level"))
        out = part if out is None else out.union(part)
        above, first = first, first + count
        count *= widths[level] if level < depth - 1 else 1
        if not count:
            break
    return out


def chain(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))


def flat_roots(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select("id", F.lit(None).cast("long").alias("parent_id"))


def wide_root(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select("id", F.when(F.col("id") > 1, F.lit(1)).cast("long").alias("parent_id"))


def comb(spark: SparkSession, n: int) -> DataFrame:
    """A spine of odd ids; each has a leaf of the next even id."""
    k = F.col("id")
    return spark.range(1, n + 1).select("id", F.when(k % 2 == 0, k - 1).when(k > 1, k - 2).alias("parent_id"))


def forest(spark: SparkSession, n: int, trees: int) -> DataFrame:
    """Trees of mixed sizes: the first ids are roots, later ones hang from an earlier
    id that a hash picks."""
    k = F.col("id")
    return spark.range(1, n + 1).select("id", F.when(k > trees, F.pmod(F.xxhash64(k), k - 1) + 1).cast("long").alias("parent_id"))


def from_shape(spark: SparkSession, shape: list) -> DataFrame:
    """Nested lists of children, such as [[[], []], []], as rows in walk order."""
    rows: list[tuple[int, int | None]] = []

    def add(children: list, parent: int | None) -> None:
        for c in children:
            rows.append((len(rows) + 1, parent))
            add(c, rows[-1][0])

    add(shape, None)
    return spark.createDataFrame(rows, "id long, parent_id long")
