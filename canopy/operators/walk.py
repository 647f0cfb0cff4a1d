"""Walks: orders, pruning filters, position of each visited node, shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.build import ANC, scope_key
from ..plans.ranking import sibling_rank
from ..spec import TreeSpec, col
from .closure import closure, with_paths


class Signal(Enum):
    CONTINUE = 0
    SKIP_SUBTREE = 1
    STOP = 2


@dataclass(frozen=True)
class WalkFilter:
    """``where`` rejects a node with all below it; depth counts from the walk's root."""

    max_depth: int | None = None
    where: Column | None = None
    include_root: bool = True

    def and_then(self, other: WalkFilter) -> WalkFilter:
        depths = [d for d in (self.max_depth, other.max_depth) if d is not None]
        both = self.where & other.where if self.where is not None and other.where is not None else self.where if self.where is not None else other.where
        return WalkFilter(min(depths) if depths else None, both, self.include_root and other.include_root)


def ordered(df: DataFrame, spec: TreeSpec, strategy: str = "pre") -> DataFrame:
    keys = {"pre": [spec.lft], "post": [spec.rgt], "breadth": [spec.depth, spec.lft], "reversed": [spec.lft]}[strategy]
    return df.orderBy(*[col(c) for c in spec.scope], *[col(k).desc() if strategy == "reversed" else col(k) for k in keys])


def filtered(df: DataFrame, spec: TreeSpec, walk: WalkFilter) -> DataFrame:
    """Nodes that a walk with this filter visits."""
    rows = with_paths(df, spec)
    top = rows.groupBy(scope_key(spec).alias("t_s")).agg(F.min(col(spec.depth)).alias("__top"))
    out = rows.withColumn("__s", scope_key(spec)).join(top, F.col("__s") == F.col("t_s")).drop("t_s")
    if walk.where is not None:
        bad = rows.filter(~F.coalesce(walk.where, F.lit(False))).select(scope_key(spec).alias("b_s"), col(spec.id).alias("b_id"))
        pairs = closure(rows, spec)
        pruned = pairs.join(bad, (pairs.s == bad.b_s) & (pairs.anc == bad.b_id), "left_semi").select(F.col("s").alias("x_s"), col(spec.id).alias("x_id")).distinct()
        out = out.join(pruned, (F.col("__s") == F.col("x_s")) & (col(spec.id) == F.col("x_id")), "left_anti")
    if walk.max_depth is not None:
        out = out.filter(col(spec.depth) - F.col("__top") <= walk.max_depth)
    if not walk.include_root:
        out = out.filter(col(spec.depth) > F.col("__top"))
    return out.drop("__s", "__top")


def with_context(df: DataFrame, spec: TreeSpec) -> DataFrame:
    """Rows with walk_depth, sibling_index, sibling_count, is_first, is_last and
    path_to_root (ids between the root and the node, both excluded)."""
    rows = with_paths(df, spec)
    top = rows.groupBy(scope_key(spec).alias("t_s")).agg(F.min(col(spec.depth)).alias("__top"))
    j = rows.withColumn("__s", scope_key(spec)).join(top, F.col("__s") == F.col("t_s"))
    out = sibling_rank(j, spec, [col(spec.lft)], "sibling_index", "sibling_count").withColumn("walk_depth", (col(spec.depth) - F.col("__top")).cast("int"))
    inner = F.slice(ANC, F.lit(2), F.greatest(F.size(ANC) - 2, F.lit(0)))
    return out.withColumns({"is_first": F.col("sibling_index") == 0, "is_last": F.col("sibling_index") == F.col("sibling_count") - 1, "path_to_root": inner}).drop("__s", "t_s", "__top")


def shape(df: DataFrame, spec: TreeSpec) -> DataFrame:
    """One row: nodes, greatest depth below the shallowest node, leaves."""
    leaf = (col(spec.rgt) == col(spec.lft) + 1).cast("long")
    return df.agg(F.count(F.lit(1)).alias("nodes"), (F.max(col(spec.depth)) - F.min(col(spec.depth))).cast("int").alias("max_depth"), F.sum(leaf).alias("leaves"))


def visit(df: DataFrame, spec: TreeSpec, visitor: Callable[[Row], Signal | None], strategy: str = "pre", walk: WalkFilter | None = None) -> Iterator[Row]:
    """Rows in walk order, one partition at a time, until the visitor stops; after
    SKIP_SUBTREE nothing below that node comes (pre-order and breadth-first).  What
    ``walk`` prunes never leaves the executors."""
    if walk is not None:
        df = filtered(df, spec, walk)
    skipped: dict[tuple, list[tuple[int, int]]] = {}
    for row in ordered(df.drop(ANC), spec, strategy).toLocalIterator(prefetchPartitions=True):
        scope = tuple(row[c] for c in spec.scope)
        lft = row[spec.lft]
        if any(a < lft < z for a, z in skipped.get(scope, ())):
            continue
        signal = visitor(row)
        yield row
        if signal is Signal.STOP:
            return
        if signal is Signal.SKIP_SUBTREE:
            kept = [(a, z) for a, z in skipped.get(scope, []) if strategy != "pre" or z > lft]
            skipped[scope] = [*kept, (lft, row[spec.rgt])]


def top_level(df: DataFrame, spec: TreeSpec) -> DataFrame:
    """Nodes whose parent is not among the rows: tops of the linked collection."""
    p = df.select(scope_key(spec).alias("p_s"), col(spec.id).alias("p_id"))
    rows = df.withColumn("__s", scope_key(spec))
    return rows.join(p, (F.col("__s") == F.col("p_s")) & (col(spec.parent) == F.col("p_id")), "left_anti").drop("__s")
