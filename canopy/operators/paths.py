"""Materialised paths: a column with the segments from the root to the node.

Every table that is joined here has a row for each node.  The planner takes it for
as small as its compressed files and would send it whole through the driver, so
the joins ask to be merged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateSegmentError, EmptySegmentError, InvalidSegmentError, PathTooLongError
from ..functions.scalars import rewrite_prefix, slug
from ..plans.build import ANC, scope_key
from ..spec import TreeSpec, col
from . import mutate
from .closure import closure, with_paths
from .predicates import descendant_or_self, same_scope


@dataclass(frozen=True)
class PathSpec:
    """Where segments come from and how they are joined."""

    column: str
    segment: Column
    separator: str = "/"
    wrap: bool = True
    max_length: int = 1024
    reject_separator: bool = True
    unique_per_parent: bool = True

    @staticmethod
    def key(column: str, spec: TreeSpec, **options) -> PathSpec:
        return PathSpec(column, col(spec.id).cast("string"), **options)

    @staticmethod
    def attribute(column: str, name: str, **options) -> PathSpec:
        return PathSpec(column, col(name).cast("string"), **options)

    @staticmethod
    def slug(column: str, name: str, **options) -> PathSpec:
        return PathSpec(column, slug(col(name).cast("string")), **options)

    @staticmethod
    def of(column: str, segment: Column, **options) -> PathSpec:
        return PathSpec(column, segment, **options)

    def with_options(self, **options) -> PathSpec:
        return replace(self, **options)

    def clean(self) -> Column:
        return self.segment if self.reject_separator else F.replace(self.segment, F.lit(self.separator), F.lit(""))

    def joined(self, segments: Column) -> Column:
        body = F.array_join(segments, self.separator)
        return F.concat(F.lit(self.separator), body, F.lit(self.separator)) if self.wrap else body


def assemble(df: DataFrame, spec: TreeSpec, path: PathSpec) -> DataFrame:
    """``df`` with ``path.column`` fresh; rows that no root reaches keep null."""
    rows = with_paths(df, spec).withColumn("__seg", path.clean())
    seg = rows.select(scope_key(spec).alias("g_s"), col(spec.id).alias("g_id"), F.col("__seg").alias("g"))
    pairs = closure(rows, spec)
    got = pairs.join(seg.hint("merge"), (pairs.s == seg.g_s) & (pairs.anc == seg.g_id))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("d"), F.col("g")))), lambda x: x["g"])
    made = got.groupBy(F.col("s").alias("m_s"), col(spec.id).alias("m_id")).agg(path.joined(ordered).alias("__path_made"))
    tagged = df.withColumn("__s", scope_key(spec)).join(made.hint("merge"), (F.col("__s") == F.col("m_s")) & (col(spec.id) == F.col("m_id")), "left")
    keep = [c for c in df.columns if c != path.column]
    return tagged.select(*[col(c) for c in keep], F.col("__path_made").alias(path.column))


def problems(df: DataFrame, spec: TreeSpec, path: PathSpec) -> DataFrame:
    """Rows (id, problem): empty, separator, too_long (bytes of the whole path) or
    duplicate (a sibling has the same segment)."""
    rows = assemble(df, spec, path).withColumn("__seg", path.clean())
    group = rows.groupBy(scope_key(spec).alias("d_s"), col(spec.parent).alias("d_up"), F.col("__seg").alias("d_seg")).agg(F.count(F.lit(1)).alias("d_n")).filter("d_n > 1")
    on = (scope_key(spec) == F.col("d_s")) & col(spec.parent).eqNullSafe(F.col("d_up")) & F.col("__seg").eqNullSafe(F.col("d_seg"))
    marked = rows.join(group.hint("merge"), on, "left").withColumn("__twice", F.col("d_n").isNotNull() if path.unique_per_parent else F.lit(False))
    kind = (
        F.when(F.coalesce(F.col("__seg"), F.lit("")) == "", "empty")
        .when(F.contains(F.col("__seg"), F.lit(path.separator)), "separator")
        .when(F.octet_length(F.col(path.column)) > path.max_length, "too_long")
        .when(F.col("__twice"), "duplicate")
    )
    return marked.select(col(spec.id).alias("id"), kind.alias("problem")).filter("problem is not null")


_RAISED = {"empty": EmptySegmentError, "separator": InvalidSegmentError, "too_long": PathTooLongError, "duplicate": DuplicateSegmentError}


def validated(df: DataFrame, spec: TreeSpec, path: PathSpec) -> DataFrame:
    """``assemble``, after a check that raises for the first problem found."""
    bad = problems(df, spec, path).orderBy("problem", "id").limit(1).collect()
    if bad:
        raise _RAISED[bad[0]["problem"]](bad[0]["id"])
    return assemble(df, spec, path)


def rewritten(df: DataFrame, spec: TreeSpec, path: PathSpec, key, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` renames or moves the node ``key``; the stored paths of it and all below
    it follow by a rewrite of their prefix, found by bounds.  Other paths are not
    touched, and no path is assembled from segments but the node's own."""
    before = mutate.node(df, spec, key)
    own = mutate.key_of(before, spec)
    out = change(df)
    after = mutate.node(out.withColumn("__seg", path.clean()), spec, own)
    edge, old = path.separator if path.wrap else "", before[path.column]
    if after[spec.parent] is None:
        head = edge
    else:
        up = mutate.node(out, spec, mutate.NodeKey(after[spec.parent], own.scope))[path.column]
        head = up if path.wrap else up + path.separator
    new = f"{head}{after['__seg'] or ''}{edge}"
    if new == old:
        return out
    rest = path.separator if not path.wrap else ""
    hit = same_scope(spec, own.scope) & descendant_or_self(spec, mutate.bounds_of(after, spec))
    below = rewrite_prefix(col(path.column), F.lit(old + rest), F.lit(new + rest))
    made = F.when(mutate.has_key(spec, own), F.lit(new)).otherwise(below)
    return out.withColumn(path.column, F.when(hit, made).otherwise(col(path.column)))


def fix_paths(df: DataFrame, spec: TreeSpec, path: PathSpec, anchor=None) -> tuple[DataFrame, int]:
    """Fresh paths and the number of rows whose stored path was wrong; of the anchor
    and what lies below it only, where it is given."""
    fresh = assemble(df, spec, path)
    if anchor is not None:
        row = mutate.node(df, spec, anchor)
        hit = same_scope(spec, mutate.scope_of(row, spec)) & descendant_or_self(spec, mutate.bounds_of(row, spec))
        made = fresh.select(scope_key(spec).alias("f_s"), col(spec.id).alias("f_id"), col(path.column).alias("f_path"))
        j = df.withColumn("__s", scope_key(spec)).join(made.hint("merge"), (F.col("__s") == F.col("f_s")) & (col(spec.id) == F.col("f_id")), "left")
        fresh = j.withColumn(path.column, F.when(hit, F.col("f_path")).otherwise(col(path.column))).select(*[col(c) for c in df.columns])
    old = df.select(scope_key(spec).alias("o_s"), col(spec.id).alias("o_id"), col(path.column).alias("o_path"))
    j = fresh.withColumn("__s", scope_key(spec)).join(old.hint("merge"), (F.col("__s") == F.col("o_s")) & (col(spec.id) == F.col("o_id")))
    return fresh, j.filter(~col(path.column).eqNullSafe(F.col("o_path"))).count()


__all__ = ["ANC", "PathSpec", "assemble", "fix_paths", "problems", "rewritten", "validated"]
