"""Row predicates on intervals: plain columns, so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import NodeBounds, TreeSpec, col


def descendant_of(spec: TreeSpec, b: NodeBounds) -> Column:
    return (col(spec.lft) > b.lft) & (col(spec.rgt) < b.rgt)


def descendant_or_self(spec: TreeSpec, b: NodeBounds) -> Column:
    return col(spec.lft).between(b.lft, b.rgt)


def ancestor_of(spec: TreeSpec, b: NodeBounds) -> Column:
    return (col(spec.lft) < b.lft) & (col(spec.rgt) > b.rgt)


def ancestor_or_self(spec: TreeSpec, b: NodeBounds) -> Column:
    return (col(spec.lft) <= b.lft) & (col(spec.rgt) >= b.rgt)


def is_root(spec: TreeSpec) -> Column:
    return col(spec.parent).isNull()


def is_placed(spec: TreeSpec) -> Column:
    return (col(spec.lft) > 0) & (col(spec.rgt) > col(spec.lft))


def has_leaf_bounds(spec: TreeSpec) -> Column:
    return col(spec.rgt) == col(spec.lft) + 1


def is_leaf(spec: TreeSpec) -> Column:
    """Placed and without descendants; an unplaced row is no leaf."""
    return is_placed(spec) & has_leaf_bounds(spec)


def is_after(spec: TreeSpec, b: NodeBounds) -> Column:
    return col(spec.lft) > b.rgt


def is_before(spec: TreeSpec, b: NodeBounds) -> Column:
    return col(spec.rgt) < b.lft


def same_scope(spec: TreeSpec, values: tuple) -> Column:
    out = F.lit(True)
    for name, value in zip(spec.scope, values):
        out = out & col(name).eqNullSafe(F.lit(value))
    return out


def interval_width(spec: TreeSpec) -> Column:
    return col(spec.rgt) - col(spec.lft) + 1


def descendant_count(spec: TreeSpec) -> Column:
    return ((col(spec.rgt) - col(spec.lft) - 1) / 2).cast("long")
