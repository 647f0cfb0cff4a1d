"""Any rows of a tree as a forest of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.build import ANC, REACHED, build
from ..sources.export import json_nodes
from ..spec import NodeKey, TreeSpec, col, scope_key
from .predicates import same_scope


def linked(df: DataFrame, spec: TreeSpec) -> DataFrame:
    """Rows whose parent is not among them are tops: their parent becomes null."""
    p = df.select(scope_key(spec).alias("p_s"), col(spec.id).alias("p_id")).distinct()
    rows = df.withColumn("__s", scope_key(spec)).join(p, (F.col("__s") == F.col("p_s")) & (col(spec.parent) == F.col("p_id")), "left")
    return rows.withColumn(spec.parent, F.when(F.col("p_id").isNotNull(), col(spec.parent))).drop("__s", "p_s", "p_id")


def _numbered(df: DataFrame, spec: TreeSpec, root) -> DataFrame:
    """The linked rows numbered anew, in their old order; below ``root`` (a key, whose
    row need not be there) only, its children being the tops."""
    rows = df.drop(ANC, REACHED)
    if root is None:
        rows = linked(rows, spec)
    else:
        key = root if isinstance(root, NodeKey) else NodeKey(root)
        top = (col(spec.parent) == F.lit(key.id)) & (same_scope(spec, key.scope) if key.scope else F.lit(True))
        rows = rows.filter(col(spec.parent).isNotNull()).withColumn(spec.parent, F.when(~top, col(spec.parent)))
    return build(rows, spec, [spec.lft], always_paths=True).filter(F.col(REACHED)).drop(REACHED)


def flat_tree(df: DataFrame, spec: TreeSpec, root=None) -> DataFrame:
    """Linked rows in pre-order; depth counts from their tops."""
    return _numbered(df, spec, root).drop(ANC).orderBy(*[col(c) for c in spec.scope], col(spec.lft))


def nested_tree(df: DataFrame, spec: TreeSpec, root=None, label: Column | None = None, extras: tuple[str, ...] = ()) -> DataFrame:
    """Linked rows as JSON: (s, id, node), one row for each top with all below it."""
    return json_nodes(_numbered(df, spec, root), spec, label, extras, tops=True).select("s", "id", "node")
