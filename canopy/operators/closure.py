"""Ancestor closure: one row for each node and each of its ancestors or itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.build import ANC, REACHED, build, scope_key
from ..spec import TreeSpec, col


def with_paths(df: DataFrame, spec: TreeSpec) -> DataFrame:
    """``df`` with root paths; they are derived where it lacks them.  Intervals that
    the rows already have are kept.  Both tables have a row for each node, so the join
    asks to be merged."""
    if ANC in df.columns:
        return df
    made = build(df.select(*dict.fromkeys([*spec.scope, spec.id, spec.parent])), spec, always_paths=True)
    paths = made.select(scope_key(spec).alias("__p_s"), col(spec.id).alias("__p_node"), ANC, REACHED)
    rows = df.drop(REACHED).withColumn("__s", scope_key(spec))
    joined = rows.join(paths.hint("merge"), (F.col("__s") == F.col("__p_s")) & (col(spec.id) == F.col("__p_node")), "left")
    return joined.drop("__s", "__p_s", "__p_node")


def closure(df: DataFrame, spec: TreeSpec, columns: list[str] | None = None) -> DataFrame:
    """Rows (s, anc, dist, node columns): dist is 0 for the node itself.  Only the
    columns asked for are carried through."""
    rows = with_paths(df, spec)
    picked = rows.select(scope_key(spec).alias("s"), F.col(ANC).alias("__path"), *[col(c) for c in (columns or [spec.id])])
    out = picked.select("*", F.posexplode("__path").alias("__pos", "anc"))
    return out.withColumn("dist", F.size("__path") - 1 - F.col("__pos")).drop("__path", "__pos")
