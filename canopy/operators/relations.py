"""Joins along the tree.  Nothing here joins on an inequality: relatives of many
nodes come from the ancestor closure by equality of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.build import ANC, scope_key
from ..spec import TreeSpec, col
from .closure import closure, with_paths


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[col(c).alias(f"{prefix}{c}") for c in df.columns if c != ANC])


def parents(df: DataFrame, spec: TreeSpec, prefix: str = "parent_") -> DataFrame:
    """Every row with its parent's columns under ``prefix``; nulls for roots."""
    p = _renamed(df.withColumn("__s", scope_key(spec)), prefix)
    rows = df.withColumn("__s", scope_key(spec))
    on = (col(spec.parent) == col(f"{prefix}{spec.id}")) & (F.col("__s") == col(f"{prefix}__s"))
    return rows.join(p, on, "left").drop("__s", f"{prefix}__s")


def children(df: DataFrame, spec: TreeSpec, prefix: str = "child_") -> DataFrame:
    """Pairs of a row and each of its children, whatever the child's scope."""
    c = _renamed(df, prefix)
    return df.join(c, col(spec.id) == col(f"{prefix}{spec.parent}"))


def related(df: DataFrame, spec: TreeSpec, descendants: bool, anchors: DataFrame | None = None) -> DataFrame:
    """Pairs (s, node, relative, dist) of strict descendants or ancestors, of all
    nodes or of the ids in ``anchors``."""
    pairs = closure(df, spec).filter("dist > 0")
    below = col(spec.id)
    out = pairs.select("s", F.col("anc").alias("node"), below.alias("relative"), "dist") if descendants else pairs.select("s", below.alias("node"), F.col("anc").alias("relative"), "dist")
    return out.join(anchors.select(col(spec.id).alias("node")).distinct(), "node", "left_semi") if anchors is not None else out


def eager(df: DataFrame, spec: TreeSpec, descendants: bool, anchors: DataFrame) -> DataFrame:
    """Per anchor the ids of its relatives in pre-order, as an array."""
    order = df.select(scope_key(spec).alias("r_s"), col(spec.id).alias("r_id"), col(spec.lft).alias("r_lft"))
    pairs = related(df, spec, descendants, anchors)
    j = pairs.join(order, (F.col("s") == F.col("r_s")) & (F.col("relative") == F.col("r_id")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r_lft", "relative"))), lambda x: x["relative"])
    return j.groupBy("s", "node").agg(ids.alias("relatives"))


def having(df: DataFrame, spec: TreeSpec, descendants: bool, where: Column | None = None, absent: bool = False) -> DataFrame:
    """Rows that have (or lack) a relative for which ``where`` holds."""
    rows = with_paths(df, spec)
    pick = rows if where is None else rows.filter(where)
    if descendants:
        keys = closure(pick, spec).filter("dist > 0").select(F.col("s").alias("k_s"), F.col("anc").alias("k")).distinct()
    else:
        hit = pick.select(scope_key(spec).alias("h_s"), col(spec.id).alias("h"))
        pairs = closure(rows, spec).filter("dist > 0")
        keys = pairs.join(hit, (pairs.s == hit.h_s) & (pairs.anc == hit.h), "left_semi").select(F.col("s").alias("k_s"), col(spec.id).alias("k")).distinct()
    tagged = rows.withColumn("__s", scope_key(spec))
    return tagged.join(keys, (F.col("__s") == F.col("k_s")) & (col(spec.id) == F.col("k")), "left_anti" if absent else "left_semi").drop("__s")


def counted(df: DataFrame, spec: TreeSpec, descendants: bool, name: str, where: Column | None = None) -> DataFrame:
    """Rows with the number of their relatives for which ``where`` holds."""
    rows = with_paths(df, spec)
    if descendants:
        pick = rows if where is None else rows.filter(where)
        n = closure(pick, spec).filter("dist > 0").groupBy(F.col("s").alias("k_s"), F.col("anc").alias("k")).agg(F.count(F.lit(1)).alias("__n"))
    else:
        hit = (rows if where is None else rows.filter(where)).select(scope_key(spec).alias("h_s"), col(spec.id).alias("h"))
        pairs = closure(rows, spec).filter("dist > 0")
        n = pairs.join(hit, (pairs.s == hit.h_s) & (pairs.anc == hit.h), "left_semi").groupBy(F.col("s").alias("k_s"), col(spec.id).alias("k")).agg(F.count(F.lit(1)).alias("__n"))
    tagged = rows.withColumn("__s", scope_key(spec))
    out = tagged.join(n, (F.col("__s") == F.col("k_s")) & (col(spec.id) == F.col("k")), "left")
    return out.withColumn(name, F.coalesce("__n", F.lit(0)).cast("long")).drop("__s", "k_s", "k", "__n")


def orphans(df: DataFrame, spec: TreeSpec) -> DataFrame:
    """Rows whose parent is not in their scope."""
    p = df.select(scope_key(spec).alias("p_s"), col(spec.id).alias("p_id"))
    rows = df.filter(col(spec.parent).isNotNull()).withColumn("__s", scope_key(spec))
    return rows.join(p, (F.col("__s") == F.col("p_s")) & (col(spec.parent) == F.col("p_id")), "left_anti").drop("__s")


def siblings(df: DataFrame, spec: TreeSpec, following: bool, name: str) -> DataFrame:
    """Rows with the id of the adjacent sibling; null at the edge and across a gap.  The
    sibling begins where the row ends, or ends where it begins: an equality join."""
    mine, theirs = (spec.rgt, spec.lft) if following else (spec.lft, spec.rgt)
    o = df.select(scope_key(spec).alias("o_s"), col(spec.parent).alias("o_up"), col(theirs).alias("o_at"), col(spec.id).alias("o_id"))
    o = o.groupBy("o_s", "o_up", "o_at").agg(F.min("o_id").alias("o_id"))
    at = col(mine) + (1 if following else -1)
    rows = df.withColumn("__s", scope_key(spec))
    on = (F.col("__s") == F.col("o_s")) & (at == F.col("o_at")) & col(spec.parent).eqNullSafe(F.col("o_up"))
    return rows.join(o, on, "left").withColumn(name, F.col("o_id")).drop("__s", "o_s", "o_up", "o_at", "o_id")
