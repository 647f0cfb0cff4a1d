"""Ranks and running sums over a whole table without one task that sees all rows.

Rows are range-partitioned by the order; each partition numbers or sums its own
rows, and the totals of the partitions before it are added.  Only one row for
each partition goes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import TreeSpec, col, scope_key
from .scratch import materialise

PART, INDEX = "__part", "__index"


def _ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(INDEX, F.monotonically_increasing_id())
    out = materialise(ranged, "ordered")
    return out.withColumn(PART, F.shiftright(INDEX, 33)).withColumn(INDEX, F.col(INDEX).bitwiseAND(F.lit((1 << 33) - 1)))


def _before(totals: DataFrame, names: list[str]) -> DataFrame:
    w = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(PART, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"{n}_before") for n in names])


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the 0-based rank of each row in ``order``."""
    rows = _ordered(df, order)
    starts = _before(rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")), ["n"])
    return rows.join(starts, PART).withColumn(name, (F.col(INDEX) + F.col("n_before")).cast("long")).drop(PART, INDEX, "n_before")


def sibling_rank(df: DataFrame, spec: TreeSpec, order: list[Column], index: str, count: str | None = None) -> DataFrame:
    """``df`` with each row's 0-based place among the rows of its scope and parent, and
    their number.  All roots share a parent, as may millions of children: ranks are
    global ones less the least of the group, so that no task holds a whole group."""
    s, up = scope_key(spec), col(spec.parent)
    ranked = global_rank(df.withColumns({"__sib_s": s, "__sib_up": F.coalesce(F.to_json(F.struct(up.alias("p"))), F.lit(""))}), [F.col("__sib_s"), F.col("__sib_up"), *order], "__sib_r")
    first = ranked.groupBy("__sib_s", "__sib_up").agg(F.min("__sib_r").alias("__sib_first"), F.count(F.lit(1)).alias("__sib_n"))
    j = ranked.join(first, ["__sib_s", "__sib_up"])
    out = j.withColumn(index, (F.col("__sib_r") - F.col("__sib_first")).cast("long"))
    if count:
        out = out.withColumn(count, F.col("__sib_n").cast("long"))
    return out.drop("__sib_s", "__sib_up", "__sib_r", "__sib_first", "__sib_n")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums of the given columns in ``order``."""
    rows = _ordered(df.withColumns(sums), order)
    names = list(sums)
    starts = _before(rows.groupBy(PART).agg(*[F.sum(n).alias(n) for n in names]), names)
    w = Window.partitionBy(PART).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})
    joined = local.join(starts, PART)
    return joined.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in names}).drop(PART, INDEX, *[f"{n}_before" for n in names])
