"""Comparison of two snapshots of a tree, and applying the result.  An identity
belongs to its scope: in scoped trees all tables here carry the scope columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, CyclicMoveError, DanglingParentError, DuplicateIdentityError
from ..plans.build import ANC, REACHED, build
from ..plans.ranking import sibling_rank
from ..spec import TreeSpec, col, scope_key


@dataclass(frozen=True)
class TreeDiff:
    """Four tables: added and removed rows, moves (old and new parent and sibling
    position) and changed columns as JSON of old and new values."""

    added: DataFrame
    removed: DataFrame
    moved: DataFrame
    modified: DataFrame
    on: str
    spec: TreeSpec

    def summary(self) -> dict[str, int]:
        return {n: getattr(self, n).count() for n in ("added", "removed", "moved", "modified")}

    def is_empty(self) -> bool:
        return all(getattr(self, n).isEmpty() for n in ("added", "removed", "moved", "modified"))

    def invert(self) -> TreeDiff:
        own = [col(c) for c in self.spec.scope]
        back = self.moved.select(*own, "id", F.col("new_parent").alias("old_parent"), F.col("old_parent").alias("new_parent"), F.col("new_position").alias("old_position"), F.col("old_position").alias("new_position"))
        changed = self.modified.select(*own, "id", F.col("new_values").alias("old_values"), F.col("old_values").alias("new_values"))
        return TreeDiff(self.removed, self.added, back, changed, self.on, self.spec)

    def to_rows(self) -> DataFrame:
        """All changes as rows (kind, id, before, after) with JSON values."""
        none = F.lit(None).cast("string")
        own = F.to_json(F.struct(*[col(c) for c in self.added.columns if c not in (ANC, REACHED)]))
        place = [F.to_json(F.struct(F.col(f"{w}_parent").alias("parent"), F.col(f"{w}_position").alias("position"))) for w in ("old", "new")]
        return (
            self.added.select(F.lit("added").alias("kind"), col(self.on).cast("string").alias("id"), none.alias("before"), own.alias("after"))
            .union(self.removed.select(F.lit("removed"), col(self.on).cast("string"), own, none))
            .union(self.moved.select(F.lit("moved"), F.col("id").cast("string"), *place))
            .union(self.modified.select(F.lit("modified"), F.col("id").cast("string"), "old_values", "new_values"))
        )


def _check(df: DataFrame, spec: TreeSpec, on: str, name: str) -> None:
    if on not in df.columns:
        raise ConfigurationError(f"{name} has no column {on}")
    if not df.groupBy(scope_key(spec), col(on)).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | col(on).isNull()).isEmpty():
        raise DuplicateIdentityError(f"{name} has rows with equal or no {on}")
    if not _homeless(df, spec).isEmpty():
        raise DanglingParentError(f"{name} has rows whose parent is missing")


def _homeless(df: DataFrame, spec: TreeSpec) -> DataFrame:
    keys = df.select(scope_key(spec).alias("p_s"), col(spec.id).alias("p"))
    rows = df.filter(col(spec.parent).isNotNull()).withColumn("__s", scope_key(spec))
    return rows.join(keys, (F.col("__s") == F.col("p_s")) & (col(spec.parent) == F.col("p")), "left_anti")


def _without(rows: DataFrame, others: DataFrame, spec: TreeSpec, on: str) -> DataFrame:
    """Rows whose identity the others lack in their scope."""
    k = others.select(scope_key(spec).alias("k_s"), col(on).alias("k"))
    return rows.withColumn("__s", scope_key(spec)).join(k, (F.col("__s") == F.col("k_s")) & (col(on) == F.col("k")), "left_anti").drop("__s")


def _positioned(df: DataFrame, spec: TreeSpec, on: str) -> DataFrame:
    """Rows with the identity of their parent and their place among siblings, by lft
    where the table has it, else by id."""
    order = spec.lft if spec.lft in df.columns else spec.id
    p = df.select(scope_key(spec).alias("p_s"), col(spec.id).alias("p_id"), col(on).alias("__parent"))
    j = df.withColumn("__s", scope_key(spec)).join(p, (F.col("__s") == F.col("p_s")) & (col(spec.parent) == F.col("p_id")), "left").drop("p_s", "p_id")
    return sibling_rank(j, spec, [col(order)], "__position")


def _same(a: Column, b: Column, kind: str) -> Column:
    """Numbers by value, texts and times exactly, nulls only with nulls."""
    if kind in ("float", "double") or kind.startswith("decimal"):
        a, b = a.cast("double"), b.cast("double")
    return a.eqNullSafe(b)


def between(before: DataFrame, after: DataFrame, spec: TreeSpec, on: str | None = None, ignore: tuple[str, ...] = ()) -> TreeDiff:
    on = on or spec.id
    for df, name in ((before, "before"), (after, "after")):
        _check(df, spec, on, name)
    before, after = (df.drop(ANC, REACHED) for df in (before, after))
    kinds = dict(after.dtypes)
    skip = {spec.id, on, *spec.structure, *spec.scope, *ignore}
    columns = [c for c in after.columns if c not in skip and c in before.columns]
    a, b = _positioned(before, spec, on), _positioned(after, spec, on)
    scope = [col(c) for c in spec.scope]
    old = a.select(F.col("__s").alias("o__s"), *[col(c).alias(f"o_{c}") for c in dict.fromkeys([on, *columns])], F.col("__parent").alias("o__parent"), F.col("__position").alias("o__position"))
    both = b.join(old, (F.col("__s") == F.col("o__s")) & (col(on) == F.col(f"`o_{on}`")))
    moved = both.filter(~F.col("__parent").eqNullSafe(F.col("o__parent")) | (F.col("__position") != F.col("o__position")))
    differs = [~_same(col(c), F.col(f"`o_{c}`"), kinds[c]) for c in columns]
    changed = both.filter(_any(differs) if differs else F.lit(False))
    pick = [F.to_json(F.map_from_entries(F.filter(F.array(*[F.when(d, F.struct(F.lit(c).alias("key"), side(c).cast("string").alias("value"))) for c, d in zip(columns, differs)]), lambda x: x.isNotNull()))) if columns else F.lit("{}") for side in (lambda c: F.col(f"`o_{c}`"), col)]
    depth = [col(spec.depth), col(spec.id)] if spec.depth in after.columns else [col(spec.id)]
    return TreeDiff(
        _without(after, before, spec, on).orderBy(*depth),
        _without(before, after, spec, on),
        moved.select(*scope, col(on).alias("id"), F.col("o__parent").alias("old_parent"), F.col("__parent").alias("new_parent"), F.col("o__position").alias("old_position"), F.col("__position").alias("new_position")),
        changed.select(*scope, col(on).alias("id"), pick[0].alias("old_values"), pick[1].alias("new_values")),
        on, spec,
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def plan(diff: TreeDiff) -> DataFrame:
    """Steps of ``apply`` in order, without doing them: (step, kind, id)."""
    kinds = ("added", "moved", "removed", "modified")
    out = None
    for i, k in enumerate(kinds):
        df = getattr(diff, k)
        part = df.select(F.lit(i).alias("step"), F.lit(k).alias("kind"), (col(diff.on) if k in ("added", "removed") else F.col("id")).cast("string").alias("id"))
        out = part if out is None else out.union(part)
    return out


def apply(df: DataFrame, diff: TreeDiff) -> DataFrame:
    """Adds, moves, removals and changes applied to ``df``; the tree is then numbered
    anew, siblings in their new positions.  Identity is the tree's id here."""
    spec, kinds = diff.spec, dict(df.dtypes)
    if diff.on != spec.id:
        raise ConfigurationError("a diff is applied by the tree's own id")
    base = df.drop(ANC, REACHED)

    def placed(part: DataFrame, new: int) -> DataFrame:
        return sibling_rank(part, spec, [col(spec.lft)], "__pos").withColumns({"__pos": F.col("__pos").cast("double"), "__new": F.lit(new)})

    base = placed(base, 0)
    rows = base.unionByName(placed(diff.added.drop(ANC, REACHED), 1), allowMissingColumns=True)
    rows = _without(rows, diff.removed, spec, spec.id).withColumn("__s", scope_key(spec))
    m = diff.moved.select(scope_key(spec).alias("m_s"), F.col("id").alias("m_id"), F.col("new_parent").alias("m_parent"), F.col("new_position").cast("double").alias("m_pos"))
    rows = rows.join(m, (F.col("__s") == F.col("m_s")) & (col(spec.id) == F.col("m_id")), "left")
    hit = F.col("m_id").isNotNull()
    rows = rows.withColumns({spec.parent: F.when(hit, F.col("m_parent").cast(kinds[spec.parent])).otherwise(col(spec.parent)), "__pos": F.when(hit, F.col("m_pos")).otherwise(F.col("__pos"))})
    c = diff.modified.select(scope_key(spec).alias("c_s"), F.col("id").alias("c_id"), F.from_json("new_values", "map<string,string>").alias("c_map"))
    rows = rows.join(c, (F.col("__s") == F.col("c_s")) & (col(spec.id) == F.col("c_id")), "left")
    own = [x for x in base.columns if x not in (spec.id, *spec.scope, *spec.structure, "__pos", "__new")]
    rows = rows.withColumns({x: F.when(F.coalesce(F.map_contains_key("c_map", x), F.lit(False)), F.try_element_at("c_map", F.lit(x)).cast(kinds[x])).otherwise(col(x)) for x in own})
    if not _homeless(rows.drop("__s"), spec).isEmpty():
        raise DanglingParentError("a row's parent is gone")
    built = build(rows.select(*[col(x) for x in base.columns]), spec, ["__pos", "__new"])
    if not built.filter(~F.col(REACHED)).isEmpty():
        raise CyclicMoveError("the moves close a cycle")
    return built.drop("__pos", "__new")


__all__ = ["TreeDiff", "apply", "between", "plan"]
