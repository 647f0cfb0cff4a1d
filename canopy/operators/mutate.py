"""Tree changes as functions from a table to a new table.

Positions shift with CASE expressions over the interval columns; other columns
pass through.  Target rows are looked up by key (one row each); all else stays
distributed.  Aggregates and paths are refreshed by their own operators.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousNodeError, CloneTargetError, CyclicMoveError, MissingNodeError, ScopeViolationError, SiblingOrderError, TrashedAncestorError, TrashedTargetError, UnplacedNodeError
from ..plans.build import ANC, REACHED
from ..plans.ranking import global_rank, running_sums
from ..spec import NodeBounds, NodeKey, TreeSpec, col
from .predicates import descendant_of, descendant_or_self, same_scope
from .walk import WalkFilter, filtered


def _stored(df: DataFrame) -> DataFrame:
    """Without derived columns that a change would make stale."""
    return df.drop(ANC, REACHED)


def has_key(spec: TreeSpec, key) -> Column:
    if isinstance(key, NodeKey):
        return (col(spec.id) == F.lit(key.id)) & same_scope(spec, key.scope)
    return col(spec.id) == F.lit(key)


def node(df: DataFrame, spec: TreeSpec, key) -> dict:
    rows = _stored(df).filter(has_key(spec, key)).limit(2).collect()
    if not rows:
        raise MissingNodeError(key)
    if len(rows) > 1:
        raise AmbiguousNodeError(key)
    return rows[0].asDict()


def key_of(row: dict, spec: TreeSpec) -> NodeKey:
    return NodeKey(row[spec.id], scope_of(row, spec))


def scope_of(row: dict, spec: TreeSpec) -> tuple:
    return tuple(row[c] for c in spec.scope)


def bounds_of(row: dict, spec: TreeSpec) -> NodeBounds:
    lft, rgt = row[spec.lft] or 0, row[spec.rgt] or 0
    if not (lft > 0 and rgt > lft):
        raise UnplacedNodeError(row[spec.id])
    return NodeBounds(lft, rgt, row[spec.depth])


def _in(spec: TreeSpec, scope: tuple) -> Column:
    return same_scope(spec, scope)


def make_gap(df: DataFrame, spec: TreeSpec, at: int, size: int, scope: tuple = ()) -> DataFrame:
    def moved(c: str) -> Column:
        return F.when(_in(spec, scope) & (col(c) >= at), col(c) + size).otherwise(col(c))

    return _stored(df).withColumns({spec.lft: moved(spec.lft), spec.rgt: moved(spec.rgt)})


def close_gap(df: DataFrame, spec: TreeSpec, at: int, size: int, scope: tuple = ()) -> DataFrame:
    def moved(c: str) -> Column:
        return F.when(_in(spec, scope) & (col(c) > at), col(c) - size).otherwise(col(c))

    return _stored(df).withColumns({spec.lft: moved(spec.lft), spec.rgt: moved(spec.rgt)})


def insert_node(df: DataFrame, spec: TreeSpec, values: Mapping[str, object], at: int, depth: int, parent, scope: tuple = ()) -> DataFrame:
    """A gap of two at ``at`` and a row in it; columns not given are null."""
    given = {**values, spec.lft: at, spec.rgt: at + 1, spec.depth: depth, spec.parent: parent, **dict(zip(spec.scope, scope))}
    base = make_gap(df, spec, at, 2, scope)
    row = df.sparkSession.range(1).select(*[F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in base.schema])
    return base.unionByName(row)


def move_band(df: DataFrame, spec: TreeSpec, moving: NodeBounds, position: int, depth_delta: int, scope: tuple = ()) -> DataFrame:
    """Move the band of intervals so that it begins at ``position``, a place in the
    numbering before the move."""
    if moving.lft < position <= moving.rgt:
        raise CyclicMoveError("a node cannot move into its own subtree")
    height = moving.height
    forward = position > moving.rgt
    distance = position - moving.rgt - 1 if forward else position - moving.lft
    if not distance and not depth_delta:
        return df

    def moved(c: str) -> Column:
        x = col(c)
        inside = x.between(moving.lft, moving.rgt)
        between = x.between(moving.rgt + 1, position - 1) if forward else x.between(position, moving.lft - 1)
        return F.when(_in(spec, scope), F.when(inside, x + distance).when(between, x - height if forward else x + height).otherwise(x)).otherwise(x)

    inside = _in(spec, scope) & col(spec.lft).between(moving.lft, moving.rgt)
    depth = F.when(inside, col(spec.depth) + depth_delta).otherwise(col(spec.depth))
    return _stored(df).withColumns({spec.lft: moved(spec.lft), spec.rgt: moved(spec.rgt), spec.depth: depth.cast("int")})


def _target(df: DataFrame, spec: TreeSpec, key) -> tuple[dict, NodeBounds]:
    row = node(df, spec, key)
    if spec.deleted and row[spec.deleted] is not None:
        raise TrashedTargetError(key)
    return row, bounds_of(row, spec)


def _place(df: DataFrame, spec: TreeSpec, what, position: int, depth: int, parent, scope: tuple) -> DataFrame:
    """Insert a new row (a mapping) or move the existing node (a key)."""
    if isinstance(what, Mapping):
        return insert_node(df, spec, what, position, depth, parent, scope)
    row = node(df, spec, what)
    if scope_of(row, spec) != scope:
        raise ScopeViolationError(what)
    b = bounds_of(row, spec)
    out = move_band(df, spec, b, position, depth - b.depth, scope)
    kind = dict(df.dtypes)[spec.parent]
    return _stored(out).withColumn(spec.parent, F.when(has_key(spec, key_of(row, spec)), F.lit(parent).cast(kind)).otherwise(col(spec.parent)))


def append_to(df: DataFrame, spec: TreeSpec, what, parent) -> DataFrame:
    row, b = _target(df, spec, parent)
    return _place(df, spec, what, b.rgt, b.depth + 1, row[spec.id], scope_of(row, spec))


def prepend_to(df: DataFrame, spec: TreeSpec, what, parent) -> DataFrame:
    row, b = _target(df, spec, parent)
    return _place(df, spec, what, b.lft + 1, b.depth + 1, row[spec.id], scope_of(row, spec))


def insert_before(df: DataFrame, spec: TreeSpec, what, sibling) -> DataFrame:
    row, b = _target(df, spec, sibling)
    return _place(df, spec, what, b.lft, b.depth, row[spec.parent], scope_of(row, spec))


def insert_after(df: DataFrame, spec: TreeSpec, what, sibling) -> DataFrame:
    row, b = _target(df, spec, sibling)
    return _place(df, spec, what, b.rgt + 1, b.depth, row[spec.parent], scope_of(row, spec))


def make_root(df: DataFrame, spec: TreeSpec, what, scope: tuple = ()) -> DataFrame:
    if not isinstance(what, Mapping):
        scope = scope_of(node(df, spec, what), spec)
    top = df.filter(same_scope(spec, scope)).agg(F.max(col(spec.rgt))).first()[0] or 0
    return _place(df, spec, what, top + 1, 0, None, scope)


def child_bounds(df: DataFrame, spec: TreeSpec, parent) -> DataFrame:
    """Direct children's ids and bounds in order."""
    own = (col(spec.parent) == F.lit(parent.id)) & same_scope(spec, parent.scope) if isinstance(parent, NodeKey) else col(spec.parent) == F.lit(parent)
    return df.filter(own).select(col(spec.id), col(spec.lft), col(spec.rgt), col(spec.depth)).orderBy(col(spec.lft))


def move_to(df: DataFrame, spec: TreeSpec, key, parent, position: str | int = "last") -> DataFrame:
    """First, last, or an index among the parent's other children; past the end
    appends."""
    if position == "first":
        return prepend_to(df, spec, key, parent)
    if position == "last":
        return append_to(df, spec, key, parent)
    if not isinstance(position, int) or position < 0:
        raise SiblingOrderError(f"no position {position!r}")
    moving, target = node(df, spec, key), key_of(node(df, spec, parent), spec)
    there = child_bounds(df, spec, target).filter(col(spec.id) != F.lit(moving[spec.id])).offset(position).limit(1).collect()
    return insert_before(df, spec, key, NodeKey(there[0][spec.id], target.scope)) if there else append_to(df, spec, key, target)


def shift_siblings(df: DataFrame, spec: TreeSpec, shifts: DataFrame, scope: tuple = ()) -> DataFrame:
    """Move each sibling's band by its own distance; ``shifts`` has lo, hi, delta and
    one row for each child of one parent.  A row's band is the number of bands that
    begin at or before its lft: a running count, then a join by that number."""
    span = shifts.agg(F.min("lo").alias("a"), F.max("hi").alias("z")).first()
    if span["a"] is None:
        return df
    inside = same_scope(spec, scope) & col(spec.lft).between(span["a"], span["z"])
    base = _stored(df)
    numbered = global_rank(shifts, [F.col("lo")], "__rank").select("delta", (F.col("__rank") + 1).alias("__shift"))
    marks = shifts.select(F.col("lo").alias("__at"), F.lit(0).alias("__row"))
    lined = base.filter(inside).withColumns({"__at": col(spec.lft), "__row": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    banded = running_sums(lined, [F.col("__at"), F.col("__row")], {"__band": F.lit(1) - F.col("__row")}).filter("__row = 1")
    moved = banded.join(numbered, banded["__band"] == numbered["__shift"])
    moved = moved.withColumns({spec.lft: col(spec.lft) + F.col("delta"), spec.rgt: col(spec.rgt) + F.col("delta")})
    return base.filter(~inside | col(spec.lft).isNull()).unionByName(moved.select(*[col(c) for c in base.columns]))


def reorder_children(df: DataFrame, spec: TreeSpec, parent, ids: Sequence) -> DataFrame:
    """Children in exactly this order: ids must be a permutation of them."""
    row = node(df, spec, parent)
    children = child_bounds(df, spec, key_of(row, spec)).limit(len(ids) + 1).collect()  # as many as the caller names
    if len(set(ids)) != len(ids) or set(ids) != {r[spec.id] for r in children}:
        raise SiblingOrderError("the order must name every child once and nothing else")
    return _reordered(df, spec, row, children, list(ids))


def _reordered(df: DataFrame, spec: TreeSpec, parent: dict, children: list, ids: list) -> DataFrame:
    if [r[spec.id] for r in children] == ids:
        return df
    by_id = {r[spec.id]: r for r in children}
    at, shifts = children[0][spec.lft], []
    for key in ids:
        r = by_id[key]
        shifts.append((r[spec.lft], r[spec.rgt], at - r[spec.lft]))
        at += r[spec.rgt] - r[spec.lft] + 1
    return shift_siblings(df, spec, df.sparkSession.createDataFrame(shifts, "lo long, hi long, delta long"), scope_of(parent, spec))


def reorder_children_by(df: DataFrame, spec: TreeSpec, parent, *order: Column) -> DataFrame:
    """Children sorted by expressions; ties keep their order.  Children stay on the
    executors: a running sum of their widths in the new order gives their places."""
    key = key_of(node(df, spec, parent), spec)
    children = df.filter((col(spec.parent) == F.lit(key.id)) & same_scope(spec, key.scope))
    start = children.agg(F.min(col(spec.lft))).first()[0]
    if start is None:
        return df
    width = (col(spec.rgt) - col(spec.lft) + 1).cast("long")
    placed = running_sums(children, [*order, col(spec.lft)], {"__upto": width})
    shifts = placed.select(col(spec.lft).alias("lo"), col(spec.rgt).alias("hi"), (F.lit(start) + F.col("__upto") - width - col(spec.lft)).alias("delta"))
    return shift_siblings(df, spec, shifts, key.scope)


def move_to_sibling_position(df: DataFrame, spec: TreeSpec, key, index: int) -> DataFrame:
    row = node(df, spec, key)
    if row[spec.parent] is None:
        raise SiblingOrderError("roots have no sibling position")
    parent = NodeKey(row[spec.parent], scope_of(row, spec))
    if not 0 <= index < child_bounds(df, spec, parent).count():
        raise SiblingOrderError(f"no position {index}")
    return move_to(df, spec, key_of(row, spec), parent, index)


def _neighbour(df: DataFrame, spec: TreeSpec, key, step: int):
    row = node(df, spec, key)
    b = bounds_of(row, spec)
    same = same_scope(spec, scope_of(row, spec)) & col(spec.parent).eqNullSafe(F.lit(row[spec.parent]))
    edge = col(spec.lft) == b.rgt + 1 if step > 0 else col(spec.rgt) == b.lft - 1
    hit = df.filter(same & edge).select(col(spec.id)).limit(1).collect()
    return NodeKey(hit[0][0], scope_of(row, spec)) if hit else None


def up(df: DataFrame, spec: TreeSpec, key) -> tuple[DataFrame, bool]:
    other = _neighbour(df, spec, key, -1)
    return (df, False) if other is None else (insert_before(df, spec, key, other), True)


def down(df: DataFrame, spec: TreeSpec, key) -> tuple[DataFrame, bool]:
    other = _neighbour(df, spec, key, 1)
    return (df, False) if other is None else (insert_after(df, spec, key, other), True)


def delete(df: DataFrame, spec: TreeSpec, key) -> DataFrame:
    """Remove a node with its subtree and close the gap."""
    row = node(df, spec, key)
    b, scope = bounds_of(row, spec), scope_of(row, spec)
    kept = _stored(df).filter(~(same_scope(spec, scope) & descendant_or_self(spec, b)))
    return close_gap(kept, spec, b.rgt, b.height, scope)


def soft_delete(df: DataFrame, spec: TreeSpec, key, stamp) -> DataFrame:
    """Stamp a node and its live descendants; intervals stay."""
    row = node(df, spec, key)
    hit = same_scope(spec, scope_of(row, spec)) & descendant_or_self(spec, bounds_of(row, spec)) & col(spec.deleted).isNull()
    kind = dict(df.dtypes)[spec.deleted]
    return df.withColumn(spec.deleted, F.when(hit, F.lit(stamp).cast(kind)).otherwise(col(spec.deleted)))


def restore(df: DataFrame, spec: TreeSpec, key) -> DataFrame:
    """Undo one soft deletion: only rows that carry the node's own stamp."""
    row = node(df, spec, key)
    if row[spec.deleted] is None:
        return df
    if row[spec.parent] is not None and node(df, spec, NodeKey(row[spec.parent], scope_of(row, spec)))[spec.deleted] is not None:
        raise TrashedAncestorError(key)
    hit = same_scope(spec, scope_of(row, spec)) & descendant_or_self(spec, bounds_of(row, spec)) & (col(spec.deleted) == F.lit(row[spec.deleted]))
    return df.withColumn(spec.deleted, F.when(hit, F.lit(None)).otherwise(col(spec.deleted)))


def clone_subtree(df: DataFrame, spec: TreeSpec, key, parent=None, new_id: Callable[[Column], Column] | None = None, drop: Sequence[str] = (), transform: Callable[[DataFrame], DataFrame] | None = None, with_trashed: bool = False) -> DataFrame:
    """Copy a subtree below ``parent`` (as a new root without one).  ``new_id`` makes
    keys of the copies; columns in ``drop`` and the deletion stamp become null."""
    row = node(df, spec, key)
    key, b, scope = row[spec.id], bounds_of(row, spec), scope_of(row, spec)
    rows = _stored(df).filter(same_scope(spec, scope) & descendant_or_self(spec, b))
    if parent is not None:
        target, t = _target(df, spec, parent)
        if scope_of(target, spec) != scope:
            raise ScopeViolationError(parent)
        parent = target[spec.id]
        if b.lft <= t.lft <= b.rgt:
            raise CloneTargetError(key)
        at, depth = t.rgt, t.depth + 1
    else:
        at, depth = (df.filter(same_scope(spec, scope)).agg(F.max(col(spec.rgt))).first()[0] or 0) + 1, 0
    if spec.deleted and not with_trashed:
        from .integrity import fix_tree

        top = rows.withColumn(spec.parent, F.when(col(spec.id) == F.lit(key), F.lit(None)).otherwise(col(spec.parent)))
        rows = fix_tree(filtered(top, spec, WalkFilter(where=col(spec.deleted).isNull())), spec, [spec.lft]).drop(ANC, REACHED)
        low, base_depth = 1, 0
        height = 2 * rows.count()
        rows = rows.withColumn(spec.parent, F.when(col(spec.id) == F.lit(key), F.lit(row[spec.parent])).otherwise(col(spec.parent)))
    else:
        low, base_depth, height = b.lft, b.depth, b.height
    make = new_id or (lambda c: c + (df.agg(F.max(col(spec.id))).first()[0] or 0))
    kinds = dict(df.dtypes)
    copies = rows.withColumns({
        spec.lft: col(spec.lft) - low + at,
        spec.rgt: col(spec.rgt) - low + at,
        spec.depth: (col(spec.depth) - base_depth + depth).cast("int"),
        spec.parent: F.when(col(spec.id) == F.lit(key), F.lit(parent).cast(kinds[spec.parent])).otherwise(make(col(spec.parent))),
    }).withColumn(spec.id, make(col(spec.id)))
    for c in [*drop, *([spec.deleted] if spec.deleted else [])]:
        copies = copies.withColumn(c, F.lit(None).cast(kinds[c]))
    if transform:
        copies = transform(copies)
    return make_gap(df, spec, at, height, scope).unionByName(copies)


def bulk_insert(df: DataFrame, spec: TreeSpec, rows: DataFrame, parent=None, scope: tuple = ()) -> DataFrame:
    """Insert whole trees at once: ``rows`` are numbered from 1 (see ``build``) and
    roots among them go below ``parent``."""
    height = 2 * rows.count()
    if parent is not None:
        target, t = _target(df, spec, parent)
        at, depth, scope, parent = t.rgt, t.depth + 1, scope_of(target, spec), target[spec.id]
    else:
        at, depth = (df.filter(same_scope(spec, scope)).agg(F.max(col(spec.rgt))).first()[0] or 0) + 1, 0
    kinds = dict(df.dtypes)
    placed = _stored(rows).withColumns({
        spec.lft: col(spec.lft) + at - 1, spec.rgt: col(spec.rgt) + at - 1, spec.depth: (col(spec.depth) + depth).cast("int"),
        spec.parent: F.coalesce(col(spec.parent), F.lit(parent).cast(kinds[spec.parent])),
        **{c: F.lit(v).cast(kinds[c]) for c, v in zip(spec.scope, scope)},
    })
    return make_gap(df, spec, at, height, scope).unionByName(placed, allowMissingColumns=True).select(*[col(c) for c in _stored(df).columns])


def check_move(df: DataFrame, spec: TreeSpec, key, target) -> None:
    """Guards of a move: both placed, one scope, target not trashed or inside."""
    moving, (there, t) = node(df, spec, key), _target(df, spec, target)
    b = bounds_of(moving, spec)
    if scope_of(moving, spec) != scope_of(there, spec):
        raise ScopeViolationError(key)
    if b.lft <= t.lft <= b.rgt:
        raise CyclicMoveError(key)


def subtree(df: DataFrame, spec: TreeSpec, key, include_self: bool = True) -> DataFrame:
    row = node(df, spec, key)
    b = bounds_of(row, spec)
    return df.filter(same_scope(spec, scope_of(row, spec)) & (descendant_or_self(spec, b) if include_self else descendant_of(spec, b)))
