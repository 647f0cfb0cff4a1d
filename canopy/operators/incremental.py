"""Keeping stored roll-ups up to date from batches of changes, instead of anew."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..plans.build import ANC, scope_key
from ..spec import ZERO_WHEN_EMPTY, Agg, TreeSpec, col
from . import mutate
from .closure import with_paths
from .predicates import ancestor_of, same_scope
from .rollup import NODE, SCOPE, rollup


def keyed(changed: DataFrame, spec: TreeSpec) -> list[Column]:
    """The columns that name a change's node: its id and, in scoped trees, its scope."""
    missing = [c for c in (*spec.scope, spec.id) if c not in changed.columns]
    if missing:
        raise ConfigurationError(f"changes need the columns {missing}")
    return [col(c) for c in (*spec.scope, spec.id)]


def _chains(df: DataFrame, spec: TreeSpec, changed: DataFrame, inclusive: bool = True) -> DataFrame:
    """Changes (scope, id, ...) spread over the ancestors of their nodes: (s, anc, ...)."""
    keyed(changed, spec)
    rest = [col(c) for c in changed.columns if c not in (*spec.scope, spec.id)]
    own = changed.select(scope_key(spec).alias("c_s"), col(spec.id).alias("c_id"), *rest)
    rows = with_paths(df, spec).select(scope_key(spec).alias("s"), col(spec.id).alias("n_id"), F.col(ANC))
    j = rows.join(own, (F.col("s") == F.col("c_s")) & (F.col("n_id") == F.col("c_id")))
    path = F.col(ANC) if inclusive else F.slice(ANC, F.lit(1), F.size(ANC) - 1)
    return j.withColumn("anc", F.explode(path)).drop(ANC)


def _onto(df: DataFrame, spec: TreeSpec, part: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with columns set from ``part`` (s, anc, ...) where it has a row."""
    p = part.withColumnsRenamed({"s": "__k_s", "anc": "__k"})
    j = df.withColumn("__s", scope_key(spec)).join(p, (F.col("__s") == F.col("__k_s")) & (col(spec.id) == F.col("__k")), "left")
    hit = F.col("__k").isNotNull()
    frozen = col(spec.deleted).isNotNull() if spec.deleted else F.lit(False)
    out = j.withColumns({c: F.when(hit & ~frozen, v).otherwise(col(c)) for c, v in values.items()})
    return out.select(*[col(c) for c in df.columns])


def apply_deltas(df: DataFrame, spec: TreeSpec, deltas: DataFrame, columns: dict[str, str], inclusive: bool = True) -> DataFrame:
    """Add each node's deltas to the stored sums of its ancestors.

    ``deltas`` has the scope columns, the id and one column for each change; ``columns`` maps a stored
    column to its change.  Soft-deleted ancestors are frozen.
    """
    spread = _chains(df, spec, deltas.select(*keyed(deltas, spec), *dict.fromkeys(columns.values())), inclusive)
    sums = spread.groupBy("s", "anc").agg(*[F.sum(col(d)).alias(f"__d_{d}") for d in dict.fromkeys(columns.values())])
    return _onto(df, spec, sums, {c: F.coalesce(col(c), F.lit(0)) + F.coalesce(F.col(f"__d_{d}"), F.lit(0)) for c, d in columns.items()})


def display(kind: str, a: Column, n: Column, q: Column | None = None, sample: bool = False) -> Column:
    """A derived value from its stored companions (sum, count, sum of squares)."""
    x, c = a.cast("double"), n.cast("double")
    match kind:
        case "avg":
            return F.when(n > 0, x / c)
        case "variance" | "stddev":
            v = F.greatest((c * q.cast("double") - x * x) / F.nullif(c * (c - 1) if sample else c * c, F.lit(0.0)), F.lit(0.0))
            return F.when(n >= (2 if sample else 1), F.sqrt(v) if kind == "stddev" else v)
        case "weighted_avg":
            return x / F.nullif(c, F.lit(0.0))
        case "bool_or":
            return F.when(n > 0, a > 0)
        case "bool_and":
            return F.when(n > 0, a == n)
        case "geometric_mean":
            return F.when(n > 0, F.exp(x / c))
        case "harmonic_mean":
            return F.when(n > 0, c / F.nullif(x, F.lit(0.0)))
    raise ValueError(kind)


def push_extremes(df: DataFrame, spec: TreeSpec, added: DataFrame, source: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Inserted values raise maxima and lower minima up their chains."""
    spread = _chains(df, spec, added.select(*keyed(added, spec), col(source).alias("__x")))
    ext = spread.groupBy("s", "anc").agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    values = {}
    if low:
        values[low] = F.least(col(low), F.col("__lo"))
    if high:
        values[high] = F.greatest(col(high), F.col("__hi"))
    return _onto(df, spec, ext, values)


def recompute(df: DataFrame, spec: TreeSpec, changed: DataFrame, aggs: list[Agg]) -> DataFrame:
    """Fresh values for the ancestors of changed nodes only."""
    touched = _chains(df, spec, changed.select(*keyed(changed, spec)).distinct()).select(F.col("s").alias(SCOPE), F.col("anc").alias(NODE)).distinct()
    fresh = rollup(df, spec, aggs, only=touched, strategy="closure")
    part = fresh.select(F.col(SCOPE).alias("s"), F.col(NODE).alias("anc"), *[F.col(a.alias).alias(f"__f_{a.alias}") for a in aggs])
    return _onto(df, spec, part, {a.alias: F.col(f"__f_{a.alias}") for a in aggs})


_KEPT = ("sum", "count", "min", "max")


def _along(df: DataFrame, spec: TreeSpec, row: dict, held: dict, aggs: list[Agg], sign: int) -> DataFrame:
    """Stored values of a node's strict ancestors with ``held`` put on or taken off.
    They are found by the node's bounds, without a join; soft-deleted ones are frozen."""
    above = same_scope(spec, mutate.scope_of(row, spec)) & ancestor_of(spec, mutate.bounds_of(row, spec))
    if spec.deleted:
        above = above & col(spec.deleted).isNull()
    kinds, out = dict(df.dtypes), {}
    for a in aggs:
        c, v = col(a.alias), F.lit(held[a.alias]).cast(kinds[a.alias])
        if a.kind in ("sum", "count"):
            new = (F.coalesce(c, F.lit(0)) + sign * F.coalesce(v, F.lit(0))).cast(kinds[a.alias])
        elif sign > 0:
            new = F.least(c, v) if a.kind == "min" else F.greatest(c, v)
        else:
            continue
        out[a.alias] = F.when(above, new).otherwise(c)
    return df.withColumns(out)


def upkeep(df: DataFrame, spec: TreeSpec, aggs: list[Agg], key, change: Callable[[DataFrame], DataFrame], leaves: bool = True, enters: bool = True) -> DataFrame:
    """``change`` with the stored roll-ups of all ancestors kept right around it.

    What the node holds for its subtree comes off the chain above it before the change
    (``leaves``) and goes onto the chain above its new place after it (``enters``): a
    move does both, a deletion or soft deletion only leaves, a restored or new node
    only enters.  Minima and maxima of a chain that lost a subtree are computed anew.
    Aggregates are inclusive sums, counts, minima and maxima.
    """
    bad = [a.alias for a in aggs if a.kind not in _KEPT or not a.inclusive]
    if bad:
        raise ConfigurationError(f"no upkeep for {bad}: only inclusive sums, counts, minima and maxima")
    before = mutate.node(df, spec, key) if leaves else None
    out = change(_along(df, spec, before, before, aggs, -1) if leaves else df)
    if enters:
        after = mutate.node(out, spec, key if before is None else mutate.key_of(before, spec))
        out = _along(out, spec, after, after, aggs, 1)
    extremes = [a for a in aggs if a.kind in ("min", "max")]
    if leaves and extremes and before[spec.parent] is not None:
        parent = out.filter(mutate.has_key(spec, mutate.NodeKey(before[spec.parent], mutate.scope_of(before, spec))))
        out = recompute(out, spec, parent, extremes)
    return out


def own_values(df: DataFrame, spec: TreeSpec, aggs: list[Agg], key) -> DataFrame:
    """A new node's stored values are those of itself alone."""
    hit, kinds = mutate.has_key(spec, key), dict(df.dtypes)

    def own(a: Agg) -> Column:
        if a.kind == "count":
            return F.lit(1) if a.source is None else col(a.source).isNotNull().cast("int")
        return F.coalesce(col(a.source), F.lit(0)) if a.kind == "sum" else col(a.source)

    def counted(a: Agg) -> Column:
        return own(a) if a.where is None else F.when(a.where.condition(), own(a)).otherwise(F.lit(0 if a.kind in ZERO_WHEN_EMPTY else None))

    values = {a.alias: counted(a) for a in aggs}
    return df.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(col(c)) for c, v in values.items()})


def on_create(df: DataFrame, spec: TreeSpec, aggs: list[Agg], key, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` inserts the node ``key``; it gets its own values and its chain them too."""
    return upkeep(df, spec, aggs, key, lambda d: own_values(change(d), spec, aggs, key), leaves=False)


def on_move(df: DataFrame, spec: TreeSpec, aggs: list[Agg], key, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return upkeep(df, spec, aggs, key, change)


def on_delete(df: DataFrame, spec: TreeSpec, aggs: list[Agg], key, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A deletion, or the soft deletion that ``change`` does."""
    return upkeep(df, spec, aggs, key, change or (lambda d: mutate.delete(d, spec, key)), enters=False)


def on_restore(df: DataFrame, spec: TreeSpec, aggs: list[Agg], key) -> DataFrame:
    """A restored node brings back the totals that it kept while deleted."""
    return upkeep(df, spec, aggs, key, lambda d: mutate.restore(d, spec, key), leaves=False)


def stamp_of(agg: Agg) -> str:
    return f"{agg.alias}_computed_at"


def invalidate(df: DataFrame, spec: TreeSpec, changed: DataFrame, aggs: list[Agg]) -> DataFrame:
    """Lazy columns of the chains of changed nodes lose value and stamp."""
    spread = _chains(df, spec, changed.select(*keyed(changed, spec)).distinct()).select("s", "anc").distinct()
    kinds = dict(df.dtypes)
    return _onto(df, spec, spread, {c: F.lit(None).cast(kinds[c]) for a in aggs for c in (a.alias, stamp_of(a))})


def is_stale(agg: Agg, now: datetime) -> Column:
    """No stamp, or one older than the aggregate's time to live."""
    stamp = col(stamp_of(agg))
    old = F.lit(False) if agg.ttl is None else F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(stamp.cast("timestamp")) >= int(agg.ttl * 1_000_000)
    return stamp.isNull() | old


def refresh(df: DataFrame, spec: TreeSpec, aggs: list[Agg], now: datetime) -> DataFrame:
    """Stale lazy values computed anew and stamped; others stay."""
    stale = F.lit(False)
    for a in aggs:
        stale = stale | is_stale(a, now)
    only = df.filter(stale).select(scope_key(spec).alias(SCOPE), col(spec.id).alias(NODE)).distinct()
    fresh = rollup(df, spec, aggs, only=only, strategy="closure")
    part = fresh.select(F.col(SCOPE).alias("__k_s"), F.col(NODE).alias("__k"), *[F.col(a.alias).alias(f"__f_{a.alias}") for a in aggs])
    j = df.withColumn("__s", scope_key(spec)).join(part, (F.col("__s") == F.col("__k_s")) & (col(spec.id) == F.col("__k")), "left")
    hit = F.col("__k").isNotNull()
    values = {}
    for a in aggs:
        again = hit & is_stale(a, now)
        values[a.alias] = F.when(again, F.col(f"__f_{a.alias}")).otherwise(col(a.alias))
        values[stamp_of(a)] = F.when(again, F.lit(now)).otherwise(col(stamp_of(a)))
    return j.withColumns(values).select(*[col(c) for c in df.columns])


def reset(df: DataFrame, aggs: list[Agg]) -> DataFrame:
    """Aggregate columns as a new row has them: zero or null."""
    kinds = dict(df.dtypes)
    return df.withColumns({a.alias: F.lit(0 if a.kind in ZERO_WHEN_EMPTY and not a.lazy else None).cast(kinds[a.alias]) for a in aggs if a.alias in kinds})


def changes(before: DataFrame, after: DataFrame, spec: TreeSpec, columns: list[str], stage: str = "updated") -> DataFrame:
    """Change feed: (s, node, column, old, new, chain, stage) of stored aggregates."""
    old = before.select(scope_key(spec).alias("o_s"), col(spec.id).alias("o_id"), *[col(c).cast("string").alias(f"o_{c}") for c in columns])
    rows = with_paths(after, spec).withColumn("__s", scope_key(spec))
    j = rows.join(old, (F.col("__s") == F.col("o_s")) & (col(spec.id) == F.col("o_id")))
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`o_{c}`").alias("old"), col(c).cast("string").alias("new")) for c in columns])
    out = j.select(F.col("__s").alias("s"), col(spec.id).alias("node"), F.col(ANC).alias("chain"), F.explode(each).alias("c"))
    return out.filter(~F.col("c.old").eqNullSafe(F.col("c.new"))).select("s", "node", "c.column", "c.old", "c.new", "chain", F.lit(stage).alias("stage"))


def violations(df: DataFrame, spec: TreeSpec, aggs: list[Agg]) -> DataFrame:
    """Rows whose source a geometric (not positive) or harmonic (zero) mean cannot
    use, unless that aggregate allows them: (id, aggregate)."""
    out = None
    for a in aggs:
        if a.kind not in ("geometric_mean", "harmonic_mean") or a.allow_non_positive:
            continue
        bad = col(a.source) <= 0 if a.kind == "geometric_mean" else col(a.source) == 0
        part = df.filter(bad).select(col(spec.id).alias("id"), F.lit(a.alias).alias("aggregate"))
        out = part if out is None else out.union(part)
    return out if out is not None else df.limit(0).select(col(spec.id).alias("id"), F.lit("").alias("aggregate"))
