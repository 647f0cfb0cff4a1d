"""Checks of the stored structure, and repair from parent ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.build import ANC, REACHED, build, scope_key
from ..plans.ranking import global_rank, running_sums
from ..plans.scratch import materialise
from ..spec import Agg, TreeSpec, col
from . import mutate
from .predicates import descendant_or_self, same_scope
from .relations import orphans
from .rollup import NODE, SCOPE, rollup

CHECKS = ("invalid_bounds", "duplicate_lft", "duplicate_rgt", "orphans", "parent_bounds_mismatch", "depth_mismatch", "bounds_out_of_range", "overlapping_bounds", "even_bounds_width")
#: Rows of a block in which overlaps are counted; more where there would be too many blocks.
BLOCK_ROWS = 1 << 14
BLOCKS = 1024


def _one(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check"), "n")


def _with_parent(df: DataFrame, spec: TreeSpec) -> DataFrame:
    p = df.select(scope_key(spec).alias("p_s"), col(spec.id).alias("p_id"), col(spec.lft).alias("p_lft"), col(spec.rgt).alias("p_rgt"), col(spec.depth).alias("p_depth"))
    return df.withColumn("__s", scope_key(spec)).join(p.hint("merge"), (F.col("__s") == F.col("p_s")) & (col(spec.parent) == F.col("p_id")))


def _duplicates(df: DataFrame, spec: TreeSpec, name: str) -> DataFrame:
    return df.groupBy(scope_key(spec).alias("s"), col(name).alias("v")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")


def collisions(df: DataFrame, spec: TreeSpec) -> DataFrame:
    """Placed rows whose lft is another row's rgt."""
    a = df.filter(col(spec.lft) >= 1).select(scope_key(spec).alias("a_s"), col(spec.id).alias("a_id"), col(spec.lft).alias("v"))
    b = df.select(scope_key(spec).alias("b_s"), col(spec.id).alias("b_id"), col(spec.rgt).alias("w"))
    return a.join(b.hint("merge"), (F.col("a_s") == F.col("b_s")) & (F.col("v") == F.col("w")) & (F.col("a_id") != F.col("b_id")))


def _inversions(x: np.ndarray) -> int:
    """Pairs whose first is strictly greater than their second."""
    v = np.empty(len(x), dtype=np.int64)
    v[np.argsort(x, kind="stable")] = np.arange(len(x))  # equal ones in the order that they have
    out = 0
    # radix sort from the highest bit: of two that first differ in a bit, the greater came before
    for bit in reversed(range(len(x).bit_length())):
        one = v >> bit & 1
        before = np.cumsum(one) - one
        first = np.flatnonzero(np.diff(v >> (bit + 1), prepend=-1))
        out += int((before - np.repeat(before[first], np.diff(first, append=len(v))))[one == 0].sum())
        v = v[np.argsort(v >> bit, kind="stable")]
    return out


def _inside_block(order: str, value: str):
    def count(block: pa.Table) -> pa.Table:
        at = np.argsort(block[order].to_numpy(), kind="stable")
        return pa.table({"n": pa.array([_inversions(block[value].to_numpy()[at])], pa.int64())})

    return count


def _between_blocks(cells: pa.Table) -> pa.Table:
    p, q, c = (cells[x].to_numpy() for x in ("p", "q", "c"))
    grid = np.zeros((p.max() + 2, q.max() + 2), dtype=np.int64)
    grid[p + 1, q] = c
    lower = grid.cumsum(axis=0)  # at [p, q]: of blocks before p
    later = lower[:, ::-1].cumsum(axis=1)[:, ::-1]  # and of q or later
    return pa.table({"n": pa.array([sum(int(x) * int(y) for x, y in zip(c, later[p, q + 1]))], pa.int64())})


def overlaps(df: DataFrame, spec: TreeSpec) -> DataFrame:
    """One row (n): the pairs of partly overlapping intervals, a.lft < b.lft < a.rgt < b.rgt.

    There may be as many as the square of the rows, so they are counted and not made.
    Rows are ordered by left end (the longer first).  Of the intervals open where a row
    begins, those with a right end beyond its own enclose it and those with an equal one
    share it; the rest overlap it.  Enclosing pairs are the inversions between the orders
    by left and by right end.  They are counted in blocks of each order, and between
    blocks from the numbers of rows that they share.  Scopes come first in both orders, so
    that no pair of two scopes counts.
    """
    rows = df.select(scope_key(spec).alias("s"), col(spec.id).alias("id"), col(spec.lft).alias("l"), col(spec.rgt).alias("r")).filter("l < r")
    begin = rows.select("*", F.col("l").alias("x"), F.lit(1).alias("begins"), F.col("r").alias("far"))
    ends = begin.union(rows.select("*", F.col("r"), F.lit(0), F.lit(0).cast(dict(rows.dtypes)["r"])))
    sums = {"open": 2 * F.col("begins") - 1, "i": F.col("begins")}
    swept = running_sums(ends, [F.col("s"), F.col("x"), F.col("begins"), F.col("far").desc(), F.col("id")], sums).filter("begins = 1")
    ranked = global_rank(swept.select("s", "id", "l", "r", (F.col("open") - 1).alias("open"), (F.col("i") - 1).cast("long").alias("i")), [F.col("s"), F.col("r"), F.col("l"), F.col("id")], "j")
    total = ranked.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    size = max(BLOCK_ROWS, -(-total // BLOCKS))
    placed = ranked.select("i", "j", F.floor(F.col("i") / size).alias("p"), F.floor(F.col("j") / size).alias("q"))
    enclosing = placed.groupBy("p").applyInArrow(_inside_block("i", "j"), "n long")
    enclosing = enclosing.union(placed.groupBy("q").applyInArrow(_inside_block("j", "p"), "n long"))
    cells = placed.groupBy("p", "q").agg(F.count(F.lit(1)).alias("c"))  # BLOCKS ** 2 at most
    enclosing = enclosing.union(cells.groupBy().applyInArrow(_between_blocks, "n long"))
    shared = ranked.groupBy("s", "r").agg(F.count(F.lit(1)).alias("c")).select(F.expr("c * (c - 1) div 2").alias("n"))
    parts = ranked.select(F.col("open").cast("long").alias("n")).union(enclosing.union(shared).select(-F.col("n")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _tree_of(df: DataFrame, spec: TreeSpec, anchor) -> DataFrame:
    """The rows of the anchor's scope; all rows without an anchor."""
    return df if anchor is None else df.filter(same_scope(spec, mutate.scope_of(mutate.node(df, spec, anchor), spec)))


def check(df: DataFrame, spec: TreeSpec, name: str, anchor=None) -> DataFrame:
    """One row (check, n), over the tree that holds ``anchor`` where it is given."""
    df = _tree_of(df, spec, anchor)
    lft, rgt, depth = col(spec.lft), col(spec.rgt), col(spec.depth)
    match name:
        case "invalid_bounds":
            bad = df.filter(lft >= rgt)
        case "duplicate_lft":
            bad = _duplicates(df, spec, spec.lft)
        case "duplicate_rgt":
            bad = _duplicates(df, spec, spec.rgt)
        case "orphans":
            bad = orphans(df, spec)
        case "parent_bounds_mismatch":
            bad = _with_parent(df, spec).filter((lft <= F.col("p_lft")) | (rgt >= F.col("p_rgt")))
        case "depth_mismatch":
            roots = df.filter(col(spec.parent).isNull() & (depth != 0)).select(col(spec.id))
            bad = roots.union(_with_parent(df, spec).filter(depth != F.col("p_depth") + 1).select(col(spec.id)))
        case "bounds_out_of_range":
            low = df.filter(((lft < 1) | (rgt < 1)) & ~((lft == 0) & (rgt == 0))).select(col(spec.id))
            bad = low.union(collisions(df, spec).select("a_id"))
        case "overlapping_bounds":
            return overlaps(df, spec).select(F.lit(name).alias("check"), "n")
        case "even_bounds_width":
            bad = df.filter((lft < rgt) & ((rgt - lft) % 2 == 0))
        case "unreachable":
            bad = build(df.select(*dict.fromkeys([*spec.scope, spec.id, spec.parent])), spec).filter(~F.col(REACHED))
        case _:
            raise ValueError(name)
    return _one(bad, name)


def count_errors(df: DataFrame, spec: TreeSpec, unreachable: bool = False, anchor=None) -> DataFrame:
    """Rows (check, n) for every check, over the tree that holds ``anchor`` where given."""
    df = _tree_of(df, spec, anchor)
    names = [*CHECKS, *(["unreachable"] if unreachable else [])]
    out = check(df, spec, names[0])
    for name in names[1:]:
        out = out.union(check(df, spec, name))
    return out


def is_broken(df: DataFrame, spec: TreeSpec, anchor=None) -> bool:
    return bool(count_errors(df, spec, anchor=anchor).agg(F.sum("n")).first()[0])


@dataclass(frozen=True)
class FixResult:
    tree: DataFrame
    changed: int
    errors_left: dict[str, int]

    @property
    def has_errors(self) -> bool:
        return any(self.errors_left.values())


def fix_tree(df: DataFrame, spec: TreeSpec, order_by: list[str] | None = None) -> DataFrame:
    """Fresh intervals from parent ids, siblings by id unless ``order_by`` says
    otherwise; orphans, cycles and what hangs from them stay as they are."""
    return build(df.drop(ANC, REACHED), spec, order_by)


def fix_and_count(df: DataFrame, spec: TreeSpec, order_by: list[str] | None = None) -> FixResult:
    fixed = fix_tree(df, spec, order_by)
    old = df.select(scope_key(spec).alias("o_s"), col(spec.id).alias("o_id"), col(spec.lft).alias("o_l"), col(spec.rgt).alias("o_r"), col(spec.depth).alias("o_d"))
    j = fixed.withColumn("__s", scope_key(spec)).join(old, (F.col("__s") == F.col("o_s")) & (col(spec.id) == F.col("o_id")))
    changed = j.filter((F.col("o_l") != col(spec.lft)) | (F.col("o_r") != col(spec.rgt)) | (F.col("o_d") != col(spec.depth))).count()
    left = {r["check"]: r["n"] for r in count_errors(fixed.drop(ANC, REACHED), spec).collect()}
    return FixResult(fixed, changed, left)


def fix_subtree(df: DataFrame, spec: TreeSpec, anchor, order_by: list[str] | None = None) -> DataFrame:
    """Renumber one subtree from its parent ids: it keeps its start, and all that
    follows in its scope moves by the change of its size.

    The scope is numbered anew; what then lies between the anchor's fresh bounds is
    its subtree, so that no paths are needed, however deep it is.
    """
    row = mutate.node(df, spec, anchor)
    key, bounds, scope = mutate.key_of(row, spec), mutate.bounds_of(row, spec), mutate.scope_of(row, spec)
    own = same_scope(spec, scope)
    rows = df.drop(ANC, REACHED)
    slim = rows.filter(own).select(*dict.fromkeys([*spec.scope, spec.id, spec.parent, spec.lft, *(order_by or [])]))
    fresh = materialise(build(slim.drop(spec.lft) if spec.lft not in (order_by or []) else slim, spec, order_by).filter(F.col(REACHED)).drop(ANC, REACHED), "renumbered")
    top = mutate.node(fresh, spec, key)
    new = mutate.bounds_of(top, spec)
    inside = fresh.filter(descendant_or_self(spec, new)).select(col(spec.id).alias("i_id"), (col(spec.lft) - new.lft + bounds.lft).alias("i_l"), (col(spec.rgt) - new.lft + bounds.lft).alias("i_r"), (col(spec.depth) - new.depth + bounds.depth).alias("i_d"))
    delta = (new.rgt - new.lft) - (bounds.rgt - bounds.lft)
    j = rows.join(inside, own & (col(spec.id) == F.col("i_id")), "left")

    def tail(name: str) -> Column:
        return F.when(own & (col(name) >= bounds.rgt), col(name) + delta).otherwise(col(name))

    return j.withColumns({spec.lft: F.coalesce("i_l", tail(spec.lft)).cast("long"), spec.rgt: F.coalesce("i_r", tail(spec.rgt)).cast("long"), spec.depth: F.coalesce("i_d", col(spec.depth)).cast("int")}).drop("i_id", "i_l", "i_r", "i_d")


def values_equal(agg: Agg, a: Column, b: Column, kind: str) -> Column:
    """Equality of a stored and a fresh value: numbers within 1e-4, or 1e-9 of their
    size; sets of texts and JSON lists in any order, save for top-k."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        x, y = a.cast("double"), b.cast("double")
        same = (F.abs(x - y) < 1e-4) | (F.abs(x - y) < 1e-9 * F.greatest(F.abs(x), F.abs(y)))
    elif agg.kind == "string_agg" and agg.unique:
        same = F.array_sort(F.split(a, _literal(agg.separator))) == F.array_sort(F.split(b, _literal(agg.separator)))
    elif agg.kind == "json_agg":
        parts = [F.array_sort(F.from_json(x, "array<string>")) for x in (a, b)]
        same = parts[0] == parts[1]
    else:
        same = a == b
    return F.coalesce(same, a.isNull() & b.isNull())


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in text)


def _below(df: DataFrame, spec: TreeSpec, anchor) -> DataFrame:
    """The anchor and what lies below it; all rows without an anchor."""
    return df if anchor is None else mutate.subtree(df, spec, anchor)


def _fresh(df: DataFrame, spec: TreeSpec, aggs: list[Agg], anchor, with_trashed: bool = False) -> DataFrame:
    """Fresh values (scope, node, __f_...), of the anchor's subtree only where given:
    a node's values come from below it, so nothing else is read."""
    rows = _below(df, spec, anchor)
    if anchor is not None:
        rows = rows.drop(ANC, REACHED).withColumn(spec.parent, F.when(~mutate.has_key(spec, anchor), col(spec.parent)))
    fresh = rollup(rows, spec, aggs, with_trashed=with_trashed)
    return fresh.select(SCOPE, NODE, *[F.col(a.alias).alias(f"__f_{a.alias}") for a in aggs])


def drift(df: DataFrame, spec: TreeSpec, aggs: list[Agg], with_trashed: bool = False, anchor=None) -> DataFrame:
    """Stored rows whose stored aggregate is not its fresh value: columns s, node and
    for each aggregate whether it drifted; below ``anchor`` where it is given."""
    fresh = _fresh(df, spec, aggs, anchor, with_trashed)
    kinds = {a.alias: dict(fresh.dtypes)[f"__f_{a.alias}"] for a in aggs}
    j = df.withColumn("__k", scope_key(spec)).join(fresh, (F.col("__k") == F.col(SCOPE)) & (col(spec.id) == F.col(NODE)))
    return j.select(SCOPE, NODE, *[(~values_equal(a, col(a.alias), F.col(f"__f_{a.alias}"), kinds[a.alias])).alias(a.alias) for a in aggs])


def aggregate_errors(df: DataFrame, spec: TreeSpec, aggs: list[Agg], anchor=None) -> DataFrame:
    """One row: for each aggregate the number of rows that drifted."""
    return drift(df, spec, aggs, anchor=anchor).agg(*[F.count_if(F.col(a.alias)).alias(a.alias) for a in aggs])


def aggregates_are_broken(df: DataFrame, spec: TreeSpec, aggs: list[Agg], anchor=None) -> bool:
    return any(aggregate_errors(df, spec, aggs, anchor).first())


def fix_aggregates(df: DataFrame, spec: TreeSpec, aggs: list[Agg], anchor=None) -> DataFrame:
    """``df`` with every aggregate column fresh, below ``anchor`` where it is given;
    unreached rows keep theirs."""
    return _overwritten(df, spec, aggs, _fresh(df, spec, aggs, anchor))


def _overwritten(df: DataFrame, spec: TreeSpec, aggs: list[Agg], fresh: DataFrame) -> DataFrame:
    j = df.withColumn("__k", scope_key(spec)).join(fresh, (F.col("__k") == F.col(SCOPE)) & (col(spec.id) == F.col(NODE)), "left")
    known = F.col(NODE).isNotNull()
    out = j.withColumns({a.alias: F.when(known, F.col(f"__f_{a.alias}")).otherwise(col(a.alias)) if a.alias in df.columns else F.col(f"__f_{a.alias}") for a in aggs})
    return out.select(*[col(c) for c in df.columns], *[F.col(a.alias) for a in aggs if a.alias not in df.columns])


@dataclass(frozen=True)
class Chunk:
    """One step of a repair: its number, what it corrected and whether more follow."""

    number: int
    rows_updated: int
    per_column: dict[str, int]
    more: bool


@dataclass(frozen=True)
class AggregateRepair:
    tree: DataFrame
    rows_updated: int
    per_column: dict[str, int]
    chunks: int


def repair_aggregates(df: DataFrame, spec: TreeSpec, aggs: list[Agg], anchor=None, chunk_rows: int | None = None, on_chunk: Callable[[Chunk], None] | None = None, done: int = 0) -> AggregateRepair:
    """Drifted aggregates made right and counted.

    Drift is found once and all corrections are written at once, however many chunks
    they make; ``on_chunk`` then hears of chunks of about ``chunk_rows``, dealt by a
    hash of their key.  A job that stops early goes on from chunk ``done``.  The tree
    that results has every chunk's corrections, those of earlier runs included.
    """
    fresh = materialise(_fresh(df, spec, aggs, anchor), "fresh")
    kinds = {a.alias: dict(fresh.dtypes)[f"__f_{a.alias}"] for a in aggs}
    j = df.withColumn("__k", scope_key(spec)).join(fresh, (F.col("__k") == F.col(SCOPE)) & (col(spec.id) == F.col(NODE)))
    wrong = {a.alias: ~values_equal(a, col(a.alias), F.col(f"__f_{a.alias}"), kinds[a.alias]) for a in aggs}
    any_wrong = F.lit(False)
    for w in wrong.values():
        any_wrong = any_wrong | w
    hits = materialise(j.filter(any_wrong).select(SCOPE, NODE, *[F.col(f"__f_{a.alias}") for a in aggs], *[w.alias(f"__w_{c}") for c, w in wrong.items()]), "drift")
    sums = hits.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(f"__w_{a.alias}")).alias(a.alias) for a in aggs]).first()
    total = sums["__n"]
    n = 1 if not chunk_rows else max(1, -(-total // chunk_rows))
    if on_chunk and done < n:
        each = hits.withColumn("__chunk", F.pmod(F.xxhash64(SCOPE, NODE), F.lit(n)).cast("int"))
        counted = each.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(f"__w_{a.alias}")).alias(a.alias) for a in aggs])
        # one row for each chunk; a partition of them is on the driver at a time
        rows = counted.filter(F.col("__chunk") >= done).orderBy("__chunk").toLocalIterator()
        r = next(rows, None)
        for k in range(done, n):
            mine, r = (r, next(rows, None)) if r and r["__chunk"] == k else (None, r)
            on_chunk(Chunk(k, mine["__n"] if mine else 0, {a.alias: mine[a.alias] if mine else 0 for a in aggs}, k + 1 < n))
    rows = hits.select(SCOPE, NODE, *[f"__f_{a.alias}" for a in aggs])
    per_column = {a.alias: sums[a.alias] for a in aggs}
    return AggregateRepair(_overwritten(df, spec, aggs, rows), total, per_column, n)
