"""From parent ids to root paths, depth and nested intervals.

Ancestor paths double in each round: a node knows its last 2**k ancestors and the
one above them, so a tree of depth d needs log2(d) joins.  Sorting by path gives
the pre-order rank r, and with depth d and subtree size s the interval follows in
closed form: lft = 2 r - d + 1, rgt = lft + 2 s - 1.

Paths cost the sum of all depths.  Beyond ``PATH_LIMIT`` levels, or where most nodes
lie deeper than ``DENSE_DEPTH``, the intervals come from ranking the Euler tour
instead: every node has an opening and a closing event, each event knows the next,
and pointer doubling counts the events to the end.  That costs log2(2 n) joins of
narrow rows whatever the shape.

Joins of tables with a row for each node ask to be merged: the planner takes such a
table for as small as its compressed files and would send it through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import TreeSpec, col, scope_key
from .ranking import global_rank
from .scratch import materialise

PATH_LIMIT = 512
DENSE_DEPTH = 64
#: Ancestor ids from the root to the node itself.
ANC = "__anc"
REACHED = "__reached"


def _doubled(df: DataFrame, spec: TreeSpec, order: list[str], paths: bool, always: bool = False) -> tuple[DataFrame, bool]:
    """Rows (s, node, up, n, lost, [anc, ord]) and whether all ended: rounds stop when
    nobody is open, in a cycle, or (not with ``always``) when paths grow too costly."""
    keys = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order)])
    base = df.select(scope_key(spec).alias("s"), col(spec.id).alias("node"), col(spec.parent).alias("up"), F.lit(1).cast("long").alias("n"), *([F.array(col(spec.id)).alias("anc"), F.array(keys).alias("ord")] if paths else []))
    ids = base.select(F.col("s").alias("p_s"), F.col("node").alias("p_node")).distinct()
    known = base.join(ids.hint("merge"), (base.s == ids.p_s) & (base.up == ids.p_node), "left")
    # a parent that does not exist leaves its child, and all below, unreached
    lost = F.col("up").isNotNull() & F.col("p_node").isNull()
    kind = dict(df.dtypes)[spec.id]
    state = known.select("s", "node", F.when(lost, F.lit(None).cast(kind)).otherwise(F.col("up")).alias("up"), "n", lost.alias("lost"), *(["anc", "ord"] if paths else []))
    state = materialise(state, "paths")
    rounds = 0
    while True:
        mark = state.agg(F.count_if(F.col("up").isNotNull()).alias("open"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
        if not mark["open"]:
            return state, True
        costly = mark["n"] >= PATH_LIMIT or (mark["n"] >= DENSE_DEPTH and 2 * mark["open"] > mark["rows"])
        if (paths and costly and not always) or 1 << rounds > 2 * mark["rows"]:
            return state, False
        t = state.select(F.col("s").alias("t_s"), F.col("node").alias("t_node"), F.col("up").alias("t_up"), F.col("n").alias("t_n"), F.col("lost").alias("t_lost"), *([F.col("anc").alias("t_anc"), F.col("ord").alias("t_ord")] if paths else []))
        j = state.join(t.hint("merge"), (F.col("s") == F.col("t_s")) & (F.col("up") == F.col("t_node")), "left")
        grown = [F.concat(F.coalesce(F.col(f"t_{c}"), F.array().cast(dict(state.dtypes)[c])), F.col(c)).alias(c) for c in (["anc", "ord"] if paths else [])]
        state = materialise(j.select("s", "node", F.col("t_up").alias("up"), (F.col("n") + F.coalesce("t_n", F.lit(0))).alias("n"), (F.col("lost") | F.coalesce("t_lost", F.lit(False))).alias("lost"), *grown), "paths", instead_of=state)
        rounds += 1


def build(df: DataFrame, spec: TreeSpec, order_by: list[str] | None = None, always_paths: bool = False) -> DataFrame:
    """``df`` with fresh lft, rgt and depth; siblings in the order of ``order_by``
    (the id by default, which also breaks ties).

    Rows that no root reaches, orphans and cycles with all below them, keep the
    values they had (zero where they had none).  The result has ``REACHED``, and
    ``ANC`` where paths were affordable or ``always_paths`` asks for them (null for
    unreached rows).
    """
    order = [*(order_by or []), *([] if order_by and spec.id in order_by else [spec.id])]
    state, ended = _doubled(df, spec, order, True)
    deep = not ended and not always_paths
    if not ended:
        state, _ = _doubled(df, spec, order, False)
    if not ended and always_paths:  # without cycles, whose paths would never end
        known = state.filter(F.col("up").isNull() & ~F.col("lost")).select(F.col("s").alias("w_s"), F.col("node").alias("w_node"))
        whole = df.withColumn("__s", scope_key(spec)).join(known.hint("merge"), (F.col("__s") == F.col("w_s")) & (col(spec.id) == F.col("w_node")), "left_semi").drop("__s")
        state, _ = _doubled(whole, spec, order, True, True)
    reached = state.filter(F.col("up").isNull() & ~F.col("lost"))
    placed = _by_tour(df, spec, order, reached) if deep else _by_path(reached)
    kept = [c for c in df.columns if c not in (spec.lft, spec.rgt, spec.depth, ANC, REACHED)]

    def old(name: str, kind: str) -> Column:
        return F.coalesce(col(name), F.lit(0)).cast(kind) if name in df.columns else F.lit(0).cast(kind)

    rows = df.withColumn("__s", scope_key(spec))
    placed = placed.withColumnsRenamed({"s": "__b_s", "node": "__b_node"})  # a table may have columns of these names
    joined = rows.join(placed.hint("merge"), (F.col("__s") == F.col("__b_s")) & (col(spec.id) == F.col("__b_node")), "left")
    has = F.col("__b_node").isNotNull()
    return joined.select(
        *[col(c) for c in kept],
        F.when(has, F.col("p_lft")).otherwise(old(spec.lft, "long")).cast("long").alias(spec.lft),
        F.when(has, F.col("p_rgt")).otherwise(old(spec.rgt, "long")).cast("long").alias(spec.rgt),
        F.when(has, F.col("p_depth")).otherwise(old(spec.depth, "int")).cast("int").alias(spec.depth),
        has.alias(REACHED),
        *([F.col("p_anc").alias(ANC)] if not deep else []),
    )


def _by_path(reached: DataFrame) -> DataFrame:
    sizes = reached.select("s", F.explode("anc").alias("node")).groupBy("s", "node").agg(F.count(F.lit(1)).alias("size"))
    ranked = global_rank(reached.select("s", "node", "anc", "ord"), [F.col("s"), F.col("ord")], "r")
    first = ranked.groupBy("s").agg(F.min("r").alias("r0"))
    rows = ranked.join(first, "s").join(sizes.hint("merge"), ["s", "node"])
    d, k = F.size("anc") - 1, F.col("r") - F.col("r0")
    lft = 2 * k - d + 1
    return rows.select("s", "node", lft.alias("p_lft"), (lft + 2 * F.col("size") - 1).alias("p_rgt"), d.alias("p_depth"), F.col("anc").alias("p_anc"))


def _by_tour(df: DataFrame, spec: TreeSpec, order: list[str], reached: DataFrame) -> DataFrame:
    keys = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order)])
    rows = df.select(scope_key(spec).alias("s"), col(spec.id).alias("node"), col(spec.parent).alias("up"), keys.alias("ord"))
    rows = rows.join(reached.select("s", "node"), ["s", "node"], "left_semi")
    r = global_rank(rows, [F.col("s"), F.col("up").asc_nulls_first(), F.col("ord")], "r").select("s", "node", "up", "r")
    nxt = r.select(F.col("s").alias("n_s"), F.col("up").alias("n_up"), F.col("node").alias("n_node"), (F.col("r") - 1).alias("n_r"))
    heads = r.groupBy(F.col("s").alias("h_s"), F.col("up").alias("h_up")).agg(F.min_by("node", "r").alias("h_node")).filter("h_up is not null")
    sib = r.join(nxt, (F.col("r") == F.col("n_r")) & (F.col("s") == F.col("n_s")) & F.col("up").eqNullSafe(F.col("n_up")), "left")
    sib = sib.join(heads, (F.col("s") == F.col("h_s")) & (F.col("node") == F.col("h_up")), "left")

    def event(node: Column, closing: Column | bool) -> Column:
        return F.struct(F.col("s").alias("s"), node.alias("node"), (closing if isinstance(closing, Column) else F.lit(closing)).alias("closing"))

    none = F.lit(None).cast(f"struct<s:string,node:{dict(df.dtypes)[spec.id]},closing:boolean>")
    opened = sib.select(event(F.col("node"), False).alias("e"), F.when(F.col("h_node").isNotNull(), event(F.col("h_node"), False)).otherwise(event(F.col("node"), True)).alias("to"), F.lit(1).cast("long").alias("w"))
    after = F.when(F.col("n_node").isNotNull(), event(F.col("n_node"), False)).when(F.col("up").isNotNull(), event(F.col("up"), True)).otherwise(none)
    closed = sib.select(event(F.col("node"), True).alias("e"), after.alias("to"), F.lit(-1).cast("long").alias("w"))
    state = materialise(opened.union(closed).withColumn("n", F.lit(1).cast("long")), "tour")
    while not state.filter("to is not null").isEmpty():
        t = state.select(F.col("e").alias("t_e"), F.col("to").alias("t_to"), F.col("n").alias("t_n"), F.col("w").alias("t_w"))
        j = state.join(t, F.col("to") == F.col("t_e"), "left")
        state = materialise(j.select("e", F.col("t_to").alias("to"), (F.col("w") + F.coalesce("t_w", F.lit(0))).alias("w"), (F.col("n") + F.coalesce("t_n", F.lit(0))).alias("n")), "tour", instead_of=state)
    total = state.groupBy(F.col("e.s").alias("s")).agg(F.max("n").alias("total"))
    place = state.select(F.col("e.s").alias("s"), F.col("e.node").alias("node"), F.col("e.closing").alias("closing"), "n", "w").join(total, "s")
    at = F.col("total") - F.col("n") + 1
    return place.groupBy("s", "node").agg(F.max(F.when(~F.col("closing"), at)).alias("p_lft"), F.max(F.when(F.col("closing"), at)).alias("p_rgt"), F.max(F.when(~F.col("closing"), -F.col("w"))).alias("p_depth"))
