"""Subtree roll-ups: every node's aggregate over its own and its descendants' rows."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import ROW_KEY, expression, source, truth
from ..plans.build import ANC, scope_key
from ..plans.ranking import running_sums
from ..plans.scratch import materialise
from ..plans.strategy import choose
from ..spec import ZERO_WHEN_EMPTY, Agg, TreeSpec, col
from .closure import closure

#: Columns of a roll-up result that name its node.
SCOPE, NODE = "__s", "__node"


def live(spec: TreeSpec, with_trashed: bool) -> Column:
    return F.lit(True) if with_trashed or not spec.deleted else col(spec.deleted).isNull()


def _kind(df: DataFrame, agg: Agg) -> str:
    return df.select(source(agg)).dtypes[0][1] if agg.source or agg.contribution is not None else "bigint"


def _inputs(df: DataFrame, spec: TreeSpec, aggs: list[Agg], with_trashed: bool) -> DataFrame:
    """``df`` with one column for each filter and expression, so that the closure
    carries only what the aggregates read."""
    cols = {}
    alive = live(spec, with_trashed)
    for i, a in enumerate(aggs):
        cols[f"__use{i}"] = alive & a.where.condition() if a.where else alive
        if a.contribution is not None:
            cols[f"__x{i}"] = a.contribution
    return df.withColumns(cols)


def _reads(aggs: list[Agg]) -> list[str]:
    names: list[str] = []
    for i, a in enumerate(aggs):
        names += [f"__use{i}"]
        names += [f"__x{i}"] if a.contribution is not None else []
        names += [n for n in (a.source, a.weight, a.key, a.by, a.order_by) if n]
        names += [c for _, c in a.fields]
    return list(dict.fromkeys(names))


def _by_closure(df: DataFrame, spec: TreeSpec, aggs: list[Agg], with_trashed: bool, only: DataFrame | None) -> DataFrame:
    rows = _inputs(df, spec, aggs, with_trashed)
    reads = _reads(aggs)
    kinds = {i: _kind(rows, a) for i, a in enumerate(aggs)}
    pairs = closure(rows.withColumn(ROW_KEY, col(spec.id)), spec, list(dict.fromkeys([ROW_KEY, *reads])))
    if only is not None:
        pairs = pairs.join(only, (F.col("s") == only[SCOPE]) & (F.col("anc") == only[NODE]), "left_semi")
    plain, parts = [], []
    for i, a in enumerate(aggs):
        use = F.col(f"__use{i}") if a.inclusive else F.col(f"__use{i}") & (F.col("dist") > 0)
        own = a if a.contribution is None else _with_source(a, f"__x{i}")
        if a.kind == "top_k":
            parts.append(_top_k(pairs, own, use))
        else:
            plain.append(expression(own, use, kinds[i]).alias(a.alias))
    grouped = pairs.groupBy(F.col("s").alias(SCOPE), F.col("anc").alias(NODE)).agg(*(plain or [F.count(F.lit(1)).alias("__n")]))
    return reduce(lambda x, y: x.join(y, [SCOPE, NODE], "left"), parts, grouped).drop("__n")


def _with_source(agg: Agg, name: str) -> Agg:
    return replace(agg, source=name, contribution=None)


def _top_k(pairs: DataFrame, agg: Agg, use: Column) -> DataFrame:
    """Ranked before it is collected: map tasks keep at most k rows of a node."""
    x, by = col(agg.source), col(agg.by)
    w = Window.partitionBy("s", "anc").orderBy(by.desc(), x.desc(), F.col(ROW_KEY))
    best = pairs.filter(use & by.isNotNull()).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= agg.k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__r", x.alias("x"), by.alias("by")))), lambda r: F.array(F.to_json(F.struct(r["x"].alias("v"))), F.to_json(F.struct(r["by"].alias("v")))))
    text = F.transform(listed, lambda p: F.concat(F.lit("["), _bare(p[0]), F.lit(","), _bare(p[1]), F.lit("]")))
    return best.groupBy(F.col("s").alias(SCOPE), F.col("anc").alias(NODE)).agg(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias(agg.alias))


def _bare(json: Column) -> Column:
    """The value out of {"v":...}; null where the field is left out."""
    return F.when(json == "{}", F.lit("null")).otherwise(F.substring(json, 6, 1 << 30).substr(F.lit(1), F.length(json) - 6))


def _ranked(df: DataFrame, spec: TreeSpec) -> DataFrame:
    """Placed rows with pre-order rank and subtree size, from the intervals."""
    placed = df.filter((col(spec.lft) > 0) & (col(spec.rgt) > col(spec.lft)))
    r = ((col(spec.lft) + col(spec.depth) - 1) / 2).cast("long")
    size = ((col(spec.rgt) - col(spec.lft) + 1) / 2).cast("long")
    return placed.withColumns({SCOPE: scope_key(spec), NODE: col(spec.id), "__r": r, "__size": size})


def _companions(agg: Agg, kind: str, use: Column) -> dict[str, Column]:
    """Row values whose sums give the aggregate.  They are integers or decimals, so
    that a difference of two running sums is exact."""
    x = F.when(use, source(agg)) if agg.source or agg.contribution is not None else F.when(use, F.lit(1))
    d = x.cast("double")
    exact = x.cast("decimal(38,6)") if kind.startswith(("decimal", "double", "float")) else x.cast("decimal(38,0)")
    n = F.when(x.isNotNull(), F.lit(1)).otherwise(0).cast("long")
    match agg.kind:
        case "sum":
            return {"a": F.coalesce(exact, F.lit(0))}
        case "count":
            return {"n": n}
        case "avg":
            return {"a": F.coalesce(exact, F.lit(0)), "n": n}
        case "variance" | "stddev":
            return {"a": F.coalesce(exact, F.lit(0)), "q": F.coalesce((exact * exact).cast("decimal(38,6)"), F.lit(0)), "n": n}
        case "weighted_avg":
            w = F.when(use, col(agg.weight)).cast("decimal(18,6)")
            return {"a": F.coalesce((w * x.cast("decimal(18,6)")).cast("decimal(38,6)"), F.lit(0)), "n": F.coalesce(w.cast("decimal(38,6)"), F.lit(0)), "c": n}
        case "bool_or" | "bool_and":
            return {"a": F.coalesce(truth(x, kind).cast("long"), F.lit(0)), "n": n}
        case "geometric_mean":
            good = d > 0
            return {"a": F.coalesce(F.when(good, F.ln(d)).cast("decimal(38,18)"), F.lit(0)), "n": F.when(good, 1).otherwise(0).cast("long")}
        case "harmonic_mean":
            good = d != 0
            return {"a": F.coalesce(F.when(good, F.lit(1.0) / d).cast("decimal(38,18)"), F.lit(0)), "n": F.when(good, 1).otherwise(0).cast("long")}
    raise ValueError(f"{agg.kind} is not a difference of sums")


def _display(agg: Agg, v: dict[str, Column], kind: str) -> Column:
    """The aggregate from the sums of its companions."""
    a, n = v.get("a"), v.get("n")
    match agg.kind:
        case "sum":
            whole = not kind.startswith(("decimal", "double", "float"))
            return a.cast("long") if whole else a.cast("double") if kind in ("double", "float") else a
        case "count":
            return n
        case "avg":
            return F.when(n > 0, a.cast("double") / n)
        case "variance" | "stddev":
            m, q, c = a.cast("double"), v["q"].cast("double"), n.cast("double")
            out = F.greatest((c * q - m * m) / F.nullif(c * (c - 1) if agg.sample else c * c, F.lit(0.0)), F.lit(0.0))
            out = F.when(n >= (2 if agg.sample else 1), out)
            return F.sqrt(out) if agg.kind == "stddev" else out
        case "weighted_avg":
            return F.when(v["c"] > 0, a.cast("double") / F.nullif(n.cast("double"), F.lit(0.0)))
        case "bool_or":
            return F.when(n > 0, a > 0)
        case "bool_and":
            return F.when(n > 0, a == n)
        case "geometric_mean":
            return F.when(n > 0, F.exp(a.cast("double") / n))
        case "harmonic_mean":
            return F.when(n > 0, n.cast("double") / F.nullif(a.cast("double"), F.lit(0.0)))
    raise ValueError(agg.kind)


def _uses(aggs: list[Agg], spec: TreeSpec, with_trashed: bool) -> list[Column]:
    alive = live(spec, with_trashed)
    return [alive & a.where.condition() if a.where else alive for a in aggs]


def _by_prefix(df: DataFrame, spec: TreeSpec, aggs: list[Agg], with_trashed: bool) -> DataFrame:
    """Sum over a subtree: running sum at its last rank, less that at the node, plus
    the node's own value."""
    kinds = [_kind(df, a) for a in aggs]
    values = {f"__v{i}_{k}": c for i, (a, u) in enumerate(zip(aggs, _uses(aggs, spec, with_trashed))) for k, c in _companions(a, kinds[i], u).items()}
    rows = _ranked(df, spec).withColumns(values).select(SCOPE, NODE, "__r", "__size", *values)
    own = {f"{v}_own": F.col(v) for v in values}
    sums = running_sums(rows.withColumns(own), [F.col(SCOPE), F.col("__r")], {v: F.col(v) for v in values})
    sums = materialise(sums, "prefix")
    ends = sums.select(F.col(SCOPE).alias("e_s"), F.col("__r").alias("e_r"), *[F.col(v).alias(f"{v}_end") for v in values])
    j = sums.join(ends, (F.col(SCOPE) == F.col("e_s")) & (F.col("__r") + F.col("__size") - 1 == F.col("e_r")))
    out = []
    for i, a in enumerate(aggs):
        v = {k: F.col(f"__v{i}_{k}_end") - F.col(f"__v{i}_{k}") + (F.col(f"__v{i}_{k}_own") if a.inclusive else F.lit(0)) for k in _companions(a, kinds[i], F.lit(True))}
        out.append(_display(a, v, kinds[i]).alias(a.alias))
    return j.select(SCOPE, NODE, *out)


_FOLD = {"min": F.min, "max": F.max, "bit_or": F.bit_or, "bit_and": F.bit_and, "bit_xor": F.bit_xor}


def _by_blocks(df: DataFrame, spec: TreeSpec, aggs: list[Agg], with_trashed: bool) -> DataFrame:
    """A range of ranks [from, to) is at most two aligned blocks of each size: going
    up, an odd left end gives off one block and an odd right end another."""
    values = {f"__v{i}": (F.when(u, source(a)).cast("long") if a.kind.startswith("bit") else F.when(u, source(a))) for i, (a, u) in enumerate(zip(aggs, _uses(aggs, spec, with_trashed)))}
    rows = materialise(_ranked(df, spec).withColumns(values).select(SCOPE, NODE, "__r", "__size", *values), "blocks")
    top = max(int(rows.agg(F.max("__size")).first()[0] or 1).bit_length(), 1)
    fold = [_FOLD[a.kind](f"__v{i}").alias(f"__v{i}") for i, a in enumerate(aggs)]
    up = rows.withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(top))))
    blocks = up.groupBy(SCOPE, "__l", F.call_function("shiftright", F.col("__r"), F.col("__l")).alias("__b")).agg(*fold)

    def pieces(start: Column, stop: Column) -> Column:
        """Blocks (l, b) of [start, stop)."""
        none = F.array().cast("array<struct<l:int,b:bigint>>")
        begin = F.struct(start.cast("bigint").alias("a"), stop.cast("bigint").alias("z"), none.alias("out"))

        def step(s: Column, level: Column) -> Column:
            open_ = s["a"] < s["z"]
            left = open_ & (s["a"].bitwiseAND(F.lit(1)) == 1)
            right = open_ & (s["z"].bitwiseAND(F.lit(1)) == 1)
            a = s["a"] + left.cast("bigint")
            z = s["z"] - right.cast("bigint")
            one = F.struct(level.cast("int").alias("l"), s["a"].alias("b"))
            two = F.struct(level.cast("int").alias("l"), z.alias("b"))
            out = F.concat(s["out"], F.when(left, F.array(one)).otherwise(none), F.when(right & (z >= a), F.array(two)).otherwise(none))
            return F.struct(F.floor(a / 2).cast("bigint").alias("a"), F.floor(z / 2).cast("bigint").alias("z"), out.alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(top)), begin, step, lambda s: s["out"])

    def over(inclusive: bool) -> DataFrame:
        at = F.col("__r") + (0 if inclusive else 1)
        asked = rows.select(SCOPE, NODE, F.explode(pieces(at, F.col("__r") + F.col("__size"))).alias("p")).select(SCOPE, NODE, F.col("p.l").alias("__l"), F.col("p.b").alias("__b"))
        chosen = [(i, a) for i, a in enumerate(aggs) if a.inclusive == inclusive]
        got = asked.join(blocks, [SCOPE, "__l", "__b"]).groupBy(SCOPE, NODE).agg(*[_FOLD[a.kind](f"__v{i}").alias(a.alias) for i, a in chosen])
        return rows.select(SCOPE, NODE).join(got, [SCOPE, NODE], "left")

    parts = [over(way) for way in (True, False) if any(a.inclusive == way for a in aggs)]
    return reduce(lambda x, y: x.join(y, [SCOPE, NODE]), parts)


def by_interval(df: DataFrame, spec: TreeSpec, aggs: list[Agg], anchors: DataFrame, with_trashed: bool = False) -> DataFrame:
    """Roll-ups of a few anchor rows by a range join."""
    rows = _inputs(df, spec, aggs, with_trashed)
    inner = rows.withColumns({"s": scope_key(spec), ROW_KEY: col(spec.id), "__i": col(spec.lft)})
    outer = anchors.select(scope_key(spec).alias(SCOPE), col(spec.id).alias(NODE), col(spec.lft).alias("__a"), col(spec.rgt).alias("__z"))
    pairs = outer.join(inner, (F.col("s") == F.col(SCOPE)) & F.col("__i").between(F.col("__a"), F.col("__z")))
    pairs = pairs.withColumn("dist", (F.col("__i") > F.col("__a")).cast("int"))
    out = []
    for i, a in enumerate(aggs):
        use = F.col(f"__use{i}") if a.inclusive else F.col(f"__use{i}") & (F.col("dist") > 0)
        out.append(expression(a if a.contribution is None else _with_source(a, f"__x{i}"), use, _kind(rows, a)).alias(a.alias))
    return pairs.groupBy(SCOPE, NODE).agg(*out)


def rollup(df: DataFrame, spec: TreeSpec, aggs: list[Agg], only: DataFrame | None = None, strategy: str = "auto", with_trashed: bool = False) -> DataFrame:
    """One row for each reached node (or those in ``only``): SCOPE, NODE and a column
    for each aggregate."""
    if strategy == "auto":
        average = float(df.agg(F.avg(F.size(ANC))).first()[0] or 0) if ANC in df.columns else None
        ways = choose(aggs, average)
    else:
        ways = {strategy: aggs}
    parts = []
    for way, own in ways.items():
        if way == "closure":
            parts.append(_by_closure(df, spec, own, with_trashed, only))
            continue
        part = _by_prefix(df, spec, own, with_trashed) if way == "prefix" else _by_blocks(df, spec, own, with_trashed) if way == "blocks" else by_interval(df, spec, own, df, with_trashed)
        parts.append(part.join(only, [SCOPE, NODE], "left_semi") if only is not None else part)
    return reduce(lambda x, y: x.join(y, [SCOPE, NODE]), parts).select(SCOPE, NODE, *[F.col(f"`{a.alias}`") for a in aggs])


def empty_value(agg: Agg) -> Column:
    return F.lit(0) if agg.kind in ZERO_WHEN_EMPTY else F.lit(None)
