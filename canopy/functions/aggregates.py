"""Column expressions of the roll-up functions over one group of rows.

``use`` says which rows of the group count (scope of the aggregate, its filter,
not soft-deleted).  Every function is an ordinary aggregate, so that all roll-ups
of one call share one partial and one final aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import Agg, col

ROW_KEY = "__key"


def truth(x: Column, kind: str) -> Column:
    """Booleans as they are; numbers are true unless zero; texts by their content."""
    if kind == "boolean":
        return x
    if kind == "string":
        return ~F.lower(F.trim(x)).isin("", "0", "f", "false")
    return x != 0


def bound(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def source(agg: Agg) -> Column:
    return agg.contribution if agg.contribution is not None else col(agg.source)


def _ordered(agg: Agg, use: Column, value: Column, order: Column) -> Column:
    """Values of the group in order; ties go by the row's key."""
    rows = F.array_sort(F.collect_list(F.when(use, F.struct(order.alias("o"), col(ROW_KEY).alias("t"), value.alias("v")))))
    values = F.transform(rows, lambda r: r["v"])
    return F.slice(values, 1, agg.limit) if agg.limit else values


def _or_null(array: Column, made: Column) -> Column:
    return F.when(F.size(array) > 0, made)


def _string(agg: Agg, use: Column) -> Column:
    x = source(agg)
    live = use & x.isNotNull()
    if agg.unique:
        values = F.array_sort(F.collect_set(F.when(live, x)))
        values = F.slice(values, 1, agg.limit) if agg.limit else values
    else:
        values = _ordered(agg, live, x, col(agg.order_by) if agg.order_by else x)
    return bound(values, lambda v: _or_null(v, F.array_join(v.cast("array<string>"), agg.separator)))


def _json(agg: Agg, use: Column) -> Column:
    value = F.struct(*[col(c).alias(n) for n, c in agg.fields]) if agg.fields else source(agg)
    order = col(agg.order_by) if agg.order_by else (value if not agg.fields else col(ROW_KEY))
    return bound(_ordered(agg, use, value, order), lambda v: _or_null(v, F.to_json(v, {"ignoreNullFields": "false"})))


def _json_object(agg: Agg, use: Column) -> Column:
    """Entries in order; of a repeated key the last one stays."""
    key = col(agg.key).cast("string")
    if agg.allow_null_keys:
        key = F.coalesce(key, F.lit(""))
    order = F.struct(key.alias("k"), (col(agg.order_by) if agg.order_by else key).alias("o"), col(ROW_KEY).alias("t"), source(agg).alias("v"))
    rows = F.array_sort(F.collect_list(F.when(use & key.isNotNull(), order)))

    def last_of_key(r: Column) -> Column:
        after = F.concat(F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda x: x["k"]), F.array(F.lit(None).cast("string")))
        kept = F.filter(F.zip_with(r, after, lambda a, b: F.when(b.isNull() | (b != a["k"]), a)), lambda a: a.isNotNull())
        kept = F.slice(kept, 1, agg.limit) if agg.limit else kept
        entries = F.transform(kept, lambda a: F.struct(a["k"].alias("key"), a["v"].alias("value")))
        return _or_null(r, F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}))

    return bound(rows, last_of_key)


def _variance(x: Column, n: Column, sample: bool, root: bool) -> Column:
    if root:
        out = F.stddev_samp(x) if sample else F.stddev_pop(x)
    else:
        out = F.var_samp(x) if sample else F.var_pop(x)
    return F.when(n >= (2 if sample else 1), out)


def expression(agg: Agg, use: Column, kind: str) -> Column:
    """The roll-up over the rows of a group where ``use`` holds; ``kind`` is the type
    of its source."""
    if agg.kind == "count" and agg.source is None and agg.contribution is None:
        return F.count(F.when(use, F.lit(1)))
    x = F.when(use, source(agg)) if agg.kind not in ("string_agg", "json_agg", "json_object_agg") else None
    n = F.count(x) if x is not None else None
    match agg.kind:
        case "sum":
            return F.coalesce(F.sum(x), F.lit(0))
        case "count":
            return n
        case "avg":
            return F.avg(x.cast("double"))
        case "min":
            return F.min(x)
        case "max":
            return F.max(x)
        case "variance":
            return _variance(x.cast("double"), n, agg.sample, False)
        case "stddev":
            return _variance(x.cast("double"), n, agg.sample, True)
        case "weighted_avg":
            w = F.when(use, col(agg.weight)).cast("double")
            return F.sum(w * x.cast("double")) / F.nullif(F.sum(w), F.lit(0.0))
        case "bool_or":
            return F.bool_or(truth(x, kind))
        case "bool_and":
            return F.bool_and(truth(x, kind))
        case "geometric_mean":
            d = x.cast("double")
            return F.exp(F.avg(F.when(d > 0, F.ln(d))))
        case "harmonic_mean":
            d = F.nullif(x.cast("double"), F.lit(0.0))
            return F.nullif(F.count(d), F.lit(0)).cast("double") / F.nullif(F.sum(F.lit(1.0) / d), F.lit(0.0))
        case "bit_or":
            return F.bit_or(x.cast("long"))
        case "bit_and":
            return F.bit_and(x.cast("long"))
        case "bit_xor":
            return F.bit_xor(x.cast("long"))
        case "distinct_count":
            return F.count_distinct(x)
        case "median" | "percentile":
            return F.percentile(x.cast("double"), F.lit(agg.point))
        case "string_agg":
            return _string(agg, use)
        case "json_agg":
            return _json(agg, use)
        case "json_object_agg":
            return _json_object(agg, use)
    raise ValueError(f"{agg.kind} has no group expression")
