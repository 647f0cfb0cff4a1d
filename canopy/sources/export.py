"""Text sinks: one line for each node, made by column expressions.

Lines carry their place in the text, so a table of any size can be written in
order; ``text`` gathers a bounded tree into one string.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CorruptTreeError
from ..operators.closure import closure, with_paths
from ..plans.build import ANC, REACHED, build, scope_key
from ..plans.ranking import global_rank
from ..spec import TreeSpec, col


def _scoped(df: DataFrame, spec: TreeSpec, scope: tuple | None) -> DataFrame:
    if scope is None:
        return df
    for name, value in zip(spec.scope, scope):
        df = df.filter(col(name).eqNullSafe(F.lit(value)))
    return df


def guard(df: DataFrame, spec: TreeSpec) -> None:
    """Exports need every row to hang from a root."""
    made = build(df.select(*dict.fromkeys([*spec.scope, spec.id, spec.parent])), spec)
    if not made.filter(~F.col(REACHED)).isEmpty():
        raise CorruptTreeError("some rows hang from no root")


def node_name(spec: TreeSpec, kind: str) -> Column:
    key = col(spec.id)
    return F.concat(F.lit("n"), key.cast("string") if kind in ("bigint", "int", "smallint", "tinyint") else F.substring(F.md5(key.cast("string").cast("binary")), 1, 8))


def _label(spec: TreeSpec, label: Column | None) -> Column:
    key = col(spec.id).cast("string")
    return key if label is None else F.coalesce(F.when(label.cast("string") != "", label.cast("string")), key)


def ascii_lines(df: DataFrame, spec: TreeSpec, label: Column | None = None, unicode: bool = True, show_depth: bool = False, max_depth: int | None = None, scope: tuple | None = None) -> DataFrame:
    """Lines (scope columns, lft, line): branches from whether ancestors are last."""
    rows = _scoped(df, spec, scope)
    bar, tee, corner, gap = ("│   ", "├── ", "└── ", "    ") if unicode else ("|   ", "|-- ", "`-- ", "    ")
    if max_depth is not None:
        rows = rows.filter(col(spec.depth) <= max_depth)
    ends = rows.groupBy(scope_key(spec).alias("e_s"), col(spec.parent).alias("e_up")).agg(F.max(col(spec.lft)).alias("e_lft"))
    on = (scope_key(spec) == F.col("e_s")) & col(spec.parent).eqNullSafe(F.col("e_up"))
    flagged = rows.join(ends, on).withColumn("__last", col(spec.lft) == F.col("e_lft")).drop("e_s", "e_up", "e_lft")
    flags = flagged.select(scope_key(spec).alias("f_s"), col(spec.id).alias("f_id"), col(spec.depth).alias("f_d"), F.col("__last").alias("f_last"))

    pairs = closure(flagged, spec, [spec.id, spec.depth, spec.lft])
    j = pairs.join(flags, (pairs.s == flags.f_s) & (pairs.anc == flags.f_id)).filter("f_d > 0")
    own = F.col("dist") == 0
    piece = F.when(own, F.when(F.col("f_last"), corner).otherwise(tee)).otherwise(F.when(F.col("f_last"), gap).otherwise(bar))
    made = j.groupBy(F.col("s").alias("m_s"), col(spec.id).alias("m_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f_d", piece.alias("p")))), lambda x: x["p"]), "").alias("__lead"))
    text = _label(spec, label)
    text = F.concat(text, F.lit(" (depth "), col(spec.depth).cast("string"), F.lit(")")) if show_depth else text
    tagged = flagged.withColumns({"__s": scope_key(spec), "__text": text}).join(made, (F.col("__s") == F.col("m_s")) & (col(spec.id) == F.col("m_id")), "left")
    return tagged.select(*[col(c) for c in spec.scope], col(spec.lft).alias("lft"), F.concat(F.coalesce("__lead", F.lit("")), F.col("__text")).alias("line"))


def mermaid_lines(df: DataFrame, spec: TreeSpec, label: Column | None = None, show_id: bool = False, aggregates: tuple[str, ...] = (), scope: tuple | None = None) -> DataFrame:
    """Lines (part, scope columns, lft, line): the head, nodes, then edges."""
    rows, kind = _scoped(df, spec, scope), dict(df.dtypes)[spec.id]
    text = _label(spec, label)
    text = F.concat(text, F.lit(" #"), col(spec.id).cast("string")) if show_id else text
    for a in aggregates:
        text = F.concat(text, F.lit(f" {a}="), F.coalesce(col(a).cast("string"), F.lit("null")))
    for old, new in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("\n", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return _graph(rows, spec, kind, "graph TD", F.concat(F.lit("    "), node_name(spec, kind), F.lit('["'), text, F.lit('"]')), " --> ", "", None)


def dot_lines(df: DataFrame, spec: TreeSpec, label: Column | None = None, rankdir: str = "TB", scope: tuple | None = None) -> DataFrame:
    """Lines of a digraph: head, nodes, edges, end."""
    rows, kind = _scoped(df, spec, scope), dict(df.dtypes)[spec.id]
    text = _label(spec, label)
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    node = F.concat(F.lit("    "), node_name(spec, kind), F.lit(' [label="'), text, F.lit('"];'))
    return _graph(rows, spec, kind, f"digraph tree {{\n    rankdir={rankdir};", node, " -> ", ";", "}")


def _graph(rows: DataFrame, spec: TreeSpec, kind: str, head: str, node: Column, arrow: str, end: str, tail: str | None) -> DataFrame:
    spark = rows.sparkSession
    scope = [col(c) for c in spec.scope]
    parent = TreeSpec(id=spec.parent)
    shown = rows.select(scope_key(spec).alias("v_s"), col(spec.id).alias("v"))
    edges = rows.withColumn("__s", scope_key(spec)).join(shown, (F.col("__s") == F.col("v_s")) & (col(spec.parent) == F.col("v")), "left_semi")
    nodes = rows.select(F.lit(1).alias("part"), *scope, col(spec.lft).alias("lft"), node.alias("line"))
    links = edges.select(F.lit(2), *scope, col(spec.lft), F.concat(F.lit("    "), node_name(parent, kind), F.lit(arrow), node_name(spec, kind), F.lit(end)))
    kinds = dict(rows.dtypes)

    def fixed(part: int, text: str) -> DataFrame:
        return spark.range(1).select(F.lit(part), *[F.lit(None).cast(kinds[c]) for c in spec.scope], F.lit(0).cast("long"), F.lit(text))

    out = fixed(0, head).toDF(*nodes.columns).union(nodes).union(links)
    return out.union(fixed(3, tail)) if tail else out


def text(lines: DataFrame, spec: TreeSpec) -> str:
    order = [c for c in ("part", *spec.scope, "lft") if c in lines.columns]
    return "\n".join(r["line"] for r in lines.orderBy(*[col(c) for c in order]).toLocalIterator())


def json_nodes(df: DataFrame, spec: TreeSpec, label: Column | None = None, extras: tuple[str, ...] = (), tops: bool = False) -> DataFrame:
    """Nested payloads: (s, id, depth, lft, node) with ``node`` the JSON of the whole
    subtree, for roots only where ``tops`` is set.

    A node's text opens its object, and closes those that end with it: how many is
    seen from the depth of the next node in pre-order.  The texts of a subtree in
    order are its payload, which is as large as its subtree; depth adds no joins.
    """
    s, key, depth = scope_key(spec), col(spec.id), col(spec.depth)
    own = F.to_json(F.struct(key.alias("id"), _label(spec, label).alias("label"), *[col(e) for e in extras]), {"ignoreNullFields": "false"})
    rows = with_paths(df, spec).withColumns({"__s": s, "__own": F.concat(own.substr(F.lit(1), F.length(own) - 1), F.lit(',"children":['))})
    ranked = global_rank(rows.select("__s", key.alias("__id"), col(spec.parent).alias("__up"), col(spec.lft).alias("__lft"), depth.alias("__depth"), "__own", ANC), [F.col("__s"), F.col("__lft")], "__r")
    nxt = ranked.select((F.col("__r") - 1).alias("__r"), F.col("__s").alias("n_s"), F.col("__depth").alias("n_depth"))
    up = ranked.select(F.col("__s").alias("u_s"), F.col("__id").alias("u_id"), F.col("__lft").alias("u_lft"))
    j = ranked.join(nxt, "__r", "left").join(up, (F.col("__s") == F.col("u_s")) & (F.col("__up") == F.col("u_id")), "left")
    flat = j.select("__s", "__id", "__lft", "__depth", "__own", F.when(F.col("n_s") == F.col("__s"), F.col("n_depth")).alias("next"), (F.col("__lft") > F.col("u_lft") + 1).alias("later"), ANC)
    over = F.posexplode(F.slice(ANC, F.lit(1), F.lit(1)) if tops else F.col(ANC)).alias("at", "anc")  # ancestors in order of depth
    pairs = flat.select("__s", "__id", "__lft", "__depth", "__own", "next", "later", F.size(ANC).alias("size"), over)
    top = F.col("__depth") - (F.col("size") - 1 - F.col("at"))
    ends = F.when(F.col("next") > top, F.col("__depth") - F.col("next") + 1).otherwise(F.col("__depth") - top + 1)
    comma = F.when((F.col("__id") != F.col("anc")) & F.coalesce("later", F.lit(False)), ",").otherwise("")
    piece = F.concat(comma, F.col("__own"), F.repeat(F.lit("]}"), F.greatest(ends, F.lit(0)).cast("int")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__lft").alias("l"), piece.alias("p")))), lambda x: x["p"]), "")
    return pairs.groupBy(F.col("__s").alias("s"), F.col("anc").alias("id")).agg(F.min(top).cast("int").alias("depth"), F.min("__lft").alias("lft"), whole.alias("node"))


def to_json(df: DataFrame, spec: TreeSpec, label: Column | None = None, extras: tuple[str, ...] = (), scope: tuple | None = None) -> str:
    """The tree, or list of trees, of a bounded table as JSON text."""
    rows = json_nodes(_scoped(df, spec, scope), spec, label, extras, tops=True).orderBy("s", "lft").collect()
    nodes = [json.loads(r["node"]) for r in rows]
    return json.dumps(nodes[0] if len(nodes) == 1 else nodes, ensure_ascii=False)


__all__ = ["ascii_lines", "dot_lines", "guard", "json_nodes", "mermaid_lines", "node_name", "text", "to_json"]
