"""One query for each operator of the inventory, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from . import oracles as sql
from .errors import TreeError
from .functions.aggregates import truth
from .functions.scalars import rewrite_prefix, slug
from .operators import diff as tree_diff
from .operators import forest, incremental, integrity, mutate, paths, predicates, relations, walk
from .operators.rollup import NODE, SCOPE, by_interval
from .plans.build import ANC, build
from .plans.ranking import global_rank
from .plans.scratch import materialise
from .sources import datasets as data
from .sources import export, generator, json_tree
from .spec import Agg, Filter, NodeKey, TreeSpec
from .streaming.change_feed import maintain
from .tree import Tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The node that queries with one anchor use.
ANCHOR = 4
STRUCTURE = ("id", "parent_id", "lft", "rgt", "depth")


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[f"q_{name}"] = fn
        if oracle:
            ORACLES[f"q_{name}"] = oracle
        return fn

    return add


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id", "lft", "rgt", "depth")


def _structure(df: DataFrame) -> DataFrame:
    return df.select(*STRUCTURE)


def _rolled(tree: Tree, *aggs: Agg, **kw) -> DataFrame:
    return tree.rollup(*aggs, **kw).select(F.col(NODE).alias("id"), *[F.col(a.alias) for a in aggs])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# Scans, sources, sinks


@query("S1", "SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS brand, CAST(p_size AS INTEGER) AS size FROM part")
def s1(spark, sf):
    return data.heap_rows(spark, sf).select("id", "brand", "size")


@query("S2", sql.heap(f"SELECT id, parent_id, lft, rgt, depth FROM t WHERE id = {ANCHOR}"))
def s2(spark, sf):
    return _structure(data.heap(spark, sf).df.filter(F.col("id") == ANCHOR))


_DOC = '[{"id": 1, "name": "a", "children": [{"id": 2, "name": "b", "children": [{"id": 3, "name": "c"}]}, {"id": 5, "name": "e"}]}, {"id": 6, "name": "f"}]'
_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


@query("S3", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(NULL AS BIGINT), 'a', CAST(1 AS BIGINT), CAST(8 AS BIGINT), 0), (2, 1, 'b', 2, 5, 1), (3, 2, 'c', 3, 4, 2), (5, 1, 'e', 6, 7, 1), (6, NULL, 'f', 9, 10, 0)) AS v(id, parent_id, name, lft, rgt, depth)")
def s3(spark, sf):
    return json_tree.parse(spark, _DOC, _SCHEMA).select("id", "parent_id", "name", "lft", "rgt", "depth")


@query("S3a", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(NULL AS BIGINT), 'A0'), (2, 1, 'B1'), (3, 2, 'C2'), (4, 1, 'E1'), (5, NULL, 'F0')) AS v(id, parent_id, name)")
def s3a(spark, sf):
    upper = lambda v, d: {**v, "name": v["name"].upper() + str(d)}
    return json_tree.parse(spark, _DOC, _SCHEMA, transform=upper, include_keys=False).select("id", "parent_id", "name")


@query("S3b", "SELECT * FROM (VALUES ('bad json', 'JsonTreeError'), ('cycle', 'JsonTreeError'), ('duplicate', 'JsonTreeError'), ('missing id', 'JsonTreeError'), ('mixed', 'JsonTreeError'), ('unknown column', 'JsonTreeError'), ('unknown parent', 'JsonTreeError'), ('collision', 'KeyCollisionError')) AS v(fault, error)")
def s3b(spark, sf):
    faults = {
        "bad json": "[{", "cycle": '[{"id": 1, "parent_id": 2}, {"id": 2, "parent_id": 1}]', "duplicate": '[{"id": 1, "parent_id": null}, {"id": 1, "parent_id": null}]',
        "missing id": '[{"parent_id": null}]', "mixed": '[{"id": 1, "children": []}, {"id": 2, "parent_id": 1}]', "unknown column": '[{"id": 1, "x": 2}]',
        "unknown parent": '[{"id": 1, "parent_id": 9}]', "collision": '[{"id": 1}, {"id": 1}]',
    }
    rows = []
    for name, doc in faults.items():
        try:
            json_tree.parse(spark, doc, _SCHEMA, strict=True)
            rows.append((name, "none"))
        except TreeError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "fault string, error string")


@query("S3_below", sql.heap("""SELECT id, parent_id, name FROM t
UNION ALL SELECT m + 1, 4, 'a' FROM (SELECT max(id) AS m FROM t) UNION ALL SELECT m + 2, m + 1, 'b' FROM (SELECT max(id) AS m FROM t)
UNION ALL SELECT m + 3, m + 2, 'c' FROM (SELECT max(id) AS m FROM t) UNION ALL SELECT m + 4, m + 1, 'e' FROM (SELECT max(id) AS m FROM t) UNION ALL SELECT m + 5, 4, 'f' FROM (SELECT max(id) AS m FROM t)"""))
def s3_below(spark, sf):
    """A document imported below a node of the table."""
    t = data.heap(spark, sf)
    return json_tree.import_below(t.df, t.spec, _DOC, _SCHEMA, ANCHOR, include_keys=False).select("id", "parent_id", "name")


@query("S4", sql.heap(sql.JSON_NODES))
def s4(spark, sf):
    t = data.heap(spark, sf)
    return export.json_nodes(t.df, t.spec, F.col("name"), ("size",)).select("id", "node")


@query("S5", sql.heap(sql.ASCII))
def s5(spark, sf):
    t = data.heap(spark, sf)
    return export.ascii_lines(t.df, t.spec, F.col("name"), show_depth=True)


@query("S6", sql.heap("""SELECT part, lft, line FROM (
  SELECT 0 AS part, CAST(0 AS BIGINT) AS lft, 'graph TD' AS line UNION ALL SELECT 1, lft, '    n' || id || '["' || name || ' #' || id || '"]' FROM t
  UNION ALL SELECT 2, lft, '    n' || parent_id || ' --> n' || id FROM t WHERE parent_id IS NOT NULL)"""))
def s6(spark, sf):
    t = data.heap(spark, sf)
    return export.mermaid_lines(t.df, t.spec, F.col("name"), show_id=True)


@query("S7", sql.heap("""SELECT part, lft, line FROM (
  SELECT 0 AS part, CAST(0 AS BIGINT) AS lft, 'digraph tree {' || chr(10) || '    rankdir=LR;' AS line UNION ALL SELECT 1, lft, '    n' || id || ' [label="' || name || '"];' FROM t
  UNION ALL SELECT 2, lft, '    n' || parent_id || ' -> n' || id || ';' FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT 3, 0, '}')"""))
def s7(spark, sf):
    t = data.heap(spark, sf)
    return export.dot_lines(t.df, t.spec, F.col("name"), "LR")


@query("S7a", "SELECT CAST(p_partkey AS BIGINT) AS id, 'n' || left(md5('k' || p_partkey), 8) AS node_name FROM part")
def s7a(spark, sf):
    rows = data.heap_rows(spark, sf).select("id", F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    return rows.select("id", export.node_name(TreeSpec(id="key"), "string").alias("node_name"))


@query("S7b", "SELECT * FROM (VALUES ('whole', false), ('orphans', true)) AS v(tree, refused)")
def s7b(spark, sf):
    out = []
    for name, t in (("whole", data.heap(spark, sf)), ("orphans", data.corrupt_heap(spark, sf))):
        try:
            export.guard(t.df, t.spec)
            out.append((name, False))
        except TreeError:
            out.append((name, True))
    return spark.createDataFrame(out, "tree string, refused boolean")


@query("S8", sql.conversations("""SELECT conv_id, lft, repeat('    ', greatest(depth - 1, 0)) || CASE WHEN depth > 0 THEN '└── ' ELSE '' END || role AS line FROM t"""))
def s8(spark, sf):
    t = data.conversations(spark, sf)
    return export.ascii_lines(t.df, t.spec, F.col("role"))


_NEW = "SELECT id, parent_id, id AS pos FROM h UNION ALL SELECT 90000000 + i, CASE WHEN i = 1 THEN 4 ELSE 90000001 END, 90000000 + i FROM range(1, 4) AS r(i)"


@query("S9", sql.rebuilt(_NEW))
def s9(spark, sf):
    t = data.heap(spark, sf)
    new = build(spark.range(90000001, 90000004).select("id", F.when(F.col("id") > 90000001, F.lit(90000001)).cast("long").alias("parent_id")), t.spec)
    return _structure(mutate.bulk_insert(t.df, t.spec, new, ANCHOR))


@query("S10", "SELECT id, parent_id FROM (SELECT CAST(i AS BIGINT) AS id, CASE WHEN i BETWEEN 2 AND 4 THEN CAST(1 AS BIGINT) WHEN i > 4 THEN CAST((i - 5) // 2 + 2 AS BIGINT) END AS parent_id FROM range(1, 11) AS r(i))")
def s10(spark, sf):
    return generator.uniform(spark, 3, [3, 2]).select("id", "parent_id")


# Filters

_B = f"(SELECT lft AS al, rgt AS ar FROM t WHERE id = {ANCHOR})"
for _name, _pred, _cond in (
    ("F1", "descendant_of", "lft > al AND rgt < ar"), ("F2", "descendant_or_self", "lft BETWEEN al AND ar"),
    ("F3", "ancestor_of", "lft < al AND rgt > ar"), ("F4", "ancestor_or_self", "lft <= al AND rgt >= ar"),
    ("F7", "is_after", "lft > ar"), ("F8", "is_before", "rgt < al"), ("F9", "descendant_of", "lft > al AND rgt < ar"),
):
    query(_name, sql.heap(f"SELECT id, lft, rgt, depth FROM t, {_B} WHERE {_cond}"))(lambda spark, sf, p=_pred: _ids(data.heap(spark, sf).where(p, ANCHOR)))


@query("F5", sql.heap("SELECT id, parent_id IS NULL AS root FROM t"))
def f5(spark, sf):
    t = data.heap(spark, sf)
    return t.df.select("id", predicates.is_root(t.spec).alias("root"))


@query("F6", sql.heap("SELECT id, lft, rgt, depth FROM t WHERE rgt = lft + 1"))
def f6(spark, sf):
    return _ids(data.heap(spark, sf).where("has_leaf_bounds"))


def _filtered(name: str, agg: Agg, cond: str):
    query(name, sql.heap(f"SELECT anc AS id, CAST(coalesce(sum(size) FILTER ({cond}), 0) AS BIGINT) AS total FROM cl JOIN t ON t.id = cl.node GROUP BY anc"))(lambda spark, sf: _rolled(data.heap(spark, sf), agg.into("total")))


_filtered("F10", Agg.sum("size").filter({"brand": "Brand#2", "flag": True}), "brand = 'Brand#2' AND flag")
_filtered("F11", Agg.sum("size").filter_not_null("score"), "score IS NOT NULL")
_filtered("F12", Agg.sum("size").filter_raw("size > 10 AND brand LIKE 'Brand#1%'"), "size > 10 AND brand LIKE 'Brand#1%'")


@query("F13", sql.heap("SELECT id, coalesce(brand = 'Brand#2', false) AND score IS NULL AS matches FROM t"))
def f13(spark, sf):
    return data.heap(spark, sf).df.select("id", Filter.of({"brand": "Brand#2", "score": None}).condition().alias("matches"))


@query("F14", sql.heap("SELECT id, parent_id IS NULL AS is_root, parent_id IS NOT NULL AS is_child FROM t"))
def f14(spark, sf):
    t = data.heap(spark, sf)
    return t.df.select("id", predicates.is_root(t.spec).alias("is_root"), (~predicates.is_root(t.spec)).alias("is_child"))


@query("F15", sql.corrupt("SELECT id, lft > 0 AND rgt = lft + 1 AS is_leaf FROM c"))
def f15(spark, sf):
    t = data.corrupt_heap(spark, sf)
    return t.df.select("id", predicates.is_leaf(t.spec).alias("is_leaf"))


@query("F16", sql.corrupt("SELECT id, lft > 0 AND rgt > lft AS is_placed FROM c"))
def f16(spark, sf):
    t = data.corrupt_heap(spark, sf)
    return t.df.select("id", predicates.is_placed(t.spec).alias("is_placed"))


@query("F17", sql.heap(f"SELECT id, lft > al AND rgt < ar AS below, lft < al AND rgt > ar AS above FROM t, {_B}"))
def f17(spark, sf):
    t = data.heap(spark, sf)
    b = t.bounds(ANCHOR)
    return t.df.select("id", (predicates.is_placed(t.spec) & predicates.descendant_of(t.spec, b)).alias("below"), (predicates.is_placed(t.spec) & predicates.ancestor_of(t.spec, b)).alias("above"))


@query("F18", sql.heap(f"SELECT t.id, t.id <> {ANCHOR} AND t.parent_id IS NOT DISTINCT FROM a.parent_id AS sibling FROM t, (SELECT parent_id FROM t WHERE id = {ANCHOR}) AS a"))
def f18(spark, sf):
    t = data.heap(spark, sf)
    row = t.node(ANCHOR)
    return t.df.select("id", ((F.col("id") != ANCHOR) & F.col("parent_id").eqNullSafe(F.lit(row["parent_id"]))).alias("sibling"))


@query("F19", sql.heap("SELECT id, rgt - lft + 1 AS width, CAST((rgt - lft - 1) // 2 AS BIGINT) AS descendants FROM t"))
def f19(spark, sf):
    t = data.heap(spark, sf)
    return t.df.select("id", predicates.interval_width(t.spec).alias("width"), predicates.descendant_count(t.spec).alias("descendants"))


# Projections


@query("P1", sql.heap("SELECT id, depth AS level FROM t"))
def p1(spark, sf):
    return data.heap(spark, sf).with_depth("level").select("id", "level")


@query("P2", sql.heap("SELECT t.id, t.brand, a.total, a.n FROM t JOIN (SELECT anc, CAST(sum(s.size) AS BIGINT) AS total, count(*) AS n FROM cl JOIN t AS s ON s.id = cl.node GROUP BY anc) AS a ON a.anc = t.id"))
def p2(spark, sf):
    return data.heap(spark, sf).with_fresh(Agg.sum("size").into("total"), Agg.count().into("n")).select("id", "brand", "total", "n")


@query("P3", sql.heap(f"SELECT CAST(sum(size) AS BIGINT) AS total FROM t, {_B} WHERE lft BETWEEN al AND ar"))
def p3(spark, sf):
    value = data.heap(spark, sf).fresh(ANCHOR, Agg.sum("size").into("total"))
    return spark.createDataFrame([(value,)], "total long")


@query("P4", sql.heap("SELECT t.id, CAST(sum(s.size) AS BIGINT) AS total FROM t JOIN cl ON cl.anc = t.id JOIN t AS s ON s.id = cl.node WHERE t.rgt = t.lft + 1 GROUP BY t.id"))
def p4(spark, sf):
    t = data.heap(spark, sf)
    leaves = t.where("is_leaf").select(F.lit("").alias(SCOPE), F.col("id").alias(NODE))
    return _rolled(t, Agg.sum("size").into("total"), only=leaves)


# Joins


@query("J1", sql.heap("SELECT t.id, p.id AS parent, p.brand AS parent_brand FROM t LEFT JOIN t AS p ON p.id = t.parent_id"))
def j1(spark, sf):
    return data.heap(spark, sf).relation("parents", prefix="p_").select("id", F.col("p_id").alias("parent"), F.col("p_brand").alias("parent_brand"))


@query("J2", sql.heap("SELECT t.id, c.id AS child FROM t JOIN t AS c ON c.parent_id = t.id"))
def j2(spark, sf):
    return data.heap(spark, sf).relation("children", prefix="c_").select("id", F.col("c_id").alias("child"))


@query("J3", sql.heap(f"SELECT id, lft, rgt, depth FROM t, {_B} WHERE lft > al AND rgt < ar"))
def j3(spark, sf):
    return _ids(data.heap(spark, sf).where("descendant_of", ANCHOR).orderBy("lft"))


@query("J4", sql.heap("SELECT id, lft, rgt, depth FROM t, (SELECT lft AS al, rgt AS ar FROM t WHERE id = 100) WHERE lft < al AND rgt > ar"))
def j4(spark, sf):
    return _ids(data.heap(spark, sf).where("ancestor_of", 100).orderBy("lft"))


@query("J5", sql.heap("SELECT cl.anc AS node, string_agg(CAST(t.id AS VARCHAR), ',' ORDER BY t.lft) AS relatives FROM cl JOIN t ON t.id = cl.node WHERE dist > 0 GROUP BY cl.anc"))
def j5(spark, sf):
    t = data.heap(spark, sf)
    return t.relation("eager", True, t.df.select("id")).select("node", F.array_join(F.col("relatives").cast("array<string>"), ",").alias("relatives"))


@query("J6", sql.heap("SELECT t.id, count(s.id) AS n FROM t LEFT JOIN cl ON cl.anc = t.id AND cl.dist > 0 LEFT JOIN t AS s ON s.id = cl.node AND s.brand = 'Brand#2' GROUP BY t.id HAVING count(s.id) > 0"))
def j6(spark, sf):
    t = data.heap(spark, sf)
    cond = F.col("brand") == "Brand#2"
    return relations.counted(t.df, t.spec, True, "n", cond).filter("n > 0").select("id", "n")


@query("J7", sql.heap("SELECT t.id FROM t WHERE EXISTS (SELECT 1 FROM cl JOIN t AS a ON a.id = cl.anc WHERE cl.node = t.id AND cl.dist > 0 AND a.brand = 'Brand#2')"))
def j7(spark, sf):
    return data.heap(spark, sf).relation("having", False, F.col("brand") == "Brand#2").select("id")


@query("J8", sql.chain("SELECT user_id, anc AS id, CAST(sum(cents) FILTER (dist > 0) AS BIGINT) AS below FROM cl JOIN t USING (user_id, node) GROUP BY user_id, anc"))
def j8(spark, sf):
    t = data.chain(spark, sf)
    own = Agg.sum("cents").exclusive().into("below")
    out = t.with_fresh(own, strategy="prefix")
    return out.select("user_id", "id", F.when(F.col("rgt") > F.col("lft") + 1, F.col("below")).alias("below"))


_SUMS = "SELECT anc AS id, count(*) AS n, CAST(sum(t.size) AS BIGINT) AS total FROM cl JOIN t ON t.id = cl.node JOIN t AS o ON o.id = cl.anc {where} GROUP BY anc"


def _sums(name: str, strategy: str, where: str | None = None):
    @query(name, sql.heap(_SUMS.format(where=f"WHERE o.{where}" if where else "")))
    def run(spark, sf):
        t = data.heap(spark, sf)
        only = t.df.filter(where).select(F.lit("").alias(SCOPE), F.col("id").alias(NODE)) if where else None
        return _rolled(t, Agg.count().into("n"), Agg.sum("size").into("total"), only=only, strategy=strategy)


_sums("J9", "closure")
_sums("J10", "prefix")
_sums("J11", "closure", "brand = 'Brand#2'")


@query("interval", sql.heap(_SUMS.format(where="WHERE o.depth <= 2")))
def interval(spark, sf):
    """The range join itself, for the few nodes near the root."""
    t = data.heap(spark, sf)
    r = by_interval(t.df, t.spec, [Agg.count().into("n"), Agg.sum("size").into("total")], t.df.filter("depth <= 2"))
    return r.select(F.col(NODE).alias("id"), "n", "total")


@query("J12", sql.corrupt("SELECT id, parent_id FROM c WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM c)"))
def j12(spark, sf):
    return data.corrupt_heap(spark, sf).relation("orphans").select("id", "parent_id")


@query("J13", sql.corrupt("SELECT a.id AS a_id, b.id AS b_id FROM c AS a JOIN c AS b ON a.lft = b.rgt AND a.id <> b.id WHERE a.lft >= 1"))
def j13(spark, sf):
    t = data.corrupt_heap(spark, sf)
    return integrity.collisions(t.df, t.spec).select("a_id", "b_id")


# Order and navigation


@query("O1", sql.heap("SELECT id, CAST(row_number() OVER (ORDER BY lft) AS BIGINT) AS pre, CAST(row_number() OVER (ORDER BY lft DESC) AS BIGINT) AS reversed FROM t"))
def o1(spark, sf):
    t = data.heap(spark, sf)
    one = global_rank(t.plain().select("id", "lft"), [F.col("lft")], "r0")
    return global_rank(one, [F.col("lft").desc()], "r1").select("id", (F.col("r0") + 1).alias("pre"), (F.col("r1") + 1).alias("reversed"))


@query("O2", sql.heap("SELECT id, lft, rgt FROM t WHERE parent_id IS NULL ORDER BY lft LIMIT 1"))
def o2(spark, sf):
    t = data.heap(spark, sf)
    return walk.ordered(t.where("is_root"), t.spec).limit(1).select("id", "lft", "rgt")


@query("O3", sql.heap("SELECT t.id, p.id AS previous FROM t LEFT JOIN t AS p ON p.parent_id IS NOT DISTINCT FROM t.parent_id AND p.rgt = t.lft - 1"))
def o3(spark, sf):
    return data.heap(spark, sf).relation("siblings", False, "previous").select("id", "previous")


@query("O4", sql.heap("SELECT t.id, p.id AS following FROM t LEFT JOIN t AS p ON p.parent_id IS NOT DISTINCT FROM t.parent_id AND p.lft = t.rgt + 1"))
def o4(spark, sf):
    return data.heap(spark, sf).relation("siblings", True, "following").select("id", "following")


@query("O5", sql.heap(f"SELECT id, lft, rgt, depth FROM t WHERE parent_id = {ANCHOR}"))
def o5(spark, sf):
    t = data.heap(spark, sf)
    return mutate.child_bounds(t.df, t.spec, ANCHOR)


@query("O6", sql.heap("SELECT id, lft FROM t WHERE id > 100 ORDER BY id LIMIT 50"))
def o6(spark, sf):
    return data.heap(spark, sf).df.filter("id > 100").orderBy("id").limit(50).select("id", "lft")


@query("O7", sql.heap("SELECT anc AS id, '[' || string_agg(json, ',' ORDER BY r) || ']' AS best FROM (SELECT anc, '[' || t.id || ',' || cents || ']' AS json, row_number() OVER (PARTITION BY anc ORDER BY cents DESC, t.id DESC) AS r FROM cl JOIN t ON t.id = cl.node) WHERE r <= 5 GROUP BY anc"))
def o7(spark, sf):
    return _rolled(data.heap(spark, sf), Agg.top_k("id", 5, "cents").into("best"))


# Roll-ups

_JOIN = "FROM cl JOIN t ON t.id = cl.node GROUP BY anc"


def _agg(name: str, agg: Agg, expr: str):
    query(name, sql.heap(f"SELECT anc AS id, {expr} AS value {_JOIN}"))(lambda spark, sf: _rounded(_rolled(data.heap(spark, sf), agg.into("value"))))


@query("A1", sql.GEO)
def a1(spark, sf):
    rows = data.geo_paths(spark, sf)
    return Tree(rows, data.GEO).rollup(Agg.sum("cents").into("cents"), Agg.count("cents").into("orders"), Agg.count().into("nodes"), strategy="closure").select(F.col(NODE).alias("id"), "cents", "orders", "nodes")


_agg("A2", Agg.count("score"), "count(score)")
_agg("A3", Agg.avg("score"), "round(avg(CAST(score AS DOUBLE)), 6)")
_agg("A4", Agg.min("score"), "min(score)")
_agg("A5", Agg.max("score"), "max(score)")
_agg("A6", Agg.variance("score"), "round(var_pop(score), 6)")
_agg("A7", Agg.stddev("score"), "round(stddev_pop(score), 6)")
_agg("A8", Agg.weighted_avg("score", "weight"), "round(CAST(sum(weight * score) AS DOUBLE) / nullif(CAST(sum(weight) AS DOUBLE), 0), 6)")
_agg("A9", Agg.bool_or("flag"), "bool_or(flag)")
_agg("A10", Agg.bool_and("flag"), "bool_and(flag)")
_agg("A11", Agg.geometric_mean("score"), "round(exp(avg(ln(CAST(score AS DOUBLE))) FILTER (score > 0)), 6)")
_agg("A12", Agg.harmonic_mean("score"), "round(nullif(count(score) FILTER (score <> 0), 0) / nullif(sum(1.0 / CAST(score AS DOUBLE)) FILTER (score <> 0), 0), 6)")
_agg("A13", Agg.bit_or("size"), "CAST(bit_or(size) AS BIGINT)")
_agg("A14", Agg.bit_and("size"), "CAST(bit_and(size) AS BIGINT)")
_agg("A15", Agg.bit_xor("size"), "CAST(bit_xor(size) AS BIGINT)")
_agg("A16", Agg.distinct_count("brand"), "count(DISTINCT brand)")
_agg("A17", Agg.string_agg("brand", " | "), "string_agg(brand, ' | ' ORDER BY brand)")
_agg("A18", Agg.json_agg({"id": "id", "n": "score"}), """'[' || string_agg('{"id":' || t.id || ',"n":' || coalesce(CAST(score AS VARCHAR), 'null') || '}', ',' ORDER BY t.id) || ']'""")


@query("A17b", sql.heap(f"SELECT anc AS id, string_agg(DISTINCT brand, ', ' ORDER BY brand) AS value {_JOIN}"))
def a17b(spark, sf):
    return _rolled(data.heap(spark, sf), Agg.string_agg("brand").distinct().into("value"))


@query("A19", sql.heap("""SELECT anc AS id, '{' || string_agg('"' || brand || '":' || v, ',' ORDER BY brand) || '}' AS value
FROM (SELECT anc, brand, arg_max(size, t.id) AS v FROM cl JOIN t ON t.id = cl.node GROUP BY anc, brand) GROUP BY anc"""))
def a19(spark, sf):
    return _rolled(data.heap(spark, sf), Agg.json_object_agg("brand", "size").into("value"))


_agg("A20", Agg.median("score"), "round(CAST(quantile_cont(CAST(score AS DOUBLE), 0.5) AS DOUBLE), 6)")
_agg("A21", Agg.percentile("score", 0.9), "round(CAST(quantile_cont(CAST(score AS DOUBLE), 0.9) AS DOUBLE), 6)")


@query("A21b", sql.heap(f"SELECT anc AS id, round(quantile_cont(CAST(cents AS DOUBLE), 0.25), 6) AS p_q1, round(quantile_cont(CAST(cents AS DOUBLE), 0.5), 6) AS p_q2, round(quantile_cont(CAST(cents AS DOUBLE), 0.75), 6) AS p_q3 {_JOIN}"))
def a21b(spark, sf):
    return _rounded(_rolled(data.heap(spark, sf), *Agg.quartiles("cents", "p")))


@query("A22", sql.heap("SELECT t.id, b.value FROM t LEFT JOIN (SELECT anc, '[' || string_agg(json, ',' ORDER BY r) || ']' AS value FROM (SELECT anc, '[' || t.id || ',' || score || ']' AS json, row_number() OVER (PARTITION BY anc ORDER BY score DESC, t.id DESC) AS r FROM cl JOIN t ON t.id = cl.node WHERE score IS NOT NULL) WHERE r <= 3 GROUP BY anc) AS b ON b.anc = t.id"))
def a22(spark, sf):
    return _rolled(data.heap(spark, sf), Agg.top_k("id", 3, "score").into("value"))


@query("M1", sql.heap(f"SELECT anc AS id, CAST(coalesce(sum(size) FILTER (dist > 0), 0) AS BIGINT) AS below, CAST(sum(size) AS BIGINT) AS whole, max(size) FILTER (dist > 0) AS most {_JOIN}"))
def m1(spark, sf):
    return _rolled(data.heap(spark, sf), Agg.sum("size").exclusive().into("below"), Agg.sum("size").into("whole"), Agg.max("size").exclusive().into("most"))


@query("M2", sql.heap(f"SELECT anc AS id, count(*) FILTER (brand = 'Brand#3') AS a, count(*) FILTER (score IS NOT NULL) AS b, count(*) FILTER (size % 2 = 0) AS c {_JOIN}"))
def m2(spark, sf):
    n = Agg.count()
    return _rolled(data.heap(spark, sf), n.filter({"brand": "Brand#3"}).into("a"), n.filter_not_null("score").into("b"), n.filter_raw("size % 2 = 0").into("c"))


@query("M3", sql.heap("SELECT id, 'g' AS aggregate FROM t WHERE size - 10 <= 0 UNION ALL SELECT id, 'h' FROM t WHERE size - 10 = 0"))
def m3(spark, sf):
    t = data.heap(spark, sf)
    rows = t.df.withColumn("x", F.col("size") - 10)
    aggs = [Agg.geometric_mean("x").into("g"), Agg.harmonic_mean("x").into("h"), Agg.geometric_mean("x").non_positive().into("free")]
    return incremental.violations(rows, t.spec, aggs)


NOW = datetime(2024, 1, 2, 12, 0, 0)


def _lazy(spark, sf) -> Tree:
    t = data.heap(spark, sf)
    k = F.col("id")
    stamp = F.when(k % 3 == 0, None).when(k % 3 == 1, F.lit("2024-01-02 11:59:30").cast("timestamp")).otherwise(F.lit("2024-01-02 11:00:00").cast("timestamp"))
    return Tree(t.df.withColumns({"total": F.lit(-1).cast("long"), "total_computed_at": stamp}), t.spec)


@query("M4", sql.heap("SELECT t.id, CASE WHEN t.id % 3 = 1 THEN -1 ELSE a.total END AS total, epoch_ms(CASE WHEN t.id % 3 = 1 THEN TIMESTAMP '2024-01-02 11:59:30' ELSE TIMESTAMP '2024-01-02 12:00:00' END) AS ms FROM t JOIN (SELECT anc, CAST(sum(size) AS BIGINT) AS total FROM cl JOIN t ON t.id = cl.node GROUP BY anc) AS a ON a.anc = t.id"))
def m4(spark, sf):
    out = _lazy(spark, sf).maintain("refresh", [Agg.sum("size").as_lazy(60).into("total")], NOW)
    return out.df.select("id", "total", F.unix_millis("total_computed_at").alias("ms"))


@query("M5", sql.heap(f"SELECT anc AS id, round(var_samp(score), 6) AS v, round(stddev_samp(score), 6) AS s {_JOIN}"))
def m5(spark, sf):
    return _rounded(_rolled(data.heap(spark, sf), Agg.variance("score", sample=True).into("v"), Agg.stddev("score", sample=True).into("s")))


@query("M6", sql.heap("SELECT anc AS id, string_agg(brand, ', ' ORDER BY brand, r) AS value FROM (SELECT anc, brand, t.id AS r, row_number() OVER (PARTITION BY anc ORDER BY brand, t.id) AS n FROM cl JOIN t ON t.id = cl.node) WHERE n <= 4 GROUP BY anc"))
def m6(spark, sf):
    return _rolled(data.heap(spark, sf), Agg.string_agg("brand", limit=4).into("value"))


_agg("M7", Agg.sum("cents"), "CAST(sum(cents) AS BIGINT)")


@query("prefix", sql.heap(f"SELECT anc AS id, CAST(sum(size) AS BIGINT) AS a, round(avg(CAST(score AS DOUBLE)), 6) AS b, round(var_pop(score), 6) AS c, bool_and(flag) FILTER (dist > 0) AS d {_JOIN}"))
def prefix(spark, sf):
    t = data.heap(spark, sf)
    return _rounded(_rolled(t, Agg.sum("size").into("a"), Agg.avg("score").into("b"), Agg.variance("score").into("c"), Agg.bool_and("flag").exclusive().into("d"), strategy="prefix"))


@query("blocks", sql.heap(f"SELECT anc AS id, min(score) AS a, max(size) FILTER (dist > 0) AS b, CAST(bit_xor(size) AS BIGINT) AS c {_JOIN}"))
def blocks(spark, sf):
    return _rolled(data.heap(spark, sf), Agg.min("score").into("a"), Agg.max("size").exclusive().into("b"), Agg.bit_xor("size").into("c"), strategy="blocks")


# Expression roll-ups


@query("U1", sql.heap(f"SELECT anc AS id, CAST(coalesce(sum(x), 0) AS BIGINT) AS a, count(x) AS b, max(x) AS c, round(avg(CAST(x AS DOUBLE)), 6) AS d, round(stddev_pop(x), 6) AS e FROM cl JOIN (SELECT *, CASE WHEN flag THEN size * weight END AS x FROM t) AS t ON t.id = cl.node GROUP BY anc"))
def u1(spark, sf):
    x = F.when(F.col("flag"), F.col("size") * F.col("weight"))
    kinds = {"a": "sum", "b": "count", "c": "max", "d": "avg", "e": "stddev"}
    return _rounded(_rolled(data.heap(spark, sf), *[Agg.listener(k, x).into(n) for n, k in kinds.items()]))


@query("U2", sql.heap(f"SELECT anc AS id, CAST(coalesce(sum(size * 2) FILTER (dist > 0 AND brand = 'Brand#4'), 0) AS BIGINT) AS a, count(size) FILTER (score IS NOT NULL) AS b {_JOIN}"))
def u2(spark, sf):
    x = F.col("size") * 2
    return _rolled(data.heap(spark, sf), Agg.listener("sum", x).exclusive().filter({"brand": "Brand#4"}).into("a"), Agg.listener("count", x).filter_not_null("score").into("b"))


@query("U3", "SELECT * FROM (VALUES ('bit_or'), ('weighted_avg'), ('bool_or'), ('string_agg'), ('median'), ('top_k')) AS v(refused)")
def u3(spark, sf):
    out = []
    for kind in ("bit_or", "weighted_avg", "bool_or", "string_agg", "median", "top_k"):
        try:
            Agg.listener(kind, F.lit(1))
        except TreeError:
            out.append((kind,))
    return spark.createDataFrame(out, "refused string")


@query("U4", sql.heap(f"SELECT anc AS id, CAST(sum(size) AS BIGINT) AS value {_JOIN}"))
def u4(spark, sf):
    """Partial states merge: sums of two halves of the rows add up to the whole."""
    t = data.heap(spark, sf)
    r = t.rollup(Agg.sum("size").filter_raw("id % 2 = 0").into("a"), Agg.sum("size").filter_raw("id % 2 = 1").into("b"))
    return r.select(F.col(NODE).alias("id"), (F.col("a") + F.col("b")).alias("value"))


@query("U5", sql.conversations("SELECT conv_id, anc AS id, CAST(sum(length) AS BIGINT) AS value FROM cl JOIN t USING (conv_id, node) GROUP BY conv_id, anc"))
def u5(spark, sf):
    return data.conversations(spark, sf).with_fresh(Agg.listener("sum", F.col("length")).into("value")).select("conv_id", "id", "value")


@query("U6", sql.heap("SELECT anc AS id, CAST(sum(size) AS BIGINT) AS value FROM cl JOIN t ON t.id = cl.node WHERE anc IN (SELECT anc FROM cl WHERE node = 100) GROUP BY anc"))
def u6(spark, sf):
    t = data.heap(spark, sf)
    only = t.df.filter("id = 100").select(F.explode(ANC).alias(NODE)).withColumn(SCOPE, F.lit(""))
    return _rolled(t, Agg.sum("size").into("value"), only=only)


@query("U7", sql.heap("SELECT cl.node AS id, '/' || string_agg(lower(a.brand) || '.' || a.size, '/' ORDER BY cl.dist DESC) || '/' AS path FROM cl JOIN t AS a ON a.id = cl.anc GROUP BY cl.node"))
def u7(spark, sf):
    t = data.heap(spark, sf)
    p = paths.PathSpec.of("path", F.concat(F.lower("brand"), F.lit("."), F.col("size").cast("string")))
    return t.path(p).df.select("id", "path")


@query("U8", sql.rebuilt(f"SELECT id, parent_id, id AS pos FROM h UNION ALL SELECT id + 70000000, CASE WHEN id = {ANCHOR} THEN 2 ELSE parent_id + 70000000 END, id + 70000000 FROM h WHERE id IN (SELECT node FROM hc WHERE anc = {ANCHOR})", "SELECT t.id, t.parent_id, t.lft, t.rgt, t.depth, CASE WHEN t.id >= 70000000 THEN upper(h.brand) ELSE h.brand END AS brand FROM t JOIN h ON h.id = t.id % 70000000"))
def u8(spark, sf):
    t = data.heap(spark, sf)
    out = mutate.clone_subtree(t.df, t.spec, ANCHOR, 2, lambda c: c + 70000000, transform=lambda d: d.withColumn("brand", F.upper("brand")))
    return out.select(*STRUCTURE, "brand")


@query("U9", sql.heap(f"SELECT anc AS id, CAST(bit_or(weight) AS BIGINT) AS a, CAST(bit_and(weight) AS BIGINT) AS b, CAST(bit_xor(weight) AS BIGINT) AS c {_JOIN}"))
def u9(spark, sf):
    return _rolled(data.heap(spark, sf), Agg.bit_or("weight").into("a"), Agg.bit_and("weight").into("b"), Agg.bit_xor("weight").into("c"))


# Changes


def _changed(name: str, nodes: str, fn):
    query(name, sql.rebuilt(nodes))(lambda spark, sf: _structure(fn(data.heap(spark, sf))))


@query("T1", sql.heap("SELECT id, CASE WHEN lft >= 10 THEN lft + 4 ELSE lft END AS lft, CASE WHEN rgt >= 10 THEN rgt + 4 ELSE rgt END AS rgt FROM t"))
def t1(spark, sf):
    t = data.heap(spark, sf)
    return mutate.make_gap(t.df, t.spec, 10, 4).select("id", "lft", "rgt")


@query("T2", sql.heap("SELECT id, CASE WHEN lft > 10 THEN lft - 4 ELSE lft END AS lft, CASE WHEN rgt > 10 THEN rgt - 4 ELSE rgt END AS rgt FROM t"))
def t2(spark, sf):
    t = data.heap(spark, sf)
    return mutate.close_gap(t.df, t.spec, 10, 4).select("id", "lft", "rgt")


_ADDED = "SELECT id, parent_id, CAST(id AS DOUBLE) AS pos FROM h UNION ALL SELECT 99999999, {parent}, {pos}"
_MOVED = "SELECT id, CASE WHEN id = {key} THEN {parent} ELSE parent_id END AS parent_id, CASE WHEN id = {key} THEN {pos} ELSE CAST(id AS DOUBLE) END AS pos FROM h"
_NODE = {"id": 99999999, "brand": "new"}

_changed("T3", _ADDED.format(parent=4, pos=1e9), lambda t: mutate.insert_node(t.df, t.spec, _NODE, t.bounds(4).rgt, t.bounds(4).depth + 1, 4))
_changed("T4", _MOVED.format(key=5, parent=3, pos=1e9), lambda t: mutate.move_band(t.df, t.spec, t.bounds(5), t.bounds(3).rgt, 0).withColumn("parent_id", F.when(F.col("id") == 5, F.lit(3)).otherwise(F.col("parent_id")).cast("long")))
_changed("T5", "SELECT id, parent_id, CASE WHEN parent_id = 0 THEN -id ELSE id END AS pos FROM h", lambda t: mutate.reorder_children(t.df, t.spec, 0, [3, 2, 1]))
_changed("T6", _MOVED.format(key=40, parent=2, pos=1e9), lambda t: mutate.append_to(t.df, t.spec, 40, 2))
_changed("T6b", _ADDED.format(parent=2, pos=-1), lambda t: mutate.prepend_to(t.df, t.spec, _NODE, 2))
_changed("T7", _MOVED.format(key=40, parent=1, pos=4.5), lambda t: mutate.insert_after(t.df, t.spec, 40, 4))
_changed("T7b", _MOVED.format(key=6, parent=1, pos=3.5), lambda t: mutate.insert_before(t.df, t.spec, 6, 4))
_changed("T8", _MOVED.format(key=7, parent="NULL", pos=1e9), lambda t: mutate.make_root(t.df, t.spec, 7))
_changed("T9", _MOVED.format(key=40, parent=1, pos=4.5), lambda t: mutate.move_to(t.df, t.spec, 40, 1, 1))
_changed("T10", "SELECT id, parent_id, CASE WHEN id = 6 THEN 3.5 ELSE id END AS pos FROM h", lambda t: mutate.reorder_children(t.df, t.spec, 1, [6, 4, 5]))
_changed("T11", "SELECT id, parent_id, CASE WHEN parent_id = 1 THEN -cents ELSE id END AS pos FROM h", lambda t: mutate.reorder_children_by(t.df, t.spec, 1, F.col("cents").desc()))
_changed("T12", "SELECT id, parent_id, CASE WHEN id = 4 THEN 5.5 ELSE id END AS pos FROM h", lambda t: mutate.move_to_sibling_position(t.df, t.spec, 4, 1))
_changed("T13", "SELECT id, parent_id, CASE WHEN id = 5 THEN 3.5 ELSE id END AS pos FROM h", lambda t: mutate.up(t.df, t.spec, 5)[0])
_changed("T13b", "SELECT id, parent_id, CASE WHEN id = 5 THEN 6.5 ELSE id END AS pos FROM h", lambda t: mutate.down(t.df, t.spec, 5)[0])
_changed("T14", "SELECT id, parent_id, id AS pos FROM h WHERE id NOT IN (SELECT node FROM hc WHERE anc = 4)", lambda t: mutate.delete(t.df, t.spec, 4))
_changed("T18", _NEW.replace("THEN 4", "THEN 2"), lambda t: mutate.bulk_insert(t.df, t.spec, build(t.df.sparkSession.range(90000001, 90000004).select("id", F.when(F.col("id") > 90000001, F.lit(90000001)).cast("long").alias("parent_id")), t.spec), 2))


@query("T15", sql.heap(f"SELECT t.id, size <= 10 OR (lft BETWEEN al AND ar) AS gone FROM t, {_B}"))
def t15(spark, sf):
    t = data.soft_heap(spark, sf)
    return mutate.soft_delete(t.df, t.spec, ANCHOR, datetime(2024, 5, 5)).select("id", F.col("deleted_at").isNotNull().alias("gone"))


@query("T16", sql.heap("SELECT t.id, size <= 10 AS gone FROM t"))
def t16(spark, sf):
    t = data.soft_heap(spark, sf)
    kept = t.df.filter("deleted_at IS NULL")
    live = kept.join(kept.select(F.col("id").alias("p")), F.col("parent_id") == F.col("p")).orderBy("depth", "id").first()["id"]
    gone = mutate.soft_delete(t.df, t.spec, live, datetime(2024, 5, 5))
    return mutate.restore(gone, t.spec, live).select("id", F.col("deleted_at").isNotNull().alias("gone"))


@query("T17", sql.rebuilt("SELECT id, parent_id, id AS pos FROM h UNION ALL SELECT id + 70000000, CASE WHEN id = 4 THEN NULL ELSE parent_id + 70000000 END, id + 70000000 FROM h WHERE id IN (SELECT node FROM hc WHERE anc = 4)"))
def t17(spark, sf):
    t = data.heap(spark, sf)
    return _structure(mutate.clone_subtree(t.df, t.spec, ANCHOR, None, lambda c: c + 70000000))


@query("T17b", sql.rebuilt("""SELECT id, parent_id, id AS pos FROM h UNION ALL SELECT id + 70000000, CASE WHEN id = 11 THEN 1 ELSE parent_id + 70000000 END, id + 70000000 FROM h
WHERE id IN (SELECT node FROM hc WHERE anc = 11) AND id NOT IN (SELECT a.node FROM hc AS a JOIN h AS d ON d.id = a.anc JOIN hc AS b ON b.node = d.id AND b.anc = 11 WHERE d.size <= 10 AND d.id <> 11)"""))
def t17b(spark, sf):
    """A clone leaves out soft-deleted nodes with all below them."""
    t = data.soft_heap(spark, sf)
    rows = t.df.withColumn("deleted_at", F.when(~F.col("id").isin(1, 11), F.col("deleted_at")))
    return _structure(mutate.clone_subtree(rows, t.spec, 11, 1, lambda c: c + 70000000))


@query("T19", "SELECT * FROM (VALUES ('cycle', 'CyclicMoveError'), ('missing', 'MissingNodeError'), ('order', 'SiblingOrderError'), ('scope', 'ScopeViolationError'), ('trashed', 'TrashedTargetError'), ('unplaced', 'UnplacedNodeError')) AS v(fault, error)")
def t19(spark, sf):
    t, s, bad = data.heap(spark, sf), data.soft_heap(spark, sf), data.corrupt_heap(spark, sf)
    trashed = s.df.filter("deleted_at IS NOT NULL").agg(F.min("id")).first()[0]
    wide = TreeSpec(scope=("half",))
    halves = t.df.withColumn("half", F.col("id") % 2)
    faults = {
        "cycle": lambda: mutate.check_move(t.df, t.spec, 1, 4), "missing": lambda: t.node(-5), "order": lambda: mutate.reorder_children(t.df, t.spec, 0, [1, 2]),
        "scope": lambda: mutate.check_move(halves, wide, 1, 2), "trashed": lambda: mutate.append_to(s.df, s.spec, 0, trashed), "unplaced": lambda: bad.bounds(9),
    }
    out = []
    for name, fault in faults.items():
        try:
            fault()
            out.append((name, "none"))
        except TreeError as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "fault string, error string")


# Walks


def _place(strategy: str):
    keys = {"pre": ["lft"], "post": ["rgt"], "breadth": ["depth", "lft"]}[strategy]
    return lambda spark, sf: global_rank(data.heap(spark, sf).plain().select("id", "lft", "rgt", "depth"), [F.col(k) for k in keys], "place").select("id", "place")


for _name, _way, _order in (("W1", "pre", "lft"), ("W2", "post", "rgt"), ("W3", "breadth", "depth, lft")):
    query(_name, sql.heap(f"SELECT id, CAST(row_number() OVER (ORDER BY {_order}) - 1 AS BIGINT) AS place FROM t"))(_place(_way))


@query("W4", sql.heap("SELECT id, lft FROM t WHERE lft <= (SELECT min(lft) FROM t WHERE id = 3) AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.node = t.id AND cl.dist > 0 AND cl.anc IN (1, 2))"))
def w4(spark, sf):
    """Below nodes 1 and 2 the walk skips; at node 3 it stops."""
    t = data.heap(spark, sf)
    signals = {1: walk.Signal.SKIP_SUBTREE, 2: walk.Signal.SKIP_SUBTREE, 3: walk.Signal.STOP}
    seen = [(r["id"], r["lft"]) for r in t.walk("visit", lambda r: signals.get(r["id"]))]
    return spark.createDataFrame(seen, "id long, lft long")


@query("W5", sql.heap(f"SELECT id, lft, rgt, depth FROM t, {_B} WHERE lft BETWEEN al AND ar"))
def w5(spark, sf):
    t = data.heap(spark, sf)
    return _ids(walk.ordered(mutate.subtree(t.df, t.spec, ANCHOR), t.spec))


@query("W6", sql.heap("SELECT id, lft, rgt, depth FROM t WHERE depth BETWEEN 1 AND 4 AND NOT EXISTS (SELECT 1 FROM cl JOIN t AS a ON a.id = cl.anc WHERE cl.node = t.id AND a.size % 7 = 0)"))
def w6(spark, sf):
    t = data.heap(spark, sf)
    f = walk.WalkFilter(max_depth=4, include_root=False).and_then(walk.WalkFilter(where=F.col("size") % 7 != 0, max_depth=9))
    return _ids(t.walk("filtered", f))


@query("W7", sql.heap("""SELECT t.id, t.depth AS walk_depth, CAST(row_number() OVER w - 1 AS BIGINT) AS sibling_index, count(*) OVER (PARTITION BY t.parent_id) AS sibling_count,
  row_number() OVER w = 1 AS is_first, row_number() OVER w = count(*) OVER (PARTITION BY t.parent_id) AS is_last,
  coalesce((SELECT string_agg(CAST(cl.anc AS VARCHAR), ',' ORDER BY cl.dist DESC) FROM cl JOIN t AS a ON a.id = cl.anc WHERE cl.node = t.id AND cl.dist > 0 AND a.depth > 0), '') AS path_to_root
  FROM t WINDOW w AS (PARTITION BY t.parent_id ORDER BY t.lft)"""))
def w7(spark, sf):
    out = data.heap(spark, sf).walk("with_context")
    return out.select("id", "walk_depth", "sibling_index", "sibling_count", "is_first", "is_last", F.array_join(F.col("path_to_root").cast("array<string>"), ",").alias("path_to_root"))


@query("W8", sql.heap("SELECT count(*) AS nodes, max(depth) AS max_depth, count(*) FILTER (rgt = lft + 1) AS leaves FROM t"))
def w8(spark, sf):
    return data.heap(spark, sf).walk("shape")


@query("W9", sql.heap("SELECT id, parent_id FROM t WHERE depth = 3"))
def w9(spark, sf):
    t = data.heap(spark, sf)
    return walk.top_level(t.df.filter("depth >= 3"), t.spec).select("id", "parent_id")


@query("W4_filter", sql.heap("SELECT id, lft FROM t WHERE depth <= 2 AND NOT EXISTS (SELECT 1 FROM cl JOIN t AS a ON a.id = cl.anc WHERE cl.node = t.id AND a.size % 7 = 0)"))
def w4_filter(spark, sf):
    """A visit of what a filter leaves, in order."""
    t = data.heap(spark, sf)
    seen = [(r["id"], r["lft"]) for r in t.walk("visit", lambda r: None, walk=walk.WalkFilter(max_depth=2, where=F.col("size") % 7 != 0))]
    return spark.createDataFrame(seen, "id long, lft long")


@query("W9_flat", sql.heap("SELECT id, CAST(CASE WHEN depth > 3 THEN parent_id END AS BIGINT) AS parent_id, CAST(depth - 3 AS INTEGER) AS depth, row_number() OVER (ORDER BY lft) AS place FROM t WHERE depth >= 3"))
def w9_flat(spark, sf):
    t = data.heap(spark, sf)
    flat = forest.flat_tree(t.df.filter("depth >= 3"), t.spec)
    return global_rank(flat.select("id", "parent_id", "depth", "lft"), [F.col("lft")], "r").select("id", "parent_id", "depth", (F.col("r") + 1).alias("place"))


@query("W9_nested", sql.heap(f"SELECT id, node FROM ({sql.JSON_NODES}) JOIN (SELECT id AS i, parent_id AS up FROM t) ON i = id WHERE up = {ANCHOR}"))
def w9_nested(spark, sf):
    """Children of a node as trees of their own."""
    t = data.heap(spark, sf)
    return forest.nested_tree(t.df, t.spec, ANCHOR, F.col("name"), ("size",)).select("id", "node")


# Integrity and repair

for _id, _checks in (("V1", ["invalid_bounds"]), ("V2", ["duplicate_lft", "duplicate_rgt"]), ("V3", ["orphans"]), ("V4", ["parent_bounds_mismatch"]), ("V5", ["depth_mismatch"]), ("V6", ["bounds_out_of_range"]), ("V7", ["overlapping_bounds", "even_bounds_width"]), ("V8", ["unreachable"])):

    def _run(spark, sf, checks=tuple(_checks)):
        t = data.corrupt_heap(spark, sf)
        out = integrity.check(t.df, t.spec, checks[0])
        for c in checks[1:]:
            out = out.union(integrity.check(t.df, t.spec, c))
        return out

    query(_id, sql.corrupt(" UNION ALL ".join(sql.CHECKS[c] for c in _checks)))(_run)


@query("V9", sql.corrupt(" UNION ALL ".join(sql.CHECKS[c] for c in integrity.CHECKS)))
def v9(spark, sf):
    return data.corrupt_heap(spark, sf).check("count_errors")


@query("V10", sql.corrupt_rebuilt())
def v10(spark, sf):
    t = data.corrupt_heap(spark, sf)
    return _structure(integrity.fix_tree(t.df, t.spec))


@query("V11", sql.heap("SELECT id, parent_id, lft, rgt, depth FROM t"))
def v11(spark, sf):
    """Damage inside one subtree, repaired from its anchor."""
    t = data.heap(spark, sf)
    b = t.bounds(ANCHOR)
    inside = predicates.descendant_of(t.spec, b)
    hurt = t.df.withColumns({"lft": F.when(inside, F.lit(0)).otherwise(F.col("lft")).cast("long"), "rgt": F.when(inside, F.lit(0)).otherwise(F.col("rgt")).cast("long")})
    return _structure(integrity.fix_subtree(hurt, t.spec, ANCHOR))


@query("V12", sql.heap("SELECT count(*) FILTER (id % 9 = 2) AS repaired FROM t"))
def v12(spark, sf):
    t = data.heap(spark, sf)
    p = paths.PathSpec.key("path", t.spec)
    stored = paths.assemble(t.df, t.spec, p).withColumn("path", F.when(F.col("id") % 9 == 2, F.lit("/wrong/")).otherwise(F.col("path")))
    return spark.createDataFrame([(paths.fix_paths(stored, t.spec, p)[1],)], "repaired long")


def _stored(spark, sf) -> tuple[Tree, list[Agg]]:
    """The heap with stored sums, some of which have drifted."""
    t = data.heap(spark, sf)
    aggs = [Agg.sum("size").into("total"), Agg.max("size").into("most")]
    rows = t.with_fresh(*aggs).withColumns({"total": F.when(F.col("id") % 11 == 3, F.col("total") + 1).otherwise(F.col("total")), "most": F.when(F.col("id") % 13 == 4, None).otherwise(F.col("most"))})
    return Tree(rows, t.spec), aggs


@query("V13", sql.heap("SELECT count(*) FILTER (id % 11 = 3) AS total, count(*) FILTER (id % 13 = 4) AS most FROM t"))
def v13(spark, sf):
    t, aggs = _stored(spark, sf)
    return t.check("aggregate_errors", aggs)


@query("V14", sql.heap(f"SELECT anc AS id, CAST(sum(size) AS BIGINT) AS total, max(size) AS most {_JOIN}"))
def v14(spark, sf):
    t, aggs = _stored(spark, sf)
    return integrity.fix_aggregates(t.df, t.spec, aggs).select("id", "total", "most")


@query("V9_anchor", sql.conversations("SELECT 'duplicate_lft' AS \"check\", 0 AS n UNION ALL SELECT 'depth_mismatch', CASE WHEN (SELECT count(*) FROM t WHERE conv_id = (SELECT min(conv_id) FROM t)) > 1 THEN 1 ELSE 0 END"))
def v9_anchor(spark, sf):
    """Damage in every conversation, counted in that of the anchor."""
    t = data.conversations(spark, sf)
    first = t.df.agg(F.min("conv_id")).first()[0]
    last = t.df.groupBy("conv_id").agg(F.max("id").alias("z"))
    hurt = t.df.join(last, "conv_id").withColumn("depth", F.when((F.col("id") == F.col("z")) & F.col("parent_id").isNotNull(), F.col("depth") + 5).otherwise(F.col("depth")).cast("int")).drop("z")
    root = t.df.filter((F.col("conv_id") == first) & F.col("parent_id").isNull()).first()["id"]
    out = integrity.count_errors(hurt, t.spec, anchor=NodeKey(root, (first,)))
    return out.filter(F.col("check").isin("duplicate_lft", "depth_mismatch"))


@query("V12_anchor", sql.heap(f"SELECT count(*) FILTER (id % 9 = 2 AND id IN (SELECT node FROM cl WHERE anc = {ANCHOR})) AS repaired, count(*) FILTER (id % 9 = 2 AND id NOT IN (SELECT node FROM cl WHERE anc = {ANCHOR})) AS wrong FROM t"))
def v12_anchor(spark, sf):
    t = data.heap(spark, sf)
    p = paths.PathSpec.key("path", t.spec)
    stored = paths.assemble(t.df, t.spec, p).withColumn("path", F.when(F.col("id") % 9 == 2, F.lit("/wrong/")).otherwise(F.col("path")))
    fixed, repaired = paths.fix_paths(stored, t.spec, p, ANCHOR)
    return fixed.agg(F.lit(repaired).cast("long").alias("repaired"), F.count_if(F.col("path") == "/wrong/").alias("wrong"))


@query("V13_anchor", sql.heap(f"SELECT count(*) FILTER (id % 11 = 3) AS total, count(*) FILTER (id % 13 = 4) AS most FROM t WHERE id IN (SELECT node FROM cl WHERE anc = {ANCHOR})"))
def v13_anchor(spark, sf):
    t, aggs = _stored(spark, sf)
    return t.check("aggregate_errors", aggs, ANCHOR)


@query("V14_anchor", sql.heap(f"SELECT anc AS id, CAST(sum(size) + CASE WHEN anc % 11 = 3 AND anc NOT IN (SELECT node FROM cl WHERE anc = {ANCHOR}) THEN 1 ELSE 0 END AS BIGINT) AS total {_JOIN}"))
def v14_anchor(spark, sf):
    """Only the anchor's subtree is repaired."""
    t, aggs = _stored(spark, sf)
    return integrity.fix_aggregates(t.df, t.spec, aggs[:1], ANCHOR).select("id", "total")


@query("V14_counts", sql.heap("SELECT count(*) FILTER (id % 11 = 3 OR id % 13 = 4) AS rows_updated, count(*) FILTER (id % 11 = 3) AS total, count(*) FILTER (id % 13 = 4) AS most FROM t"))
def v14_counts(spark, sf):
    t, aggs = _stored(spark, sf)
    done = integrity.repair_aggregates(t.df, t.spec, aggs)
    return spark.createDataFrame([(done.rows_updated, done.per_column["total"], done.per_column["most"])], "rows_updated long, total long, most long")


@query("V15", "SELECT * FROM (VALUES ('near', true), ('far', false), ('large', true), ('nulls', true), ('one null', false), ('set', true)) AS v(pair, same)")
def v15(spark, sf):
    num, text = Agg.avg("x").into("x"), Agg.string_agg("x").distinct().into("x")
    rows = [("near", 1.0, 1.00005), ("far", 1.0, 1.1), ("large", 1e12, 1e12 + 100), ("nulls", None, None), ("one null", 1.0, None)]
    df = spark.createDataFrame(rows, "pair string, a double, b double").select("pair", integrity.values_equal(num, F.col("a"), F.col("b"), "double").alias("same"))
    sets = spark.createDataFrame([("set", "a, b", "b, a")], "pair string, a string, b string").select("pair", integrity.values_equal(text, F.col("a"), F.col("b"), "string").alias("same"))
    return df.union(sets)


# Paths


def _path(name: str, make, oracle: str):
    query(name, oracle)(lambda spark, sf: (lambda t: t.path(make(t.spec)).df.select("id", "path"))(data.heap(spark, sf)))


def _path_sql(seg: str, wrap: bool = True, sep: str = "/") -> str:
    body = f"string_agg({seg}, '{sep}' ORDER BY cl.dist DESC)"
    return sql.heap(f"SELECT cl.node AS id, {f"'{sep}' || {body} || '{sep}'" if wrap else body} AS path FROM cl JOIN t AS a ON a.id = cl.anc GROUP BY cl.node")


_path("H1", lambda s: paths.PathSpec.slug("path", "name"), _path_sql("replace(a.name, ' ', '-')"))
_path("H1b", lambda s: paths.PathSpec.key("path", s), _path_sql("CAST(a.id AS VARCHAR)"))
_path("H2", lambda s: paths.PathSpec.attribute("path", "brand", separator=".", wrap=False), _path_sql("a.brand", False, "."))


@query("H3", sql.heap("SELECT id, problem FROM (SELECT id, CASE WHEN size % 10 = 0 THEN 'empty' WHEN size % 10 = 1 THEN 'separator' WHEN count(*) OVER (PARTITION BY parent_id, CASE WHEN size % 10 = 0 THEN '' WHEN size % 10 = 1 THEN 'a/b' ELSE brand END) > 1 THEN 'duplicate' END AS problem FROM t) WHERE problem IS NOT NULL"))
def h3(spark, sf):
    t = data.heap(spark, sf)
    seg = F.when(F.col("size") % 10 == 0, "").when(F.col("size") % 10 == 1, "a/b").otherwise(F.col("brand"))
    return paths.problems(t.df, t.spec, paths.PathSpec.of("path", seg))


@query("H4", sql.heap("SELECT cl.node AS id, '/' || string_agg(CASE WHEN a.id = 4 THEN 'moved' ELSE CAST(a.id AS VARCHAR) END, '/' ORDER BY cl.dist DESC) || '/' AS path FROM cl JOIN t AS a ON a.id = cl.anc GROUP BY cl.node"))
def h4(spark, sf):
    t = data.heap(spark, sf)
    p = t.path(paths.PathSpec.key("path", t.spec)).df
    return p.select("id", rewrite_prefix(F.col("path"), F.lit("/0/1/4/"), F.lit("/0/1/moved/")).alias("path"))


_MOVED_PATH = "SELECT cl.node AS id, '/' || CASE WHEN cl.node IN (SELECT node FROM cl WHERE anc = 4) THEN '0/2/4' || coalesce('/' || string_agg(CAST(a.id AS VARCHAR), '/' ORDER BY cl.dist DESC) FILTER (a.id <> 4 AND a.id IN (SELECT node FROM cl WHERE anc = 4)), '') ELSE string_agg(CAST(a.id AS VARCHAR), '/' ORDER BY cl.dist DESC) END || '/' AS path FROM cl JOIN t AS a ON a.id = cl.anc GROUP BY cl.node"


@query("H4_move", sql.heap(_MOVED_PATH))
def h4_move(spark, sf):
    """A moved subtree's paths follow."""
    t = data.heap(spark, sf)
    p = paths.PathSpec.key("path", t.spec)
    return paths.rewritten(t.path(p).df, t.spec, p, ANCHOR, lambda d: mutate.append_to(d, t.spec, ANCHOR, 2)).select("id", "path")


@query("H4_rename", sql.heap("SELECT cl.node AS id, '/' || string_agg(CASE WHEN a.id = 4 THEN 'renamed' ELSE a.brand END, '/' ORDER BY cl.dist DESC) || '/' AS path FROM cl JOIN t AS a ON a.id = cl.anc GROUP BY cl.node"))
def h4_rename(spark, sf):
    t = data.heap(spark, sf)
    p = paths.PathSpec.attribute("path", "brand")
    rename = lambda d: d.withColumn("brand", F.when(F.col("id") == ANCHOR, "renamed").otherwise(F.col("brand")))
    return paths.rewritten(t.path(p).df, t.spec, p, ANCHOR, rename).select("id", "path")


@query("slug", "SELECT CAST(p_partkey AS BIGINT) AS id, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(spark, sf):
    return data.heap_rows(spark, sf).select("id", slug(F.concat("name", F.lit(" & "), "brand")).alias("slug"))


@query("truth", "SELECT * FROM (VALUES ('', false), ('0', false), (' F ', false), ('False', false), ('yes', true), ('1', true)) AS v(text, value)")
def truths(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("", "0", " F ", "False", "yes", "1")], "text string")
    return rows.select("text", truth(F.col("text"), "string").alias("value"))


# Diff


def _diff(spark, sf) -> tree_diff.TreeDiff:
    before, after = data.diff_pair(spark, sf)
    return tree_diff.between(before, after, data.HEAP)


@query("D1", sql.diff("SELECT 'added' AS kind, count(*) AS n FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'removed', count(*) FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'moved', count(*) FROM a JOIN b USING (id) WHERE a.parent_id IS DISTINCT FROM b.parent_id OR a.place <> b.place UNION ALL SELECT 'modified', count(*) FROM a JOIN b USING (id) WHERE a.size <> b.size"))
def d1(spark, sf):
    return _diff(spark, sf).to_rows().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("D2", sql.diff("SELECT a.id, a.parent_id AS old_parent, b.parent_id AS new_parent, a.place AS old_position, b.place AS new_position FROM a JOIN b USING (id) WHERE a.parent_id IS DISTINCT FROM b.parent_id OR a.place <> b.place"))
def d2(spark, sf):
    return _diff(spark, sf).moved


@query("D3", sql.diff("""SELECT a.id, '{"size":"' || a.size || '"}' AS old_values, '{"size":"' || b.size || '"}' AS new_values FROM a JOIN b USING (id) WHERE a.size <> b.size"""))
def d3(spark, sf):
    return _diff(spark, sf).modified


@query("D4", sql.diff("SELECT b.id, b.parent_id FROM b WHERE b.id NOT IN (SELECT id FROM a)"))
def d4(spark, sf):
    return _diff(spark, sf).added.select("id", "parent_id")


@query("D5", sql.diff("SELECT 'removed' AS kind, b.id FROM b WHERE b.id NOT IN (SELECT id FROM a) UNION ALL SELECT 'added', a.id FROM a WHERE a.id NOT IN (SELECT id FROM b)"))
def d5(spark, sf):
    back = _diff(spark, sf).invert()
    return back.removed.select(F.lit("removed").alias("kind"), "id").union(back.added.select(F.lit("added"), "id"))


@query("D6", sql.diff("SELECT id, parent_id, size FROM b"))
def d6(spark, sf):
    before, _ = data.diff_pair(spark, sf)
    return tree_diff.apply(before, _diff(spark, sf)).select("id", "parent_id", "size")


@query("D7", "SELECT * FROM (VALUES ('dangling', 'DanglingParentError'), ('duplicate', 'DuplicateIdentityError'), ('missing', 'ConfigurationError')) AS v(fault, error)")
def d7(spark, sf):
    t = data.heap(spark, sf)
    rows = t.plain()
    faults = {"dangling": (rows.filter("id <> 1"), None), "duplicate": (rows.union(rows.filter("id = 5")), None), "missing": (rows, "nothing")}
    out = []
    for name, (df, on) in faults.items():
        try:
            tree_diff.between(rows, df, t.spec, on)
            out.append((name, "none"))
        except TreeError as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "fault string, error string")


# Maintenance

_SUM = "SELECT anc AS id, CAST(sum({x}) AS BIGINT) AS total FROM cl JOIN t ON t.id = cl.node GROUP BY anc"


def _totals(spark, sf) -> Tree:
    t = data.heap(spark, sf)
    return Tree(t.with_fresh(Agg.sum("size").into("total"), Agg.count("score").into("n"), Agg.sum("score").into("s"), Agg.max("size").into("most"), Agg.min("size").into("least")), t.spec)


def _deltas(spark, sf) -> DataFrame:
    return data.heap_rows(spark, sf).filter("size > 40").select("id", (F.col("size") * 2).cast("long").alias("d"))


@query("L1", sql.heap(_SUM.format(x="CASE WHEN t.size > 40 THEN size * 3 ELSE size END")))
def l1(spark, sf):
    return _totals(spark, sf).maintain("apply_deltas", _deltas(spark, sf), {"total": "d"}).df.select("id", "total")


@query("L2", sql.heap(f"SELECT anc AS id, round(avg(CAST(score AS DOUBLE)), 6) AS value {_JOIN}"))
def l2(spark, sf):
    return _totals(spark, sf).df.select("id", F.round(incremental.display("avg", F.col("s"), F.col("n")), 6).alias("value"))


@query("L3", sql.heap("SELECT anc AS id, max(CASE WHEN t.size > 40 THEN greatest(size, 60) ELSE size END) AS most, min(size) AS least FROM cl JOIN t ON t.id = cl.node GROUP BY anc"))
def l3(spark, sf):
    t = _totals(spark, sf)
    new = t.df.filter("size > 40").select("id", F.lit(60).alias("size"))
    return incremental.push_extremes(t.df, t.spec, new, "size", "least", "most").select("id", "most", "least")


@query("L4", sql.heap("SELECT anc AS id, max(CASE WHEN t.id = 100 THEN 0 ELSE size END) AS most FROM cl JOIN t ON t.id = cl.node GROUP BY anc"))
def l4(spark, sf):
    t = _totals(spark, sf)
    changed = t.df.withColumn("size", F.when(F.col("id") == 100, 0).otherwise(F.col("size")))
    return incremental.recompute(changed, t.spec, changed.filter("id = 100"), [Agg.max("size").into("most")]).select("id", "most")


@query("L5", sql.heap("SELECT id, CASE WHEN id IN (SELECT anc FROM cl WHERE node = 100) THEN NULL ELSE CAST(-1 AS BIGINT) END AS total FROM t"))
def l5(spark, sf):
    t = _lazy(spark, sf)
    return t.maintain("invalidate", t.df.filter("id = 100"), [Agg.sum("size").as_lazy().into("total")]).df.select("id", "total")


@query("L6", sql.heap("SELECT anc AS id, CAST(sum(size) AS BIGINT) AS total FROM cl JOIN t ON t.id = cl.node WHERE cl.node NOT IN (SELECT node FROM cl WHERE anc = 40) AND anc NOT IN (SELECT node FROM cl WHERE anc = 40) GROUP BY anc"))
def l6(spark, sf):
    """A deletion takes the subtree's total off its ancestors."""
    t = _totals(spark, sf)
    off = t.df.filter("id = 40").select("id", (-F.col("total")).alias("d"))
    return mutate.delete(incremental.apply_deltas(t.df, t.spec, off, {"total": "d"}), t.spec, 40).select("id", "total")


_KEPT = [Agg.sum("size").into("total"), Agg.max("size").into("most"), Agg.min("size").into("least")]
_UP = "SELECT anc AS id, CAST(sum(size) AS BIGINT) AS total, max(size) AS most, min(size) AS least"


@query("L6_move", sql.heap(f"{_UP} FROM (SELECT * FROM cl WHERE NOT (node IN (SELECT node FROM cl WHERE anc = 40) AND anc NOT IN (SELECT node FROM cl WHERE anc = 40)) UNION ALL SELECT s.node, c.anc, 0 FROM (SELECT node FROM cl WHERE anc = 40) AS s, (SELECT anc FROM cl WHERE node = 5) AS c) AS m JOIN t ON t.id = m.node GROUP BY anc"))
def l6_move(spark, sf):
    """A moved subtree takes its totals off the old chain and onto the new one."""
    t = _totals(spark, sf)
    return incremental.on_move(t.df, t.spec, _KEPT, 40, lambda d: mutate.append_to(d, t.spec, 40, 5)).select("id", "total", "most", "least")


@query("L6_create", sql.heap(f"{_UP} FROM (SELECT anc, size FROM cl JOIN t ON t.id = cl.node UNION ALL SELECT anc, 99 FROM cl WHERE node = 40 UNION ALL SELECT 99999999, 99) GROUP BY anc"))
def l6_create(spark, sf):
    t = _totals(spark, sf)
    new = {"id": 99999999, "size": 99}
    return incremental.on_create(t.df, t.spec, _KEPT, 99999999, lambda d: mutate.append_to(d, t.spec, new, 40)).select("id", "total", "most", "least")


@query("L6_restore", sql.heap(f"{_UP} FROM cl JOIN t ON t.id = cl.node GROUP BY anc"))
def l6_restore(spark, sf):
    """Deleted softly and restored: every chain is as it was."""
    t = _totals(spark, sf)
    spec = TreeSpec(deleted="deleted_at")
    rows = t.df.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    gone = incremental.on_delete(rows, spec, _KEPT, 40, lambda d: mutate.soft_delete(d, spec, 40, datetime(2024, 5, 5)))
    return incremental.on_restore(gone, spec, _KEPT, 40).select("id", "total", "most", "least")


_TURNS = "SELECT cl.conv_id, anc AS id, CAST(sum(length {more}) AS BIGINT) AS total FROM cl JOIN t ON t.conv_id = cl.conv_id AND t.id = cl.node GROUP BY cl.conv_id, anc"


def _turns(spark, sf) -> Tree:
    """Conversations, whose turns have the same ids in each, with stored totals."""
    t = data.conversations(spark, sf)
    return Tree(t.with_fresh(Agg.sum("length").into("total"), Agg.max("length").into("most")), t.spec)


def _turn_deltas(t: Tree) -> DataFrame:
    return t.df.filter("conv_id % 3 = 0 AND length > 40").select("conv_id", "id", F.col("length").alias("d"))


@query("L1_scoped", sql.conversations(_TURNS.format(more="+ CASE WHEN cl.conv_id % 3 = 0 AND length > 40 THEN length ELSE 0 END")))
def l1_scoped(spark, sf):
    t = _turns(spark, sf)
    return t.maintain("apply_deltas", _turn_deltas(t), {"total": "d"}).df.select("conv_id", "id", "total")


@query("L3_scoped", sql.conversations("SELECT cl.conv_id, anc AS id, max(CASE WHEN cl.conv_id % 3 = 0 AND length > 40 THEN length + 1000 ELSE length END) AS most FROM cl JOIN t ON t.conv_id = cl.conv_id AND t.id = cl.node GROUP BY cl.conv_id, anc"))
def l3_scoped(spark, sf):
    t = _turns(spark, sf)
    added = t.df.filter("conv_id % 3 = 0 AND length > 40").select("conv_id", "id", (F.col("length") + 1000).alias("length"))
    return incremental.push_extremes(t.df, t.spec, added, "length", high="most").select("conv_id", "id", "most")


@query("L5_scoped", sql.conversations("SELECT t.conv_id, t.id, CASE WHEN t.conv_id % 2 = 0 AND t.i <= (SELECT max(u.i) FROM t AS u WHERE u.conv_id = t.conv_id AND u.length > 40) THEN NULL ELSE CAST(-1 AS BIGINT) END AS total FROM t"))
def l5_scoped(spark, sf):
    t = data.conversations(spark, sf)
    lazy = Agg.sum("length").as_lazy().into("total")
    rows = t.df.withColumns({"total": F.lit(-1).cast("long"), incremental.stamp_of(lazy): F.lit(datetime(2024, 5, 5))})
    return incremental.invalidate(rows, t.spec, t.df.filter("conv_id % 2 = 0 AND length > 40"), [lazy]).select("conv_id", "id", "total")


def _first(t: Tree) -> NodeKey:
    """The second turn of the first conversation that has one."""
    r = t.df.filter("parent_id IS NOT NULL").orderBy("conv_id", "lft").select("conv_id", "id").first()
    return NodeKey(r["id"], (r["conv_id"],))


@query("T14_scoped", sql.conversations("SELECT conv_id, id, CASE WHEN conv_id = f THEN 1 ELSE lft END AS lft, CASE WHEN conv_id = f THEN 2 ELSE rgt END AS rgt FROM t, (SELECT min(conv_id) AS f FROM t WHERE i = 2) WHERE conv_id <> f OR i = 1"))
def t14_scoped(spark, sf):
    """A deletion in one conversation leaves equal ids of others alone."""
    t = data.conversations(spark, sf)
    return mutate.delete(t.df, t.spec, _first(t)).select("conv_id", "id", "lft", "rgt")


@query("T8_scoped", sql.conversations("SELECT conv_id, id, CASE WHEN conv_id <> f THEN lft WHEN i = 1 THEN 1 ELSE lft + 1 END AS lft, CASE WHEN conv_id <> f THEN rgt WHEN i = 1 THEN 2 ELSE rgt + 1 END AS rgt FROM t, (SELECT min(conv_id) AS f FROM t WHERE i = 2)"))
def t8_scoped(spark, sf):
    """A turn made a root of its own conversation."""
    t = data.conversations(spark, sf)
    return mutate.make_root(t.df, t.spec, _first(t)).select("conv_id", "id", "lft", "rgt")


@query("D_scoped", sql.conversations("SELECT 'modified' AS kind, conv_id, id FROM t WHERE conv_id % 3 = 0 AND i > 1 AND NOT (conv_id % 5 = 1 AND i = m) UNION ALL SELECT 'removed', conv_id, id FROM t WHERE conv_id % 5 = 1 AND i = m"))
def d_scoped(spark, sf):
    """Snapshots whose ids repeat over scopes, compared scope by scope."""
    t = data.conversations(spark, sf)
    rows = t.plain()
    last = rows.groupBy("conv_id").agg(F.max("lft").alias("z"))
    after = rows.join(last, "conv_id").filter(~((F.col("conv_id") % 5 == 1) & (F.col("lft") == F.col("z")))).drop("z")
    after = after.withColumn("length", F.when((F.col("conv_id") % 3 == 0) & (F.col("depth") > 0), F.col("length") + 1).otherwise(F.col("length")))
    out = tree_diff.between(rows, after, t.spec)
    return out.modified.select(F.lit("modified").alias("kind"), "conv_id", "id").union(out.removed.select(F.lit("removed"), "conv_id", "id"))


@query("L7", sql.heap(_SUM.format(x="CASE WHEN t.id = 5 THEN 7 WHEN t.id = 50 THEN 9 ELSE size END")))
def l7(spark, sf):
    """Several changes, one repair at the end."""
    t = _totals(spark, sf)
    rows = t.df.withColumn("size", F.when(F.col("id") == 5, 7).otherwise(F.col("size"))).withColumn("size", F.when(F.col("id") == 50, 9).otherwise(F.col("size")))
    return integrity.fix_aggregates(rows, t.spec, [Agg.sum("size").into("total")]).select("id", "total")


@query("L8", sql.heap(_SUM.format(x="size")))
def l8(spark, sf):
    """A repair in chunks that stops after the second and is taken up again."""
    t, aggs = _stored(spark, sf)
    told: list[integrity.Chunk] = []

    def stop(chunk: integrity.Chunk) -> None:
        told.append(chunk)
        if len(told) == 2:
            raise InterruptedError

    try:
        integrity.repair_aggregates(t.df, t.spec, aggs[:1], chunk_rows=20, on_chunk=stop)
    except InterruptedError:
        pass
    return integrity.repair_aggregates(t.df, t.spec, aggs[:1], chunk_rows=20, on_chunk=told.append, done=len(told)).tree.select("id", "total")


@query("stream_scoped", sql.conversations(_TURNS.format(more="+ CASE WHEN cl.conv_id % 3 = 0 AND length > 40 THEN length ELSE 0 END")))
def stream_scoped(spark, sf):
    """The change log of many scopes as a stream."""
    t = _turns(spark, sf)
    log = materialise(_turn_deltas(t), "log")
    path = log.inputFiles()[0].rpartition("/")[0]
    state = [t.df]

    def save(df: DataFrame, number: int) -> None:
        state[0] = materialise(df, "totals")

    maintain(spark.readStream.schema(log.schema).parquet(path), t.spec, lambda: state[0], save, {"total": "d"}, path + "-checkpoint").awaitTermination()
    return state[0].select("conv_id", "id", "total")


@query("L9", sql.heap("SELECT anc AS id, CAST(sum(t.size) + CASE WHEN any_value(o.size) > 10 THEN coalesce(sum(2 * t.size) FILTER (t.size > 40), 0) ELSE 0 END AS BIGINT) AS total FROM cl JOIN t ON t.id = cl.node JOIN t AS o ON o.id = cl.anc GROUP BY anc"))
def l9(spark, sf):
    """Soft-deleted ancestors keep the total they had."""
    s = data.soft_heap(spark, sf)
    rows = s.with_fresh(Agg.sum("size").into("total"), with_trashed=True)
    return incremental.apply_deltas(rows, s.spec, _deltas(spark, sf), {"total": "d"}).select("id", "total")


@query("L10", sql.heap("SELECT id, CAST(0 AS BIGINT) AS total, CAST(NULL AS INTEGER) AS most FROM t"))
def l10(spark, sf):
    t, aggs = _stored(spark, sf)
    return incremental.reset(t.df, aggs).select("id", "total", "most")


@query("change_feed", sql.heap("SELECT anc AS node, 'total' AS \"column\", CAST(sum(size) AS VARCHAR) AS old, CAST(sum(CASE WHEN t.size > 40 THEN size * 3 ELSE size END) AS VARCHAR) AS new, 'updated' AS stage FROM cl JOIN t ON t.id = cl.node GROUP BY anc HAVING count(*) FILTER (t.size > 40) > 0"))
def feed(spark, sf):
    t = _totals(spark, sf)
    after = t.maintain("apply_deltas", _deltas(spark, sf), {"total": "d"})
    return incremental.changes(t.df, after.df, t.spec, ["total"]).select("node", "column", "old", "new", "stage")


@query("stream", sql.heap(_SUM.format(x="CASE WHEN t.size > 40 THEN size * 3 ELSE size END")))
def stream(spark, sf):
    """The change log as a stream, folded into stored totals."""
    log = materialise(_deltas(spark, sf), "log")
    path = log.inputFiles()[0].rpartition("/")[0]
    state = [_totals(spark, sf).df]

    def save(df: DataFrame, number: int) -> None:
        state[0] = materialise(df, "totals")

    source = spark.readStream.schema(log.schema).parquet(path)
    run = maintain(source, data.HEAP, lambda: state[0], save, {"total": "d"}, path + "-checkpoint")
    run.awaitTermination()
    return state[0].select("id", "total")

