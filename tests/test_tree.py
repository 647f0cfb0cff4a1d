"""Hand-checked values, shapes and properties of the tree operators."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from canopy.errors import AmbiguousNodeError, ConfigurationError, CorruptTreeError, CyclicMoveError, EmptySegmentError, ScopeViolationError, SiblingOrderError, TrashedAncestorError
from canopy.operators import diff, incremental, integrity, mutate, paths, walk
from canopy.operators.rollup import NODE
from canopy.plans import scratch
from canopy.plans.build import ANC, REACHED, build
from canopy.sources import export, generator, json_tree
from canopy.spec import Agg, NodeKey, TreeSpec
from canopy.tree import Tree

# id, parent, name, x, w, flag, bits; siblings by id
ROWS = [(1, None, "a", 4, 1, True, 1), (2, 1, "b", 2, 2, False, 3), (3, 2, "c", 8, 1, True, 5), (4, 2, "d", None, 3, None, 6), (5, 1, "e", -1, 1, True, 8), (6, None, "f", 7, 1, False, 2)]
BOUNDS = {1: (1, 10, 0), 2: (2, 7, 1), 3: (3, 4, 2), 4: (5, 6, 2), 5: (8, 9, 1), 6: (11, 12, 0)}


@pytest.fixture(scope="module")
def tree(spark):
    df = spark.createDataFrame(ROWS, "id long, parent_id long, name string, x int, w int, flag boolean, bits long")
    return Tree(build(df, TreeSpec()).cache())


def bounds(df):
    return {r["id"]: (r["lft"], r["rgt"], r["depth"]) for r in df.collect()}


def at(df, key):
    return df.filter(F.col(NODE) == key).first()


def test_build(tree):
    assert bounds(tree.df) == BOUNDS


def test_rollup_by_hand(tree):
    aggs = {
        "n": Agg.count(), "nx": Agg.count("x"), "s": Agg.sum("x"), "avg": Agg.avg("x"), "lo": Agg.min("x"), "hi": Agg.max("x"), "bo": Agg.bit_or("bits"), "bx": Agg.bit_xor("bits"),
        "any": Agg.bool_or("flag"), "all": Agg.bool_and("flag"), "w": Agg.weighted_avg("x", "w"), "g": Agg.geometric_mean("x"), "med": Agg.median("x"), "top": Agg.top_k("id", 2, "x"),
        "names": Agg.string_agg("name"), "ex": Agg.sum("x").exclusive(), "en": Agg.count().exclusive(), "eb": Agg.bit_or("bits").exclusive(),
    }
    r = tree.rollup(*[a.into(n) for n, a in aggs.items()])
    one, four = at(r, 1), at(r, 4)
    assert (one.n, one.nx, one.s, one.avg, one.lo, one.hi, one.bo, one.bx) == (5, 4, 13, 3.25, -1, 8, 15, 1 ^ 3 ^ 5 ^ 6 ^ 8)
    assert (one.any, one.all, one.w, round(one.g, 9), one.med, one.top, one.names, one.ex, one.en) == (True, False, 1.875, 4.0, 3.0, "[[3,8],[1,4]]", "a, b, c, d, e", 9, 4)
    assert (four.s, four.n, four.nx, four.avg, four.any, four.ex, four.en, four.eb) == (0, 1, 0, None, None, 0, 0, None)


def shapes(spark):
    rng = random.Random(7)
    rows = [(i, None if i < 4 else rng.randint(1, i - 1), rng.choice([None, *range(-9, 10)]), rng.randint(1, 5), rng.random() < 0.5) for i in range(1, 121)]
    yield spark.createDataFrame(rows, "id long, parent_id long, x int, w int, flag boolean")
    for df in (generator.chain(spark, 40), generator.flat_roots(spark, 10), generator.wide_root(spark, 30), generator.comb(spark, 41), generator.forest(spark, 60, 3), generator.uniform(spark, 4, [2, 3, 1])):
        yield df.select("id", "parent_id", F.when(F.col("id") % 4 > 0, F.col("id") % 9 - 3).cast("int").alias("x"), (F.col("id") % 3 + 1).cast("int").alias("w"), (F.col("id") % 2 == 0).alias("flag"))


def test_strategies_agree_on_all_shapes(spark):
    sums = [Agg.sum("x").into("a"), Agg.count("x").exclusive().into("b"), Agg.avg("x").into("c"), Agg.variance("x").into("d"), Agg.stddev("x", True).into("e"), Agg.weighted_avg("x", "w").into("f"), Agg.bool_or("flag").into("g"), Agg.bool_and("flag").exclusive().into("h"), Agg.geometric_mean("x").into("i"), Agg.harmonic_mean("w").filter_not_null("x").into("j")]
    folds = [Agg.min("x").into("a"), Agg.max("x").exclusive().into("b"), Agg.bit_or("w").into("c"), Agg.bit_and("w").into("d"), Agg.bit_xor("w").exclusive().into("e")]

    def table(t, aggs, way):
        return {r[NODE]: [round(v, 6) if isinstance(v, float) else v for v in r[2:]] for r in t.rollup(*aggs, strategy=way).collect()}

    for df in shapes(spark):
        t = Tree(build(df, TreeSpec()).cache())
        assert table(t, sums, "closure") == table(t, sums, "prefix") == table(t, sums, "interval")
        assert table(t, folds, "closure") == table(t, folds, "blocks")
        assert not integrity.is_broken(t.df, t.spec)


def test_deep_chain_has_no_paths_and_right_bounds(spark, monkeypatch):
    monkeypatch.setattr("canopy.plans.build.PATH_LIMIT", 8)
    out = build(generator.chain(spark, 60), TreeSpec())
    assert ANC not in out.columns
    assert bounds(out) == {i: (i, 121 - i, i - 1) for i in range(1, 61)}
    out = build(generator.comb(spark, 41), TreeSpec())
    monkeypatch.undo()
    assert bounds(out) == bounds(build(generator.comb(spark, 41), TreeSpec()))


def test_deep_chain_still_has_every_function(spark, monkeypatch):
    monkeypatch.setattr("canopy.plans.build.PATH_LIMIT", 8)
    t = Tree(build(generator.chain(spark, 30), TreeSpec()))
    assert ANC not in t.df.columns
    one = at(t.rollup(Agg.sum("id").into("s"), Agg.max("id").into("m"), Agg.median("id").into("d"), Agg.distinct_count("id").into("c")), 1)
    assert (one.s, one.m, one.d, one.c) == (465, 30, 15.5, 30)


def test_orphans_and_cycles_keep_their_values(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 1, 5), (3, 9, 5), (4, 3, 5), (5, 6, 5), (6, 5, 5)], "id long, parent_id long, lft long")
    out = {r["id"]: (r["lft"], r[REACHED]) for r in build(df, TreeSpec()).collect()}
    assert out == {1: (1, True), 2: (2, True), 3: (5, False), 4: (5, False), 5: (5, False), 6: (5, False)}
    with pytest.raises(CorruptTreeError):
        export.guard(df, TreeSpec())


def test_scopes_with_nulls_and_reserved_names(spark):
    spec = TreeSpec("key", "parent", "left", "right", "order", ("select",))
    df = spark.createDataFrame([(1, None, None), (2, 1, None), (1, None, "s"), (3, 1, "s")], "key long, parent long, select string")
    out = {(r["select"], r["key"]): (r["left"], r["right"], r["order"]) for r in build(df, spec).collect()}
    assert out == {(None, 1): (1, 4, 0), (None, 2): (2, 3, 1), ("s", 1): (1, 4, 0), ("s", 3): (2, 3, 1)}


def test_empty_table(spark):
    out = build(spark.createDataFrame([], "id long, parent_id long, x int"), TreeSpec())
    assert out.count() == 0
    assert Tree(out).rollup(Agg.sum("x").into("s")).count() == 0


def test_changes_match_a_rebuild(tree):
    s = tree.spec
    moved = mutate.append_to(tree.df, s, 2, 6)
    assert bounds(moved) == bounds(build(moved, s))
    assert bounds(mutate.delete(tree.df, s, 2)) == {1: (1, 4, 0), 5: (2, 3, 1), 6: (5, 6, 0)}
    swapped = mutate.reorder_children(tree.df, s, 1, [5, 2])
    assert bounds(swapped) == {1: (1, 10, 0), 5: (2, 3, 1), 2: (4, 9, 1), 3: (5, 6, 2), 4: (7, 8, 2), 6: (11, 12, 0)}
    assert bounds(mutate.up(tree.df, s, 5)[0]) == bounds(swapped)
    assert mutate.up(tree.df, s, 2)[1] is False
    with pytest.raises(SiblingOrderError):
        mutate.reorder_children(tree.df, s, 1, [5])
    with pytest.raises(CyclicMoveError):
        mutate.append_to(tree.df, s, 1, 3)


def test_random_moves_keep_the_tree_whole(spark):
    rng = random.Random(42)
    spec = TreeSpec()
    df = build(generator.forest(spark, 12, 2), spec).drop(ANC, REACHED)
    for _ in range(6):
        a, b = rng.sample(range(1, 13), 2)
        try:
            df = mutate.move_to(df, spec, a, b, rng.choice(["first", "last", 0, 1]))
        except CyclicMoveError:
            continue
        df = spark.createDataFrame(df.collect(), df.schema)
        assert not integrity.is_broken(df, spec)


def test_soft_delete_and_restore(tree):
    spec = TreeSpec(deleted="gone")
    rows = tree.df.withColumn("gone", F.lit(None).cast("timestamp"))
    one = mutate.soft_delete(rows, spec, 3, datetime(2024, 1, 1))
    two = mutate.soft_delete(one, spec, 2, datetime(2024, 1, 2))
    with pytest.raises(TrashedAncestorError):
        mutate.restore(two, spec, 3)
    back = mutate.restore(two, spec, 2)
    assert [r["id"] for r in back.filter("gone is not null").collect()] == [3]
    r = Tree(one, spec).rollup(Agg.sum("x").into("s"), Agg.count().into("n"))
    assert (at(r, 2).s, at(r, 3).s, at(r, 3).n) == (2, 0, 0)


def test_repair_restores_damage(tree):
    hurt = tree.df.withColumn("lft", F.when(F.col("id") == 3, 50).otherwise(F.col("lft")))
    assert integrity.is_broken(hurt, tree.spec)
    fixed = integrity.fix_and_count(hurt, tree.spec)
    assert bounds(fixed.tree) == BOUNDS and fixed.changed == 1 and not fixed.has_errors


def test_drift_and_fix(tree):
    agg = Agg.sum("x").into("s")
    stored = tree.with_fresh(agg).withColumn("s", F.when(F.col("id") == 2, 99).otherwise(F.col("s")))
    assert integrity.aggregate_errors(stored, tree.spec, [agg]).first()["s"] == 1
    fixed = integrity.fix_aggregates(stored, tree.spec, [agg])
    assert integrity.aggregate_errors(fixed, tree.spec, [agg]).first()["s"] == 0


def test_paths(tree):
    made = {r["id"]: r["p"] for r in paths.validated(tree.df, tree.spec, paths.PathSpec.attribute("p", "name")).collect()}
    assert made == {1: "/a/", 2: "/a/b/", 3: "/a/b/c/", 4: "/a/b/d/", 5: "/a/e/", 6: "/f/"}
    with pytest.raises(EmptySegmentError):
        paths.validated(tree.df, tree.spec, paths.PathSpec.of("p", F.lit("")))


def test_exports_and_json_round_trip(spark, tree):
    text = export.text(export.ascii_lines(tree.df, tree.spec, F.col("name")), tree.spec)
    assert text == "a\n├── b\n│   ├── c\n│   └── d\n└── e\nf"
    assert export.text(export.mermaid_lines(tree.df.filter("id > 4"), tree.spec, F.lit('<"x">')), tree.spec) == 'graph TD\n    n5["&lt;&quot;x&quot;&gt;"]\n    n6["&lt;&quot;x&quot;&gt;"]'
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType())])
    back = json_tree.parse(spark, export.to_json(tree.df, tree.spec, F.col("name")), schema)
    assert bounds(back) == BOUNDS


def test_diff_round_trip(tree):
    spec = tree.spec
    after = mutate.append_to(mutate.delete(tree.df, spec, 4), spec, 5, 6).withColumn("x", F.when(F.col("id") == 3, 9).otherwise(F.col("x")))
    d = diff.between(tree.df, after, spec)
    assert d.summary() == {"added": 0, "removed": 1, "moved": 1, "modified": 1}
    got = diff.apply(tree.df, d)
    assert bounds(got) == bounds(after)
    assert diff.between(got, after, spec).is_empty()
    assert diff.between(tree.df, tree.df, spec).is_empty()


def test_walk_filter_and_signals(tree):
    kept = walk.filtered(tree.df, tree.spec, walk.WalkFilter(where=F.col("id") != 2))
    assert sorted(r["id"] for r in kept.collect()) == [1, 5, 6]
    seen = [r["id"] for r in tree.walk("visit", lambda r: walk.Signal.SKIP_SUBTREE if r["id"] == 2 else None)]
    assert seen == [1, 2, 5, 6]


def test_incremental_equals_recompute(spark, tree):
    agg = Agg.sum("x").into("s")
    stored = Tree(tree.with_fresh(agg), tree.spec)
    deltas = spark.createDataFrame([(3, 10), (5, -4)], "id long, d long")
    out = {r["id"]: r["s"] for r in incremental.apply_deltas(stored.df, stored.spec, deltas, {"s": "d"}).collect()}
    assert out == {1: 19, 2: 20, 3: 18, 4: 0, 5: -5, 6: 7}


def two_scopes(spark):
    """Two chains with equal ids."""
    rows = [(s, i, i - 1 if i > 1 else None, 10 * i) for s in ("a", "b") for i in (1, 2, 3)]
    spec = TreeSpec(scope=("s",))
    return Tree.from_adjacency(spark.createDataFrame(rows, "s string, id long, parent_id long, x long"), spec), spec


def test_equal_ids_of_two_scopes_are_two_nodes(spark):
    t, spec = two_scopes(spark)
    total = Tree(t.with_fresh(Agg.sum("x").into("total")), spec)
    delta = spark.createDataFrame([("a", 2, 1)], "s string, id long, d long")
    got = {(r["s"], r["id"]): r["total"] for r in incremental.apply_deltas(total.df, spec, delta, {"total": "d"}).collect()}
    assert got == {("a", 1): 61, ("a", 2): 51, ("a", 3): 30, ("b", 1): 60, ("b", 2): 50, ("b", 3): 30}
    with pytest.raises(ConfigurationError):
        incremental.apply_deltas(total.df, spec, delta.drop("s"), {"total": "d"})
    with pytest.raises(AmbiguousNodeError):
        t.node(2)
    left = mutate.delete(t.df, spec, NodeKey(2, ("b",)))
    assert sorted((r["s"], r["id"], r["lft"], r["rgt"]) for r in left.collect()) == [("a", 1, 1, 6), ("a", 2, 2, 5), ("a", 3, 3, 4), ("b", 1, 1, 2)]
    moved = mutate.move_to(t.df, spec, NodeKey(3, ("a",)), NodeKey(1, ("a",)), "first")
    assert {(r["s"], r["id"]): r["parent_id"] for r in moved.collect()} == {("a", 1): None, ("a", 2): 1, ("a", 3): 1, ("b", 1): None, ("b", 2): 1, ("b", 3): 2}
    with pytest.raises(ScopeViolationError):
        mutate.append_to(t.df, spec, NodeKey(3, ("a",)), NodeKey(1, ("b",)))
    hurt = t.df.withColumn("lft", F.when((F.col("s") == "a") & (F.col("id") == 3), 0).otherwise(F.col("lft")))
    fixed = integrity.fix_subtree(hurt, spec, NodeKey(1, ("a",)))
    assert sorted((r["s"], r["id"], r["lft"], r["rgt"]) for r in fixed.collect()) == [(s, i, i, 7 - i) for s in "ab" for i in (1, 2, 3)]
    assert integrity.is_broken(hurt, spec, NodeKey(1, ("a",))) and not integrity.is_broken(hurt, spec, NodeKey(1, ("b",)))


def test_a_subtree_of_a_deep_chain_is_repaired(spark):
    n = 600
    rows = spark.range(1, n + 1).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))
    t = Tree.from_adjacency(rows)
    inside = F.col("id") > 300
    hurt = t.plain().withColumns({c: F.when(inside, F.lit(0)).otherwise(F.col(c)).cast("long") for c in ("lft", "rgt")})
    fixed = integrity.fix_subtree(hurt, t.spec, 300)
    assert {(r["id"], r["lft"], r["rgt"], r["depth"]) for r in fixed.collect()} == {(i, i, 2 * n + 1 - i, i - 1) for i in range(1, n + 1)}


def test_many_roots_and_their_siblings(spark):
    n = 20_000
    t = Tree.from_adjacency(spark.range(n).select("id", F.lit(None).cast("long").alias("parent_id")))
    last = t.walk("with_context").agg(F.max("sibling_index").alias("i"), F.min("sibling_count").alias("n"), F.count_if("is_last").alias("z")).first()
    assert tuple(last) == (n - 1, n, 1)
    assert t.relation("siblings", True, "next").filter(F.col("next") == F.col("id") + 1).count() == n - 1
    assert not integrity.is_broken(t.plain(), t.spec)


def test_json_of_a_deep_tree(spark):
    n = 200
    t = Tree.from_adjacency(spark.range(1, n + 1).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id")))
    text = export.to_json(t.df, t.spec)
    at, depth = json.loads(text), 0
    while at["children"]:
        (at,), depth = at["children"], depth + 1
    assert depth == n - 1


def test_no_shared_folder_on_a_cluster_raises(spark):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ConfigurationError):
        scratch.shared_dir(Elsewhere)
    written = scratch.materialise(spark.range(3), "t")
    again = scratch.materialise(written, "t", instead_of=written)
    assert again.count() == 3 and not scratch.exists(spark, written._scratch_path)


def test_stale_to_the_fraction_of_a_second(spark):
    lazy = Agg.sum("x").as_lazy(ttl=2).into("total")
    now = datetime(2024, 1, 1, 0, 0, 10, 500_000)
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 8, 500_000)), (2, datetime(2024, 1, 1, 0, 0, 8, 500_001)), (3, None)], "id long, total_computed_at timestamp")
    assert sorted(r["id"] for r in rows.filter(incremental.is_stale(lazy, now)).collect()) == [1, 3]


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_path_assembly_sends_no_table_of_nodes_through_the_driver(tree):
    rows = scratch.materialise(tree.df, "tree")
    made = paths.assemble(rows, tree.spec, paths.PathSpec.attribute("p", "name"))
    assert broadcasts(made) == 0
    assert {r["id"]: r["p"] for r in made.collect()} == {1: "/a/", 2: "/a/b/", 3: "/a/b/c/", 4: "/a/b/d/", 5: "/a/e/", 6: "/f/"}


def test_path_problems_send_no_table_of_nodes_through_the_driver(tree):
    rows = scratch.materialise(tree.df, "tree")
    found = paths.problems(rows, tree.spec, paths.PathSpec.of("p", F.when(F.col("id") > 4, "").otherwise("z")))
    assert broadcasts(found) == 0
    assert {(r["id"], r["problem"]) for r in found.collect()} == {(3, "duplicate"), (4, "duplicate"), (5, "empty"), (6, "empty")}


def test_rewritten_paths_send_no_table_of_nodes_through_the_driver(tree):
    rows, p = scratch.materialise(tree.df, "tree"), paths.PathSpec.key("p", tree.spec)
    moved = paths.rewritten(paths.assemble(rows, tree.spec, p), tree.spec, p, 2, lambda d: mutate.append_to(d, tree.spec, 2, 6))
    assert broadcasts(moved) == 0
    assert {r["id"]: r["p"] for r in moved.collect()} == {1: "/1/", 2: "/6/2/", 3: "/6/2/3/", 4: "/6/2/4/", 5: "/1/5/", 6: "/6/"}


@pytest.mark.parametrize("looped", [False, True])
def test_paths_found_anew_send_no_table_of_nodes_through_the_driver(spark, tree, looped):
    extra = [(8, 9, "h", 0, 0, False, 0), (9, 8, "i", 0, 0, False, 0)] if looped else []
    rows = scratch.materialise(spark.createDataFrame(ROWS + extra, "id long, parent_id long, name string, x int, w int, flag boolean, bits long"), "rows")
    moved = rows.withColumn("parent_id", F.when(F.col("id") == 2, 6).otherwise(F.col("parent_id")).cast("long"))
    made = paths.assemble(moved, tree.spec, paths.PathSpec.key("p", tree.spec))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "__p_node" in x]
    want = {1: "/1/", 2: "/6/2/", 3: "/6/2/3/", 4: "/6/2/4/", 5: "/1/5/", 6: "/6/"}
    assert {r["id"]: r["p"] for r in made.collect()} == want | ({8: None, 9: None} if looped else {})


def test_path_repair_sends_no_table_of_nodes_through_the_driver(tree):
    p = paths.PathSpec.key("p", tree.spec)
    stored = paths.assemble(tree.df, tree.spec, p).withColumn("p", F.when(F.col("id").isin(3, 5), "/wrong/").otherwise(F.col("p")))
    stored = scratch.materialise(stored, "stored")
    fixed, n = paths.fix_paths(stored, tree.spec, p, 2)
    assert broadcasts(fixed) == 0 and n == 1
    assert {r["id"]: r["p"] for r in fixed.collect()} == {1: "/1/", 2: "/1/2/", 3: "/1/2/3/", 4: "/1/2/4/", 5: "/wrong/", 6: "/6/"}


def crossing(rows):
    return sum(s == t and a < b < c < d for s, _, a, c in rows for t, _, b, d in rows)


@pytest.mark.parametrize("top", [6, 60, 10**9])
def test_overlaps_are_counted_and_no_pair_is_made(spark, monkeypatch, top):
    monkeypatch.setattr(integrity, "BLOCK_ROWS", 7)
    rnd = random.Random(top)
    rows = [(rnd.randrange(2), i, rnd.randrange(top), rnd.randrange(top)) for i in range(300)]
    df = spark.createDataFrame(rows, "tenant int, id long, lft long, rgt long")
    got = integrity.overlaps(df, TreeSpec(scope=("tenant",)))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.first()["n"] == crossing([r for r in rows if r[2] < r[3]])
    assert integrity.overlaps(df.limit(0), TreeSpec()).first()["n"] == 0


def test_checks_send_no_table_of_nodes_through_the_driver(tree):
    rows = scratch.materialise(tree.df, "tree")
    for name in ("parent_bounds_mismatch", "depth_mismatch", "bounds_out_of_range", "overlapping_bounds"):
        found = integrity.check(rows, tree.spec, name)
        assert found.first()["n"] == 0
        assert name == "overlapping_bounds" or broadcasts(found) == 0  # there, a row for each partition


def test_a_repair_in_many_chunks_writes_no_table_for_each(tree, monkeypatch):
    stored = scratch.materialise(tree.with_fresh(Agg.sum("x").into("total")).withColumn("total", F.col("total") + 1), "stored")
    written, told = [], []
    write = integrity.materialise
    monkeypatch.setattr(integrity, "materialise", lambda df, label, *a: written.append(label) or write(df, label, *a))

    def stop(chunk):
        told.append(chunk)
        if len(told) == 2:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        integrity.repair_aggregates(stored, tree.spec, [Agg.sum("x").into("total")], chunk_rows=1, on_chunk=stop)
    out = integrity.repair_aggregates(stored, tree.spec, [Agg.sum("x").into("total")], chunk_rows=1, on_chunk=told.append, done=2)
    assert written == ["fresh", "drift"] * 2
    assert [c.number for c in told] == list(range(6)) and [c.more for c in told] == [True] * 5 + [False]
    assert sum(c.rows_updated for c in told) == sum(c.per_column["total"] for c in told) == 6
    assert (out.rows_updated, out.per_column, out.chunks) == (6, {"total": 6}, 6)
    assert {r["id"]: r["total"] for r in out.tree.collect()} == {1: 13, 2: 10, 3: 8, 4: 0, 5: -1, 6: 7}
