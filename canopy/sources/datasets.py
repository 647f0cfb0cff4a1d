"""Trees over the test tables.  A built tree is written once for each session and
input folder and read again by later queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.build import ANC
from ..plans.scratch import materialise
from ..spec import TreeSpec
from ..tree import Tree

_built: dict[tuple[str, str, str], DataFrame] = {}

GEO = TreeSpec()
HEAP = TreeSpec()
CHAIN = TreeSpec(scope=("user_id",))
CONV = TreeSpec(scope=("conv_id",))
SOFT = TreeSpec(deleted="deleted_at")
KIND = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = materialise(make(), name)
    return _built[key]


def geo_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer, order: levels are known, so paths are plain joins.
    Columns id, parent_id, kind, cents, acctbal and the root path."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")

    def node(kind: int, key: str):
        return F.lit(kind * KIND).cast("long") + F.col(key).cast("long")

    r = region.select(node(1, "r_regionkey").alias("r"))
    n = nation.select(node(2, "n_nationkey").alias("n"), node(1, "n_regionkey").alias("r"))
    c = customer.select(node(3, "c_custkey").alias("c"), node(2, "c_nationkey").alias("n"))
    o = orders.select(node(4, "o_orderkey").alias("o"), node(3, "o_custkey").alias("c"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    none = F.lit(None).cast("long")
    # 5 regions and 25 nations at any scale; customers are left to the planner
    cn = c.join(F.broadcast(n), "n")
    on = o.join(cn, "c")
    rows = [
        r.select(F.col("r").alias("id"), none.alias("parent_id"), F.lit(1).alias("kind"), none.alias("cents"), F.array("r").alias(ANC)),
        n.select(F.col("n"), F.col("r"), F.lit(2), none, F.array("r", "n")),
        cn.select(F.col("c"), F.col("n"), F.lit(3), none, F.array("r", "n", "c")),
        on.select(F.col("o"), F.col("c"), F.lit(4), F.col("cents"), F.array("r", "n", "c", "o")),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


def heap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a ternary heap: the parent of key k > 0 is (k - 1) div 3."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("long")
    return p.select(
        key.alias("id"), F.when(key > 0, F.floor((key - 1) / 3)).cast("long").alias("parent_id"),
        F.col("p_size").cast("int").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"), (key % 7 + 1).cast("long").alias("weight"),
        F.when(key % 5 == 0, None).otherwise(F.col("p_size")).cast("int").alias("score"), (key % 3 == 0).alias("flag"),
    )


def heap(spark: SparkSession, sf_dir: str) -> Tree:
    return Tree(_once(spark, sf_dir, "heap", lambda: Tree.from_adjacency(heap_rows(spark, sf_dir), HEAP).df), HEAP)


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in time order, each below the one before."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.col("event_id").alias("id"), F.lag("event_id").over(w).alias("parent_id"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


def chain(spark: SparkSession, sf_dir: str) -> Tree:
    return Tree(_once(spark, sf_dir, "chain", lambda: Tree.from_adjacency(chain_rows(spark, sf_dir), CHAIN).df), CHAIN)


def conversations(spark: SparkSession, sf_dir: str) -> Tree:
    """Turns of a conversation, each below the one before."""

    def make() -> DataFrame:
        c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
        w = Window.partitionBy("conv_id").orderBy("turn")
        rows = c.select("conv_id", F.col("turn").alias("id"), F.lag("turn").over(w).alias("parent_id"), "role", F.char_length("text").cast("long").alias("length"))
        return Tree.from_adjacency(rows, CONV).df

    return Tree(_once(spark, sf_dir, "conversations", make), CONV)


def soft_heap(spark: SparkSession, sf_dir: str) -> Tree:
    """The heap with parts of size 1 to 10 soft-deleted."""
    t = heap(spark, sf_dir)
    stamp = F.lit("2024-01-02 03:04:05").cast("timestamp")
    return Tree(t.df.withColumn("deleted_at", F.when(F.col("size") <= 10, stamp)), SOFT)


def corrupt_heap(spark: SparkSession, sf_dir: str) -> Tree:
    """The stored heap with arithmetic damage of each kind that checks look for."""
    k = F.col("id")
    d = heap(spark, sf_dir).plain()
    lft, rgt = F.col("lft"), F.col("rgt")
    return Tree(d.withColumns({
        "lft": F.when(k % 97 == 5, rgt).when(k % 89 == 7, lft + 1).when(k % 83 == 9, F.lit(0)).otherwise(lft).cast("long"),
        "rgt": F.when(k % 97 == 5, lft).when(k % 79 == 11, rgt + 3).otherwise(rgt).cast("long"),
        "depth": F.when(k % 73 == 13, F.col("depth") + 1).otherwise(F.col("depth")).cast("int"),
        "parent_id": F.when(k % 71 == 17, k + 10_000_000).otherwise(F.col("parent_id")).cast("long"),
    }), HEAP)


def diff_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The heap, and the heap after leaves of key % 50 = 0 went, nodes of key % 31 = 0
    moved to the root, sizes of key % 7 = 0 changed and a few rows came."""
    before = heap(spark, sf_dir).plain()
    rows = heap_rows(spark, sf_dir)
    parents = rows.select(F.col("parent_id").alias("p")).distinct()
    k = F.col("id")
    leaf = rows.join(parents, k == F.col("p"), "left")
    kept = leaf.filter(~((k % 50 == 0) & F.col("p").isNull())).drop("p")
    changed = kept.withColumns({"parent_id": F.when((k % 31 == 0) & (k > 0), F.lit(0)).otherwise(F.col("parent_id")).cast("long"), "size": F.when(k % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).cast("int")})
    extra = rows.filter(k.between(1, 5)).withColumns({"id": k + 50_000_000, "parent_id": k})
    return before, _once(spark, sf_dir, "diff_after", lambda: Tree.from_adjacency(changed.unionByName(extra.select(*changed.columns)), HEAP).plain())


__all__ = ["chain", "conversations", "corrupt_heap", "diff_pair", "geo_paths", "heap", "soft_heap", "table"]
