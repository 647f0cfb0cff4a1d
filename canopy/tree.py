"""A tree table with its spec: one object from which all operators are reached."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import incremental, integrity, mutate, paths, predicates, relations, walk
from .operators.rollup import NODE, SCOPE, by_interval, rollup
from .plans.build import ANC, REACHED, build, scope_key
from .spec import Agg, NodeBounds, TreeSpec, col


@dataclass(frozen=True)
class Tree:
    """Immutable: changes return a new tree, nothing runs before an action."""

    df: DataFrame
    spec: TreeSpec = TreeSpec()

    @classmethod
    def from_adjacency(cls, df: DataFrame, spec: TreeSpec = TreeSpec(), order_by: list[str] | None = None) -> Tree:
        """Number a table that has ids and parents."""
        return cls(build(df, spec, order_by), spec)

    def _new(self, df: DataFrame) -> Tree:
        return Tree(df, self.spec)

    def plain(self) -> DataFrame:
        """The rows without derived helper columns."""
        return self.df.drop(ANC, REACHED)

    def node(self, key) -> dict:
        return mutate.node(self.df, self.spec, key)

    def bounds(self, key) -> NodeBounds:
        return mutate.bounds_of(self.node(key), self.spec)

    def where(self, name: str, *args) -> DataFrame:
        """Rows for which a predicate of ``operators.predicates`` holds; an anchor is
        given by its key, and its scope is respected."""
        make = getattr(predicates, name)
        if not args:
            return self.df.filter(make(self.spec))
        row = self.node(args[0])
        return self.df.filter(predicates.same_scope(self.spec, mutate.scope_of(row, self.spec)) & make(self.spec, mutate.bounds_of(row, self.spec)))

    def relation(self, name: str, *args, **kw):
        return getattr(relations, name)(self.df, self.spec, *args, **kw)

    def walk(self, name: str, *args, **kw):
        return getattr(walk, name)(self.df, self.spec, *args, **kw)

    def change(self, name: str, *args, **kw) -> Tree:
        out = getattr(mutate, name)(self.df, self.spec, *args, **kw)
        return self._new(out[0] if isinstance(out, tuple) else out)

    def check(self, name: str, *args, **kw):
        return getattr(integrity, name)(self.df, self.spec, *args, **kw)

    def maintain(self, name: str, *args, **kw) -> Tree:
        return self._new(getattr(incremental, name)(self.df, self.spec, *args, **kw))

    def path(self, path: paths.PathSpec) -> Tree:
        return self._new(paths.assemble(self.df, self.spec, path))

    def rollup(self, *aggs: Agg, only: DataFrame | None = None, strategy: str = "auto", with_trashed: bool = False) -> DataFrame:
        """Node ids (with their scope) and a column for each aggregate."""
        return rollup(self.df, self.spec, list(aggs), only, strategy, with_trashed)

    def with_fresh(self, *aggs: Agg, **kw) -> DataFrame:
        """All rows with fresh aggregates beside their own columns."""
        r = self.rollup(*aggs, **kw)
        j = self.df.withColumn("__k", scope_key(self.spec)).join(r, (F.col("__k") == F.col(SCOPE)) & (col(self.spec.id) == F.col(NODE)), "left")
        return j.drop("__k", SCOPE, NODE)

    def fresh(self, key, agg: Agg, with_trashed: bool = False):
        """One node's fresh aggregate: a filter by its bounds, no roll-up of others."""
        one = self.df.filter(mutate.has_key(self.spec, key))
        inner = mutate.subtree(self.df, self.spec, key)
        row = by_interval(inner, self.spec, [agg], one, with_trashed).first()
        return row[agg.alias] if row else None

    def with_depth(self, name: str) -> DataFrame:
        return self.df.withColumn(name, col(self.spec.depth))

    def ordered(self, strategy: str = "pre") -> DataFrame:
        return walk.ordered(self.df, self.spec, strategy)

    def root(self) -> dict | None:
        rows = walk.ordered(self.df.filter(predicates.is_root(self.spec)), self.spec).limit(1).collect()
        return rows[0].asDict() if rows else None

    def filter(self, condition: Column) -> DataFrame:
        return self.df.filter(condition)


__all__ = ["Tree"]
