"""What a tree table looks like, and what can be rolled up over it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ConfigurationError


def col(name: str) -> Column:
    """A column by its literal name: reserved words and dots are ordinary."""
    return F.col(f"`{name.replace('`', '``')}`")


@dataclass(frozen=True)
class TreeSpec:
    """Names of the structural columns.  ``scope`` columns split the table into
    independent trees, compared null-safely; ``deleted`` marks soft-deleted rows."""

    id: str = "id"
    parent: str = "parent_id"
    lft: str = "lft"
    rgt: str = "rgt"
    depth: str = "depth"
    scope: tuple[str, ...] = ()
    deleted: str | None = None

    @property
    def structure(self) -> tuple[str, ...]:
        return (self.parent, self.lft, self.rgt, self.depth)


def scope_key(spec: TreeSpec) -> Column:
    """One value for all scope columns; nulls equal nulls and nothing else."""
    if not spec.scope:
        return F.lit("")
    return F.to_json(F.struct(*[col(c).alias(f"s{i}") for i, c in enumerate(spec.scope)]), {"ignoreNullFields": "false"})


class NodeKey(NamedTuple):
    """A node by its id and the values of the scope columns.  Wherever a key is taken, a
    bare id will do if no other scope holds it."""

    id: object
    scope: tuple = ()


class NodeBounds(NamedTuple):
    lft: int
    rgt: int
    depth: int

    @property
    def height(self) -> int:
        return self.rgt - self.lft + 1

    def contains(self, other: NodeBounds) -> bool:
        return self.lft < other.lft and other.rgt < self.rgt

    def depth_delta(self, other: NodeBounds) -> int:
        return other.depth - self.depth


@dataclass(frozen=True)
class Filter:
    """Rows that an aggregate looks at: equalities, a column that is not null, or SQL."""

    equals: tuple[tuple[str, object], ...] = ()
    not_null: str | None = None
    raw: str | None = None

    @staticmethod
    def of(equals: Mapping[str, object]) -> Filter:
        if not equals:
            raise ConfigurationError("an equality filter needs at least one column")
        for v in equals.values():
            if isinstance(v, (list, tuple, dict, set)):
                raise ConfigurationError("an equality filter compares with scalars")
        return Filter(equals=tuple(equals.items()))

    def condition(self) -> Column:
        if self.raw is not None:
            return F.coalesce(F.expr(self.raw), F.lit(False))
        if self.not_null is not None:
            return col(self.not_null).isNotNull()
        out = F.lit(True)
        for name, value in self.equals:
            out = out & (col(name).isNull() if value is None else F.coalesce(col(name) == F.lit(value), F.lit(False)))
        return out


#: Kinds whose value over no rows is zero; all others give null.
ZERO_WHEN_EMPTY = ("sum", "count", "distinct_count")
#: Kinds that a difference of two running sums gives.
INVERTIBLE = ("sum", "count", "avg", "variance", "stddev", "weighted_avg", "bool_or", "bool_and", "geometric_mean", "harmonic_mean")
#: Kinds that can be folded from any split of the rows.
MERGEABLE = ("min", "max", "bit_or", "bit_and", "bit_xor")
_LISTENER = ("sum", "count", "min", "max", "avg", "variance", "stddev", "geometric_mean", "harmonic_mean")
_NOT_LAZY = ("avg", "variance", "stddev", "weighted_avg", "bool_or", "bool_and", "geometric_mean", "harmonic_mean", "median", "percentile")


@dataclass(frozen=True)
class Agg:
    """One roll-up.  Build it with the class methods and refine it with the others."""

    kind: str
    source: str | None = None
    name: str | None = None
    inclusive: bool = True
    where: Filter | None = None
    sample: bool = False
    separator: str = ", "
    limit: int | None = None
    order_by: str | None = None
    unique: bool = False
    weight: str | None = None
    key: str | None = None
    allow_null_keys: bool = False
    fields: tuple[tuple[str, str], ...] = ()
    point: float | None = None
    k: int | None = None
    by: str | None = None
    lazy: bool = False
    ttl: int | None = None
    allow_non_positive: bool = False
    contribution: Column | None = field(default=None, compare=False)

    @classmethod
    def sum(cls, source: str) -> Agg:
        return cls("sum", source)

    @classmethod
    def count(cls, source: str | None = None) -> Agg:
        return cls("count", source)

    @classmethod
    def avg(cls, source: str) -> Agg:
        return cls("avg", source)

    @classmethod
    def min(cls, source: str) -> Agg:
        return cls("min", source)

    @classmethod
    def max(cls, source: str) -> Agg:
        return cls("max", source)

    @classmethod
    def variance(cls, source: str, sample: bool = False) -> Agg:
        return cls("variance", source, sample=sample)

    @classmethod
    def stddev(cls, source: str, sample: bool = False) -> Agg:
        return cls("stddev", source, sample=sample)

    @classmethod
    def weighted_avg(cls, source: str, weight: str) -> Agg:
        return cls("weighted_avg", source, weight=weight)

    @classmethod
    def bool_or(cls, source: str) -> Agg:
        return cls("bool_or", source)

    @classmethod
    def bool_and(cls, source: str) -> Agg:
        return cls("bool_and", source)

    @classmethod
    def geometric_mean(cls, source: str) -> Agg:
        return cls("geometric_mean", source)

    @classmethod
    def harmonic_mean(cls, source: str) -> Agg:
        return cls("harmonic_mean", source)

    @classmethod
    def bit_or(cls, source: str) -> Agg:
        return cls("bit_or", source)

    @classmethod
    def bit_and(cls, source: str) -> Agg:
        return cls("bit_and", source)

    @classmethod
    def bit_xor(cls, source: str) -> Agg:
        return cls("bit_xor", source)

    @classmethod
    def distinct_count(cls, source: str) -> Agg:
        return cls("distinct_count", source)

    @classmethod
    def string_agg(cls, source: str, separator: str = ", ", limit: int | None = None, order_by: str | None = None) -> Agg:
        return cls("string_agg", source, separator=separator, limit=_positive(limit), order_by=order_by)

    @classmethod
    def json_agg(cls, source: str | list[str] | Mapping[str, str], limit: int | None = None, order_by: str | None = None) -> Agg:
        if isinstance(source, str):
            return cls("json_agg", source, limit=_positive(limit), order_by=order_by)
        pairs = tuple(source.items()) if isinstance(source, Mapping) else tuple((s, s) for s in source)
        if not pairs:
            raise ConfigurationError("a JSON aggregate needs at least one column")
        return cls("json_agg", None, fields=pairs, limit=_positive(limit), order_by=order_by)

    @classmethod
    def json_object_agg(cls, key: str, value: str, limit: int | None = None, order_by: str | None = None, allow_null_keys: bool = False) -> Agg:
        return cls("json_object_agg", value, key=key, limit=_positive(limit), order_by=order_by, allow_null_keys=allow_null_keys)

    @classmethod
    def median(cls, source: str) -> Agg:
        return cls("median", source, point=0.5)

    @classmethod
    def percentile(cls, source: str, point: float) -> Agg:
        if not 0 <= point <= 1:
            raise ConfigurationError("a percentile lies between 0 and 1")
        return cls("percentile", source, point=point)

    @classmethod
    def percentiles(cls, source: str, points: Mapping[str, float]) -> list[Agg]:
        return [cls.percentile(source, p).into(name) for name, p in points.items()]

    @classmethod
    def quartiles(cls, source: str, prefix: str) -> list[Agg]:
        return cls.percentiles(source, {f"{prefix}_q1": 0.25, f"{prefix}_q2": 0.5, f"{prefix}_q3": 0.75})

    @classmethod
    def top_k(cls, source: str, k: int, by: str | None = None) -> Agg:
        if k < 1:
            raise ConfigurationError("top-k needs k of at least 1")
        return cls("top_k", source, k=k, by=by or source)

    @classmethod
    def listener(cls, kind: str, contribution: Column) -> Agg:
        """A roll-up of any expression of a row; rows where it is null are skipped."""
        if kind not in _LISTENER:
            raise ConfigurationError(f"{kind} cannot roll up an expression")
        return cls(kind, None, contribution=contribution)

    def exclusive(self) -> Agg:
        return replace(self, inclusive=False)

    def including_self(self) -> Agg:
        return replace(self, inclusive=True)

    def filter(self, equals: Mapping[str, object]) -> Agg:
        return replace(self, where=Filter.of(equals))

    def filter_not_null(self, name: str) -> Agg:
        return replace(self, where=Filter(not_null=name))

    def filter_raw(self, sql: str) -> Agg:
        if self.contribution is not None:
            raise ConfigurationError("an expression roll-up takes equality and not-null filters")
        return replace(self, where=Filter(raw=sql))

    def distinct(self) -> Agg:
        if self.kind != "string_agg" or self.order_by not in (None, self.source):
            raise ConfigurationError("only a string aggregate in the order of its source can be distinct")
        return replace(self, unique=True)

    def non_positive(self) -> Agg:
        return replace(self, allow_non_positive=True)

    def as_lazy(self, ttl: int | None = None) -> Agg:
        if self.kind in _NOT_LAZY:
            raise ConfigurationError(f"{self.kind} cannot be lazy")
        return replace(self, lazy=True, ttl=ttl)

    def into(self, name: str) -> Agg:
        return replace(self, name=name)

    @property
    def alias(self) -> str:
        if not self.name:
            raise ConfigurationError("an aggregate needs a name: use into()")
        return self.name


def _positive(limit: int | None) -> int | None:
    if limit is not None and limit < 1:
        raise ConfigurationError("a limit is at least 1")
    return limit
