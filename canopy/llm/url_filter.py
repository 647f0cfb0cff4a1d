"""URL filters: pattern rules behind an index of literal tokens, in DataFrame
expressions only.

Every rule names literal tokens that a URL it fits must hold.  The index keeps a
rule under the rarest of them, by counts over all URLs of the input.  The tokens
of a URL fetch candidate rules, and only candidates run their regular
expressions, on a row of its own and without a shuffle.

List rules have a host and a path: the rule fits its host and all subdomains where
the URL's path starts with the rule's; the longest host and path wins.  Where no
list rule fits, pattern rules decide: a URL that one of them fits is blocked,
others are allowed.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
is allowed with no rule; an empty URL is such a URL; repeated rows get equal
verdicts; ties between list rules of one length go to the later one in the order
of their text; an empty table gives an empty table; further columns do not clash
since only id and URL are read.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN_BREAK = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host and path; ``tokens`` are whole tokens of any match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False


def list_rule(verdict: str, rule: str) -> Rule:
    """A rule from its text, host and path, such as ``example.com/en/``."""
    host, slash, rest = rule.partition("/")
    if not slash or not host:
        raise ValueError(f"a list rule is a host and a path: {rule!r}")
    host = host.lower()
    whole = f"{host}/{rest.rpartition('/')[0]}"  # what follows the last slash may go on in the URL
    tokens = tuple(t for t in re.split(TOKEN_BREAK, whole) if t)
    if whole != whole.lower():
        tokens = tuple(t for t in re.split(TOKEN_BREAK, host) if t)
    return Rule(rule, verdict, f"^(?:[^/]*\\.)?{_quoted(host)}/{_quoted(rest)}", tokens, True)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


#: The list rules in their given order.
LIST_RULES = tuple(list_rule(v, r) for v, r in (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
))
#: What the method adds: hosts whose labels mark spam or adult pages.
PATTERN_RULES = (
    Rule("spam-farm", "block", "^(?:[^/]*\\.)?spam-farm\\.", ("spam", "farm")),
    Rule("adult-host", "block", "^(?:[^/]*\\.)?adult-[a-z0-9]+\\.", ("adult",)),
    Rule("casino-host", "block", "^(?:[^/]*[.-])?casino[.-]", ("casino",)),
)
RULES = LIST_RULES + PATTERN_RULES


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host_and_path: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(host_and_path), TOKEN_BREAK))


def token_counts(subjects: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """URLs that hold each literal token of the rules, over all rows; the result
    has at most as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    rows = subjects.select(F.explode(F.array_intersect(tokens_of(F.col("subject")), F.array(*[F.lit(t) for t in wanted]))).alias("t")).groupBy("t").count().collect() if wanted else []
    return {t: 0 for t in wanted} | {r["t"]: r["count"] for r in rows}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rarest token -> rules kept under it; a rule without a token is always a
    candidate and goes under the empty string."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    return index


def candidates(subject: Column, index: dict[str, list[int]]) -> Column:
    """Rules that the tokens of a URL fetch, as an array of their numbers."""
    always = F.array(*[F.lit(i) for i in index.get("", [])]).cast("array<int>")
    keyed = {t: r for t, r in index.items() if t}
    if not keyed:
        return always
    table_ = F.create_map(*[x for t, r in keyed.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in r]))])
    none = F.array().cast("array<int>")
    return F.concat(always, F.flatten(F.transform(tokens_of(subject), lambda t: F.coalesce(F.try_element_at(table_, t), none))))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: key, host, path, rule (a list rule or null), verdict."""
    u = F.col(f"`{url}`")
    parts = pages.select(F.col(f"`{key}`").alias(key), host_of(u).alias("host"), path_of(u).alias("path"))
    parts = parts.withColumn("subject", F.concat("host", "path"))
    index = build_index(rules, token_counts(parts, rules))
    ranked = sorted(range(len(rules)), key=lambda i: (rules[i].listed, len(rules[i].name) if rules[i].listed else -i, rules[i].name))
    rank = F.array(*[F.lit(ranked.index(i)) for i in range(len(rules))])
    pattern = F.array(*[F.lit(r.pattern) for r in rules])
    fitting = F.filter(candidates(F.col("subject"), index), lambda i: F.regexp_like(F.col("subject"), F.get(pattern, i)))
    best = F.array_max(F.transform(fitting, lambda i: F.get(rank, i)))
    by_rank = [rules[i] for i in ranked]
    name = F.get(F.array(*[F.lit(r.name if r.listed else None).cast("string") for r in by_rank]), F.col("best"))
    verdict = F.coalesce(F.get(F.array(*[F.lit(r.verdict) for r in by_rank]), F.col("best")), F.lit("allow"))
    return parts.withColumn("best", best).select(key, "host", "path", name.alias("rule"), verdict.alias("verdict"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
