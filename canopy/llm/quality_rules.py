"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a boolean expression that is true when a document is rejected.  On a
bounded sample the planner estimates what each rule costs and which rows it rejects.
Cost is counted in operations (``COSTS``: per code point, word or window of the
sample), not in seconds, so that the order is the same in every run.  Rules then run
in descending order of rejections per cost.  A row leaves the cascade at the first
rule that rejects it, and a measure is computed at most once, where a rule that reads
it is first reached.  The order decides the work, never the verdict: a document is
kept if no rule rejects it.

Defined cases: a null text counts as the empty text; empty and short texts fail
the word-count rule; repeated rows are judged alike, one output row each; an
empty table gives an empty table; further columns pass through ``apply_rules``
and measure columns are prefixed, so that they cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space between words: fixed values of the word pattern.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows of the sample on which costs and selectivities are estimated, and the files
#: that they are spread over.
SAMPLE_ROWS, SAMPLE_FILES = 400, 8


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it inside ``body``: an expression that a
    lambda merely mentions would be evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.char_length(_without(text, SPACES)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    return _bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice.

    Windows are compared by a 64-bit hash, made from the hashes of their halves.  Only a text in which
    some window repeats pays for sorting: runs of equal hashes in the sorted list
    give the positions, and neighbouring positions give the words they cover.
    """
    n = F.size(words)

    def covered(at: Column) -> Column:
        nxt = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.lit(2147483647)))
        return F.aggregate(F.zip_with(at, nxt, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
            following = F.concat(F.slice(s, F.lit(2), F.size(s) - 1), none)
            preceding = F.concat(none, F.slice(s, F.lit(1), F.size(s) - 1))
            same = F.zip_with(
                F.zip_with(s, following, lambda a, b: F.struct(a.alias("a"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("up"))),
                preceding,
                lambda x, b: F.when(x["up"] | F.coalesce(x["a"]["h"] == b["h"], F.lit(False)), x["a"]["i"]),
            )
            return F.array_sort(F.filter(same, lambda i: i.isNotNull()))

        return _bound(_bound(pairs, positions), covered)

    def judged(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(repeated(hashes))

    def doubled(h: Column, width: int) -> Column:
        """Hashes of runs of ``width`` words, from those of half the width."""
        runs = F.size(h) - width // 2
        return F.zip_with(F.slice(h, F.lit(1), runs), F.slice(h, F.lit(width // 2 + 1), runs), lambda a, b: F.xxhash64(a, b))

    def windows(h: Column, width: int) -> Column:
        return _bound(doubled(h, width), judged) if width == WINDOW else _bound(doubled(h, width), lambda x: windows(x, 2 * width))

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_bound(F.transform(words, lambda x: F.xxhash64(x)), lambda h: windows(h, 2)))


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the named measures (columns of ``MEASURES``) to a condition."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., Column]

    def on(self, values: dict[str, Column]) -> Column:
        return self.rejects(*[values[m] for m in self.measures])


#: Measures by name: how each is computed from the text and the word list.
MEASURES = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: word_chars(t),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
}

#: Operations of each measure for a text of ``c`` code points and ``w`` words.  Passes
#: over a text count its code points; work on words counts about what a word costs.
COSTS = {
    "n_words": lambda c, w: w,
    "word_chars": lambda c, w: 6 * c,
    "n_symbols": lambda c, w: 8 * c,
    "n_dup_lines": lambda c, w: 4 * c,
    "n_repeat_words": lambda c, w: 60 * w,
}

#: Production rules; thresholds are on whole numbers so that every engine agrees.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: r * 100 > n * 30),
)
EXTRA_RULES = (
    Rule("symbols_for_words", ("n_symbols", "word_chars"), lambda s, c: s * 100 > c * 20),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > n * 25),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < n * 2),
    Rule("repeated_lines", ("n_dup_lines", "n_words"), lambda d, n: d * 10 > n),
)
RULES = BASE_RULES + EXTRA_RULES
PREFIX = "__rule_"


def _sample(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """At most ``rows`` texts, taken from the heads of files spread over the input; of
    an input that is not files, the first."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")
    files = docs.inputFiles()
    if len(files) < 2:
        return docs.select(t).limit(rows)
    step = -(-len(files) // SAMPLE_FILES)
    chosen = sorted(files)[step // 2 :: step]
    names = [f.rpartition("/")[2] for f in chosen]
    if len(set(f.rpartition("/")[2] for f in files)) < len(files) or "_metadata" in docs.columns:
        return docs.select(t).limit(rows)
    parts = [docs.filter(F.col("_metadata.file_name") == n).select(t).limit(max(1, rows // len(names))) for n in names]
    return reduce(DataFrame.union, parts)


def plan_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with their estimated operations a text and rejected share, best first.

    The sample bounds only this estimate, and is summed up where it lies: one row is
    collected.  Ties keep the declared order; rules that reject nothing go by cost.
    """
    t, w = F.col("t"), F.col("w")
    values = {m: F.col(m) for m in MEASURES}
    sample = _sample(docs, text, sample_rows).withColumn("w", words_of(t))
    counted = sample.select(F.char_length(t).alias("c"), F.size(w).alias("w"), *[f(t, w).alias(m) for m, f in MEASURES.items()])
    hits = [F.coalesce(F.avg(F.coalesce(r.on(values), F.lit(False)).cast("double")), F.lit(0.0)).alias(f"r{i}") for i, r in enumerate(rules)]
    mean = counted.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("c"), F.coalesce(F.avg("w"), F.lit(0.0)).alias("w"), *hits).first()
    out = [(r, 1 + sum(COSTS[m](mean["c"], mean["w"]) for m in r.measures), mean[f"r{i}"]) for i, r in enumerate(rules)]
    return sorted(out, key=lambda x: (-x[2] / x[1], x[1]))


def first_rejection(order: tuple[Rule, ...], values: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, null when none does; CASE stops there."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in order:
        out = out.when(rule.on(values), F.lit(rule.name))
    return out


def _rejected_by(order: tuple[Rule, ...], text: Column, words: Column) -> Column:
    """The cascade over a text: a measure is computed where a rule is first reached
    that reads it, and bound for the rules after it."""

    def step(rest: tuple[Rule, ...], have: dict[str, Column], w: Column) -> Column:
        if not rest:
            return F.lit(None).cast("string")
        rule = rest[0]
        new = [m for m in rule.measures if m not in have]
        if new:
            return _bound(MEASURES[new[0]](text, w), lambda v: step(rest, {**have, new[0]: v}, w))
        return F.when(rule.on(have), F.lit(rule.name)).otherwise(step(rest[1:], have, w))

    return _bound(words, lambda w: step(order, {}, w))


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with every measure as a prefixed column, and those columns."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    with_words = docs.select(*cols, t.alias(PREFIX + "text"), words_of(t).alias(PREFIX + "words"))
    values = {m: f(F.col(PREFIX + "text"), F.col(PREFIX + "words")).alias(PREFIX + m) for m, f in MEASURES.items()}
    return with_words.select(*cols, *values.values()), {m: F.col(PREFIX + m) for m in MEASURES}


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents that no rule rejects, with the columns they came with."""
    order = tuple(r for r, _, _ in plan_order(docs, text, rules))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.filter(_rejected_by(order, t, words_of(t)).isNull())


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its measures, whether a base rule failed, and the verdict."""
    order = [r for r, _, _ in plan_order(docs.select(text), text)]
    rows, m = measured(docs.select(key, text), text)
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.on(m)
    return rows.select(
        F.col(key), *[m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), first_rejection(tuple(order), m).isNull().alias("kept"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
