"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Every version of every document is a blob, addressed by the SHA-256 of its text.
The ledger holds, for each blob, the rule versions that have scanned it and what
they found.  A scan takes the distinct blobs of its input, looks up which
(blob, rule version) pairs the ledger lacks, runs only those rules on only those
texts, appends the result to the ledger and joins findings back to all paths
(document ids) that hold the blob.  Copies of a text are dropped within each map
task before the shuffle, so that a text in a third of all rows moves once a task.

A rule's matches are leftmost and do not overlap; their places come from the
pieces between them: split and match-all use one engine, so that the lengths of
pieces and matches add up to positions in code points.  Running sums and cuts work
on blocks of ``BLOCK`` values and ``CUT`` code points, so that the work grows with the
length of a text and not with its square, however many spans it has.

Defined cases: a null text counts as the empty text, which holds no secret;
repeated rows get the same findings, one output row each; rows with a null id
are scanned like others; an empty table gives an empty table and an unchanged
ledger; further columns do not clash since only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table


@dataclass(frozen=True)
class Rule:
    """Pattern, the group whose length counts, and the least length of that group.
    ``hint`` is a cheaper pattern that every text with a match also matches."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds in their listed order, then what the method adds.
BASE_RULES = (
    Rule("assign", 1, "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, "(?i)(?:passw|secret|token|api_?key)"),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"),
    Rule("hosted_token", 1, "(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
)
RULES = BASE_RULES + MORE_RULES
#: Values that a running sum or maximum folds at once, and code points of a piece from
#: which spans are cut.
BLOCK, CUT = 128, 4096
SPAN = "struct<kind:string,version:int,start:bigint,stop:bigint>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _running(values: Column, fold) -> Column:
    """For each long of an array the fold of all before it (0 before the first).  An
    array that grows is copied at each step, so values are folded in blocks, and the
    folds of whole blocks in the same way."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))

    def walk(part: Column) -> Column:
        return F.aggregate(part, start, lambda s, x: F.struct(fold(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def joined(blocks: Column) -> Column:
        before = walk(F.transform(blocks, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(before, blocks, lambda a, b: F.transform(b["out"], lambda x: fold(a, x))))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: walk(F.slice(v, i * BLOCK + 1, F.lit(BLOCK))))

    return _bound(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(_bound(cut(v), joined)))


def _bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it inside ``body``."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, rule: Rule) -> Column:
    """Array of the rule's spans in a text, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)

    def length(x: Column) -> Column:
        return F.char_length(x).cast("bigint")

    # one row a match: how far it begins after the match before it, its length, whether it counts
    rows = F.zip_with(F.transform(F.arrays_zip(found.alias("f"), counted.alias("c")), lambda m: F.struct(length(m["f"]).alias("size"), (F.char_length(m["c"]) >= rule.least).alias("good"))), gaps, lambda m, gap: F.struct(length(gap).alias("gap"), m["size"].alias("size"), m["good"].alias("good")))

    def placed(m: Column) -> Column:
        before = _running(F.transform(m, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        made = F.zip_with(m, before, lambda x, at: F.struct(x["good"].alias("good"), F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("stop")).alias("span")))
        return F.transform(F.filter(made, lambda x: x["good"]), lambda x: x["span"])

    there = F.filter(rows, lambda x: x["size"].isNotNull())  # the last gap has no match after it
    return F.when(F.regexp_like(text, F.lit(rule.hint or rule.pattern)), _bound(there, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


class Ledger:
    """What has been scanned and found so far: Parquet below ``path``, append only."""

    SCHEMA = f"blob string, scanned array<string>, findings array<{SPAN}>"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All entries; none while the ledger is new."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def seen(self, rules: tuple[Rule, ...]) -> DataFrame:
        """Per blob: the wanted pairs that have been scanned."""
        wanted = F.array(*[F.lit(r.pair) for r in rules])
        pairs = self.rows().select("blob", F.explode(F.array_intersect("scanned", wanted)).alias("pair"))
        return pairs.groupBy("blob").agg(F.collect_set("pair").alias("seen"))

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """Per blob with a finding of these rules: the distinct spans."""
        wanted = F.lit(False)
        for r in rules:
            wanted = wanted | ((F.col("f.kind") == r.kind) & (F.col("f.version") == r.version))
        return self.rows().select("blob", F.explode("findings").alias("f")).filter(wanted).groupBy("blob").agg(F.collect_set("f").alias("findings"))

    def append(self, entries: DataFrame) -> None:
        entries.select("blob", "scanned", "findings").write.mode("append").option("compression", "zstd").parquet(self.path)


def unseen(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """Distinct blobs with the rule versions that they still need."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blobs = docs.select(blob_id(t).alias("blob"), t.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    none = F.array().cast("array<string>")
    wanted = F.array(*[F.lit(r.pair) for r in rules])
    missing = F.array_except(wanted, F.coalesce(F.col("seen"), none))
    return blobs.join(ledger.seen(rules), "blob", "left").withColumn("missing", missing).filter(F.size("missing") > 0).select("blob", "body", "missing")


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Bring the ledger up to date with the blobs of ``docs``."""
    todo = unseen(docs, ledger, rules, text)
    found = [F.when(F.array_contains("missing", r.pair), spans(F.col("body"), r)).otherwise(F.array().cast(f"array<{SPAN}>")) for r in rules]
    ledger.append(todo.select("blob", F.col("missing").alias("scanned"), F.concat(*found).alias("findings")))


def findings(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every path with its blob and its findings (an empty array if none)."""
    paths = docs.select(F.col(f"`{key}`").alias(key), blob_id(F.col(f"`{text}`")).alias("blob"))
    order = F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(i))])
    ranked = F.transform("findings", lambda f: F.struct(f["start"].alias("start"), order[f["kind"]].alias("rank"), f["stop"].alias("stop"), f["kind"].alias("kind")))
    return paths.join(ledger.findings(rules), "blob", "left").select(key, "blob", F.sort_array(F.coalesce(ranked, F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"))).alias("findings"))


def _joined(found: Column, kinds: tuple[str, ...]) -> Column:
    kept = F.filter(found, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")


def report(docs: DataFrame, ledger: Ledger, key: str = "doc_id", text: str = "text") -> DataFrame:
    scan(docs, ledger, RULES, text)
    f = F.col("findings")
    base = tuple(r.kind for r in BASE_RULES)
    counts = [_count(f, k).alias(f"n_{k}") for k in base]
    return findings(docs, ledger, RULES, key, text).select(key, *counts, F.sha2(_joined(f, base), 256).alias("base_sha256"), _joined(f, tuple(r.kind for r in RULES)).alias("spans"))


def covered(text: Column, found: Column, mark: str) -> Column:
    """``text`` with the spans of ``found`` (start, stop; sorted) replaced by ``mark``.
    The text is cut once into pieces of ``CUT`` code points, and what lies between two
    spans comes from the pieces that it touches."""

    def between(pieces: Column, lo: Column, hi: Column) -> Column:
        first, last = F.floor(lo / CUT).cast("int"), F.floor((hi - 1) / CUT).cast("int")
        part = F.transform(F.sequence(first, last), lambda i: F.substring(F.get(pieces, i), (F.greatest(lo - i * CUT, F.lit(0)) + 1).cast("int"), (F.least(hi - i * CUT, F.lit(CUT)) - F.greatest(lo - i * CUT, F.lit(0))).cast("int")))
        return F.when(hi > lo, F.array_join(part, "")).otherwise("")

    def cut(x: Column) -> Column:
        shown = F.filter(F.zip_with(x["spans"], x["reach"], lambda f, at: F.struct(f["start"].alias("start"), at.alias("at"))), lambda f: f["start"] >= f["at"])
        heads = F.transform(shown, lambda f: F.concat(between(x["pieces"], f["at"], f["start"]), F.lit(mark)))
        return F.concat(F.array_join(heads, ""), between(x["pieces"], F.array_max(F.transform(x["spans"], lambda f: f["stop"])), F.char_length(x["body"]).cast("bigint")))

    reach = _running(F.transform(found, lambda f: f["stop"]), F.greatest)
    whole = F.struct(text.alias("body"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("pieces"), found.alias("spans"), reach.alias("reach"))
    return _bound(whole, cut)


def redact(docs: DataFrame, ledger: Ledger, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans of
    several rules are covered together.  Other columns stay as they are."""
    scan(docs, ledger, RULES, text)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = docs.withColumn("__secret_blob", blob_id(F.col(f"`{text}`"))).withColumn("__secret_body", body)
    found = ledger.findings(RULES).select(F.col("blob").alias("__secret_key"), F.sort_array(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), f["stop"].alias("stop")))).alias("__secret_found"))
    joined = marked.join(found, F.col("__secret_blob") == F.col("__secret_key"), "left")
    clean = F.when(F.col("__secret_found").isNull(), F.col(f"`{text}`")).otherwise(covered(F.col("__secret_body"), F.col("__secret_found"), mark))
    return joined.withColumn(text, clean).select(*[f"`{c}`" for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), Ledger(spark, scratch_path(spark, "ledger")))
