"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

score(x) = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])

The sum-of-squares identity makes the pairwise part linear in the number of
non-zero features.  Words hash into ``BUCKETS``; structure statistics are
numbers of the text itself; the metadata is the stored character count.  Labels,
language, source and document id are never inputs.

Training uses at most ``TRAIN_ROWS`` labelled rows, the smallest by a hash of
their id, so the sample is the same for every layout of the input; scoring covers
every row and whole texts.

Defined cases: a null text scores as the empty text; a null or missing
character count counts as the length of the text; repeated rows score alike;
with no usable label, or labels of one class only, every score is the share of
label 1 (0.5 without any); an empty table gives an empty table; documents with
several labels count once for each, and of documents that repeat an id one text
(the smallest by a hash) is trained on; rows with a null label are not used.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table

BUCKETS = 1 << 14
RANK = 6
#: The bound of the labelled sample on which the model is fitted.
TRAIN_ROWS = 6000
EPOCHS = 12
BATCH = 256
L2 = 1e-4
SEED = 20
THRESHOLD = 0.7
#: Folds by crc32 of the id as text: rows of this remainder are never trained on.
FOLDS, HELD_OUT = 4, 2
N_STATS = 20
_CACHE_WORDS = 300_000


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % FOLDS == HELD_OUT


def _stats(text: str, words: list[str], counts: Counter, n_chars: int) -> list[float]:
    n, chars = len(words), max(len(text), 1)
    nw = max(n, 1)
    letters = sum(map(len, words))
    upper = sum(1 for w in counts if len(w) > 1 and w.isupper())
    lines = text.split("\n")
    repeats = sum(map(str.__eq__, words, words[1:]))
    marks = {c: text.count(c) for c in ".,!?|#$%&*<>"}
    symbols = sum(marks[c] for c in "#$%&*<>|")
    return [
        1.0,
        math.log1p(n) / 8,
        math.log1p(n_chars) / 10,
        letters / nw / 12,
        len(counts) / nw,
        max(counts.values(), default=0) / nw,
        repeats / nw,
        upper / max(len(counts), 1),
        marks["!"] / nw,
        marks["|"] / nw,
        (symbols - marks["|"]) / nw,
        marks["."] / nw,
        marks[","] / nw,
        marks["?"] / nw,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        math.log1p(chars / len(lines)) / 8,
        sum(1 for w in counts if w.isdigit()) / max(len(counts), 1),
        float(n < 20),
        float(bool(symbols)),
        letters / chars,
    ]


def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().strip(".,!?;:").encode()) % BUCKETS + N_STATS


class _Buckets(dict):
    """Bucket of each word seen so far; emptied when it grows past its bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        self[word] = out = _bucket(word)
        return out


def features(text: str | None, n_chars: int | None, buckets: dict) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices and values of one whole text; word weights have unit norm."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = _stats(text, words, counts, len(text) if n_chars is None else max(int(n_chars), 0))
    idx = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
    val = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    norm = math.sqrt(float(val @ val)) or 1.0
    return np.concatenate([np.arange(N_STATS), idx]), np.concatenate([stats, val / norm])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.factors[idx] * val[:, None]
        pair = 0.5 * float((vx.sum(0) ** 2 - (vx * vx).sum(0)).sum())
        return self.bias + float(self.linear[idx] @ val) + pair


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Mini-batch AdaGrad on the logistic loss; deterministic for given rows."""
    size = N_STATS + BUCKETS
    rng = np.random.default_rng(SEED)
    factors = rng.normal(0, 0.02, (size, RANK))
    linear = np.zeros(size)
    y_all = np.array([r[2] for r in rows], dtype=float)
    share = float(y_all.mean()) if len(rows) else 0.5
    if not len(rows) or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(math.log(p / (1 - p)), linear, np.zeros_like(factors))
    bias = math.log(share / (1 - share))
    g_lin, g_fac, g_bias, rate = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6, 0.15
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            idx, val = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            start = np.concatenate([[0], np.cumsum([len(r[0]) for r in part])[:-1]])
            of = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            vx = factors[idx] * val[:, None]
            total = np.add.reduceat(vx, start, axis=0)
            pair = 0.5 * (total**2 - np.add.reduceat(vx * vx, start, axis=0)).sum(1)
            margin = bias + np.add.reduceat(linear[idx] * val, start) + pair
            err = (sigmoid(margin) - np.array([r[2] for r in part])) / len(part)
            e = err[of]
            used, inv = np.unique(idx, return_inverse=True)
            d_lin = np.bincount(inv, e * val, len(used)) + L2 * linear[used]
            d_each = (e * val)[:, None] * (total[of] - vx)
            d_fac = np.stack([np.bincount(inv, d_each[:, f], len(used)) for f in range(RANK)], 1) + L2 * factors[used]
            g_lin[used] += d_lin**2
            g_fac[used] += d_fac**2
            g_bias += err.sum() ** 2
            linear[used] -= rate * d_lin / np.sqrt(g_lin[used])
            factors[used] -= 0.3 * rate * d_fac / np.sqrt(g_fac[used])
            bias -= rate * err.sum() / math.sqrt(g_bias)
    return Model(bias, linear, factors)


def _training_ids(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """The bounded sample: ids and labels only, smallest by a hash of the id."""
    usable = labels.select(F.col(key), F.col(label).cast("int").alias("__label")).filter(F.col(key).isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col(key)))
    return usable.orderBy(F.xxhash64(key), key, "__label").limit(rows)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", chars: str = "n_chars", rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled sample.  Only ids and labels, at most ``rows`` of them,
    are broadcast to find its texts; features are made on the executors, and those
    of at most ``rows`` texts are collected."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame(_training_ids(labels, key, label, rows).collect(), f"`{key}` {labels.schema[key].dataType.simpleString()}, __label int")
    n_chars = F.col(chars).cast("long") if chars in docs.columns else F.lit(None).cast("long")
    sample = docs.select(key, F.col(text).alias("text"), n_chars.alias("n_chars")).join(F.broadcast(wanted), key).select(F.col(key).cast("string").alias("k"), "text", "n_chars", "__label")

    # one text for each id and label, however often documents repeat an id
    one = F.min_by(F.struct("text", "n_chars"), F.xxhash64("text", "n_chars"))
    sample = sample.groupBy("k", "__label").agg(one.alias("x")).select("k", "x.text", "x.n_chars", "__label")

    def run(batches):
        buckets = _Buckets()
        for b in batches:
            t, c = b.column("text").to_pylist(), b.column("n_chars").to_pylist()
            made = [features(x, n, buckets) for x, n in zip(t, c)]
            yield pa.RecordBatch.from_pydict({"k": b.column("k"), "label": b.column("__label").cast(pa.int32()), "idx": [i.astype("<i4").tobytes() for i, _ in made], "val": [v.astype("<f4").tobytes() for _, v in made]})

    got = map_arrow(sample, run, "k string, label int, idx binary, val binary").collect()
    got = sorted(got, key=lambda r: (zlib.crc32(r["k"].encode()), r["k"], r["label"], bytes(r["idx"])))
    return fit([(np.frombuffer(r["idx"], "<i4").astype(np.int64), np.frombuffer(r["val"], "<f4").astype(float), r["label"]) for r in got])


def score(docs: DataFrame, model: Model, text: str = "text", chars: str = "n_chars", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with a score from 0 to 1 in column ``out`` (an older column of that
    name is replaced); the text stays only where ``keep_text`` is set."""
    passed = [c for c in docs.columns if c != out and (keep_text or c != text)]
    n_chars = F.col(f"`{chars}`").cast("long") if chars in docs.columns else F.lit(None).cast("long")
    rows = docs.select(*[f"`{c}`" for c in passed], *([] if keep_text else [F.col(f"`{text}`")]), n_chars.alias("__fm_chars"))
    bias, linear, factors = model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)

    def run(batches):
        m = Model(bias, linear.astype(float), factors.astype(float))
        buckets = _Buckets()
        for b in batches:
            made = [features(x, n, buckets) for x, n in zip(b.column(text).to_pylist(), b.column("__fm_chars").to_pylist())]
            s = sigmoid(np.array([m.margin(i, v) for i, v in made], dtype=float))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in passed], pa.array(s, pa.float64())], names=[*passed, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in passed)
    return map_arrow(rows, run, f"{schema + ', ' if schema else ''}`{out}` double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, whether it was held out, score and predicted class."""
    model = train(docs, labels, key, text)
    slim = docs.select(key, text, *(["n_chars"] if "n_chars" in docs.columns else []))
    scored = score(slim, model, text)
    return scored.select(F.col(key), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that the classifier accepts, with all their columns."""
    model = train(docs, labels, key, text)
    scored = score(docs, model, text, out="__fm_score", keep_text=True)
    return scored.filter(F.col("__fm_score") >= THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
