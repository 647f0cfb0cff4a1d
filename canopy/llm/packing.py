"""Packing of documents into token windows by best-fit decreasing.

Overlong documents are first cut into full windows.  Best-fit decreasing looks
only at lengths, and there are at most ``WINDOW`` different ones, so the driver
packs the histogram: pieces of one length go in runs, a segment tree indexed by
remaining capacity names the tightest open window, and all windows of that
capacity are filled at once.  The result equals packing piece by piece.  A flow
says where a run of equal pieces goes; there are at most 90 flows for each of at
most 4 * ``WINDOW`` runs of windows (a window can take at most 90 different
lengths: 1 + ... + 90 <= 4096 < 1 + ... + 91), whatever the input.

Executors rank the pieces by (length descending, key, start) with a range
partitioning, which spreads a length that a third of all pieces share, and look
up window and offset of each rank in the flows.  Token ids stay in the table of
pieces; only narrow rows are shuffled.

Defined cases: a null text counts as the empty text, whose only id is the end id;
repeated rows are packed as separate documents; rows with a null key are packed
too; an empty table gives no windows; only key and text are read, so further
columns do not clash.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, once, table
from .word_tokens import WordEncoder

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most ``window`` tokens: key, start, length,
    doc_tokens and ids (little-endian unsigned 32-bit)."""

    def run(batches):
        encoder, end = once(("words", path), lambda: WordEncoder(path)), np.array([end_id], "<u4").tobytes()
        for b in batches:
            take, start, length, total, ids = [], [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                raw = encoder.encode(t) + end
                n = len(raw) // 4
                for at in range(0, n, window):
                    part = raw[4 * at : 4 * (at + window)]
                    take.append(row)
                    start.append(at)
                    length.append(len(part) // 4)
                    total.append(n)
                    ids.append(part)
            keys = b.column(0).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=[key, "start", "length", "doc_tokens", "ids"])

    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    return map_arrow(rows, run, f"`{key}` {kind}, start long, length long, doc_tokens long, ids binary")


class CapacityTree:
    """Segment tree over capacities: the smallest one in use that is large enough."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.used = bytearray(2 * self.size)

    def mark(self, capacity: int, used: bool) -> None:
        at = capacity + self.size
        self.used[at] = used
        while at > 1:
            at >>= 1
            self.used[at] = self.used[2 * at] | self.used[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.used[at]:
            return least
        while at > 1:
            if not at & 1 and self.used[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Flows of best-fit decreasing, in order of rank.

    Columns: first rank, first window, pieces for each window, offset of the first
    piece, length.  Piece ``first + i`` goes to window ``first window + i // per``
    at ``offset + (i % per) * length``.
    """
    tree, open_ = CapacityTree(window), [deque() for _ in range(window + 1)]
    flows, rank, windows = [], 0, 0

    def put(capacity: int, first: int, count: int) -> None:
        if capacity and count:
            open_[capacity].append((first, count))
            tree.mark(capacity, True)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, count = window, windows, -(-left // (window // length))
                windows += count
            else:
                first, count = open_[capacity].popleft()
            per = capacity // length
            full = min(count, left // per)
            last = left - full * per if full < count and left - full * per < per else 0
            flows.append((rank, first, per, window - capacity, length))
            put(capacity - per * length, first, full)
            if last:
                put(capacity - last * length, first + full, 1)
            rest = count - full - (1 if last else 0)
            if rest:
                open_[capacity].appendleft((first + full + (1 if last else 0), rest))
            if capacity < window or rest:
                tree.mark(capacity, bool(open_[capacity]))
            rank += full * per + last
            left -= full * per + last
    return np.array(flows, dtype=np.int64).reshape(-1, 5)


def assign(rows: DataFrame, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``rows`` (narrow columns with key, start, length and a unique ``piece``) with
    sequence_id and offset."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(F.desc("length"), F.col(key), F.col("start"), F.col("piece")).sortWithinPartitions(F.desc("length"), key, "start", "piece")
    ranged = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, index = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each partition
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    flows = plan(histogram, window)
    at_part, at_rank = np.array([p for p, _ in offsets], np.int64), np.array([o for _, o in offsets], np.int64)
    names = [c for c in ranged.columns if c != "__at"]

    def run(batches):
        for b in batches:
            rank = at_rank[np.searchsorted(at_part, b.column("__part").to_numpy())] + b.column("__index").to_numpy()
            f = flows[np.searchsorted(flows[:, 0], rank, side="right") - 1] if len(rank) else flows[:0]
            i = rank - f[:, 0]
            per = np.maximum(f[:, 2], 1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(f[:, 1] + i // per), pa.array(f[:, 3] + i % per * f[:, 4])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema if f.name in names)
    return map_arrow(ranged.select(*names, part.alias("__part"), index.alias("__index")), run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The table of pieces with their ids, and the place of each piece."""
    table_of_pieces = materialise(pieces(docs, path, key, text, window).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    narrow = table_of_pieces.select("piece", key, "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    return table_of_pieces, assign(narrow, key, window)


def windows(table_of_pieces: DataFrame, places: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Filled windows: sequence_id, n_tokens, and ids padded to ``window``.  A window
    is bounded, so its pieces are gathered as one group."""
    joined = table_of_pieces.select("piece", "ids").join(places.select("piece", "sequence_id", "offset"), "piece")
    ids = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    filled = joined.groupBy("sequence_id").agg(ids.alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.octet_length("whole") / 4).cast("int"))
    return filled.select("sequence_id", whole.alias("whole")).select("sequence_id", (F.octet_length("whole") / 4).cast("long").alias("n_tokens"), F.concat("whole", F.unhex(pad)).alias("ids"))


def op4(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def report(docs: DataFrame) -> DataFrame:
    _, places = pack(docs, vocabulary_path(VOCABULARY))
    return places.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
