"""Training-order materialisation of token ids as fixed-stride binary shards.

Documents become one stream of ids for each input partition, every document ends
with the end id, and the stream is cut into sequences of ``seq_len`` ids; the last
of a partition is padded.  Sequence numbers follow (partition, place in it).  A
keyed Feistel permutation with cycle-walking maps the numbers 0 .. n-1 one to one
to global slots: the training order for that key, computed for each row alone.

Slots are range-partitioned: shard k holds slots k * shard_rows and on, sorted, one
file a shard.  A record is ``seq_len`` unsigned 16-bit ids and a 16-bit zero that
marks its end, so slot s lies at byte (s % shard_rows) * stride.  Records go out
through Spark's text writer, whose line separator is that mark: any file system
that Spark knows will do, and a lost executor leaves no half-written shard.

Recovery: a folder holds the staged sequences, a manifest (counts by input split,
dictionary and parameters), written last, and the shards.  ``stage`` on a folder with
a manifest takes what is there, so that numbers, which depend on the splits of the
first staging, never change under shards that are already written; ``resume`` writes
what ``missing_shards`` finds missing, in any session.  ``read`` starts at any slot and
opens no shard before it.

Between the two passes sequences are compressed with a dictionary that is taken
from a bounded sample of the texts; all sequences are written whole.

Defined cases: a null text counts as the empty text and adds only its end id;
repeated rows add their ids again; an empty table gives no sequence and no shard;
only the text is read, so further columns do not clash.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..plans.scratch import exists
from .common import map_arrow, materialise, once, scratch_path, table

RANKS = "byte_bpe_multi_50k.tiktoken"
END_ID = 50256
SEQ_LEN, SHARD_ROWS = 2048, 8192
KEY = 0x5EED
ROUNDS = 6
#: Bounds of the compression dictionary: sampled texts, and bytes of their ids.
SAMPLE_TEXTS, DICTIONARY_BYTES = 800, 1_000_000
_MARK = "\x00\x00"
_MOST = (1 << 16) - 1
_STAGED = "part int, idx long, n_tokens int, blob binary"
_MANIFEST = "parts array<long>, first array<long>, total long, dictionary binary, seq_len int, shard_rows int, key long"


def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    if max(max(ranks.values()), END_ID) > _MOST:
        raise ConfigurationError(f"an id of this vocabulary does not fit 16 bits: the largest is {max(ranks.values())}")
    return tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def feistel(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of sequence numbers below ``n``: a permutation of 0 .. n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    rounds = [np.uint64(((key + 1) * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in rounds:
            z = right ^ k
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << shift) | right

    out = once(np.asarray(numbers, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@dataclass
class Order:
    """A staged corpus: compressed sequences, where each partition's numbers begin, and
    the folder that holds them."""

    folder: str
    staged: DataFrame
    parts: np.ndarray
    first: np.ndarray
    total: int
    dictionary: bytes
    seq_len: int = SEQ_LEN
    shard_rows: int = SHARD_ROWS
    key: int = KEY

    @property
    def path(self) -> str:
        return f"{self.folder}/shards"

    @property
    def shards(self) -> int:
        return -(-self.total // self.shard_rows)

    @property
    def stride(self) -> int:
        return 2 * self.seq_len + len(_MARK)


def _dictionary(docs: DataFrame, text: str, path: str, pattern: str) -> bytes:
    """The ids of at most SAMPLE_TEXTS texts of one split, up to DICTIONARY_BYTES: what
    sequences share with them is stored as a reference.  Texts stay on the executors."""

    def run(batches):
        encoder, held, size = _encoder(path, pattern), [], 0
        for t in (x for b in batches for x in b.column(0).to_pylist()):
            held.append(np.append(encoder.encode_to_numpy(t or "", disallowed_special=()), END_ID).astype("<u2").tobytes())
            size += len(held[-1])
            if len(held) == SAMPLE_TEXTS or size >= DICTIONARY_BYTES:
                break
        if held:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([b"".join(held)[:DICTIONARY_BYTES]], pa.binary())})

    first = map_arrow(docs.select(F.col(f"`{text}`").alias("t")), run, "ids binary").limit(1).collect()
    return bytes(first[0]["ids"]) if first else b""


def _zstd(dictionary: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if dictionary else {}


def load(spark: SparkSession, folder: str) -> Order | None:
    """The order that was staged in ``folder``; nothing if staging did not end."""
    if not exists(spark, f"{folder}/manifest/_SUCCESS"):
        return None
    m = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").first()
    staged = spark.read.schema(_STAGED).parquet(f"{folder}/sequences")
    return Order(folder, staged, np.array(m["parts"], np.int64), np.array(m["first"], np.int64), m["total"], bytes(m["dictionary"]), m["seq_len"], m["shard_rows"], m["key"])


def stage(docs: DataFrame, path: str, pattern: str, text: str = "text", seq_len: int = SEQ_LEN, shard_rows: int = SHARD_ROWS, key: int = KEY, folder: str | None = None) -> Order:
    """Tokenise ``docs`` into ``folder`` (a new scratch folder without one), or take
    what an earlier call left there."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "order")
    known = load(spark, folder)
    if known is not None:
        if (known.seq_len, known.shard_rows, known.key) != (seq_len, shard_rows, key):
            raise ConfigurationError("the folder holds an order with other parameters")
        return known
    _encoder(path, pattern)  # a vocabulary that does not fit fails here, before any task
    dictionary = _dictionary(docs, text, path, pattern)

    def run(batches):
        encoder, part = once(("ranks", path, pattern), lambda: _encoder(path, pattern)), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=6, **_zstd(dictionary))
        end, held, size, made = np.array([END_ID], "<u2"), [], 0, 0

        def rows(ids: np.ndarray, last: int):
            nonlocal made
            n = len(ids) // seq_len
            blobs = [pack.compress(ids[i * seq_len : (i + 1) * seq_len].tobytes()) for i in range(n)]
            tokens = [seq_len] * n
            if last:
                tokens[-1] = last
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "idx": pa.array(range(made, made + n), pa.int64()), "n_tokens": pa.array(tokens, pa.int32()), "blob": pa.array(blobs, pa.binary())})
            made += n

        for b in batches:
            for t in b.column(0).to_pylist():
                held += [encoder.encode_to_numpy(t, disallowed_special=()).astype("<u2"), end] if t else [end]
                size += len(held[-2]) + 1 if t else 1
            if size >= seq_len:
                ids = np.concatenate(held)
                whole = len(ids) // seq_len * seq_len
                yield from rows(ids[:whole], 0)
                held, size = [ids[whole:]], len(ids) - whole
        if size:
            ids = np.concatenate(held)
            yield from rows(np.append(ids, np.full(seq_len - size, END_ID, "<u2")), size)

    made = map_arrow(docs.select(F.col(f"`{text}`").alias("__text")), run, _STAGED)
    made.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/sequences")
    staged = spark.read.schema(_STAGED).parquet(f"{folder}/sequences")
    counts = sorted((r["part"], r["n"]) for r in staged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each input split
    n = np.array([c for _, c in counts], np.int64)
    row = ([p for p, _ in counts], (np.cumsum(n) - n).tolist(), int(n.sum()), bytearray(dictionary), seq_len, shard_rows, key)
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return load(spark, folder)


def numbered(order: Order, blobs: bool = False) -> DataFrame:
    """Sequences with their number, slot and shard."""
    parts, first, total, key, shard_rows = order.parts, order.first, order.total, order.key, order.shard_rows
    names = ["n_tokens", *(["blob"] if blobs else [])]

    def run(batches):
        for b in batches:
            number = first[np.searchsorted(parts, b.column("part").to_numpy())] + b.column("idx").to_numpy() if b.num_rows else np.zeros(0, np.int64)
            slot = feistel(number, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(slot), pa.array((slot // shard_rows).astype(np.int32)), *[b.column(c) for c in names]], names=["sequence", "slot", "shard", *names])

    kinds = "sequence long, slot long, shard int, n_tokens int" + (", blob binary" if blobs else "")
    return map_arrow(order.staged.select("part", "idx", *names), run, kinds)


def write(order: Order, path: str, only: list[int] | None = None) -> None:
    """Write all shards, or those of ``only``, below ``path``."""
    if not order.shards or only == []:
        return
    dictionary, width = order.dictionary, 2 * order.seq_len
    rows = numbered(order, blobs=True).select("shard", "slot", "blob")
    if only is not None:
        rows = rows.filter(F.col("shard").isin(*only))
    dealt = rows.repartitionById(order.shards, F.col("shard")).sortWithinPartitions("slot").select("blob")

    def run(batches):
        unpack = zstandard.ZstdDecompressor(**_zstd(dictionary))
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([unpack.decompress(x, max_output_size=width) for x in b.column(0).to_pylist()], pa.binary())], names=["record"])

    records = dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.mode("append").option("lineSep", _MARK).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def missing_shards(spark: SparkSession, order: Order, path: str) -> list[int]:
    """Shards that have no file of their full length yet."""
    there = {(int(re.search(r"part-(\d+)", r["path"])[1]), r["length"]) for r in _files(spark, path).select("path", "length").collect()} if exists(spark, path) else set()  # one row for each shard
    size = [min(order.shard_rows, order.total - k * order.shard_rows) * order.stride for k in range(order.shards)]
    return [k for k in range(order.shards) if (k, size[k]) not in there]


def resume(spark: SparkSession, folder: str) -> Order | None:
    """Write what an interrupted run left unwritten; nothing if it did not end staging."""
    order = load(spark, folder)
    if order is not None:
        write(order, order.path, missing_shards(spark, order, order.path))
    return order


def read(spark: SparkSession, path: str, seq_len: int = SEQ_LEN, shard_rows: int = SHARD_ROWS, from_slot: int = 0) -> DataFrame:
    """Records of the shards from ``from_slot`` on, in place: slot, shard, byte offset,
    ids (binary).  Shards before that slot are not opened."""
    stride = 2 * seq_len + len(_MARK)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                shard, raw = int(re.search(r"part-(\d+)", name)[1]), data.as_py()
                if len(raw) % stride:
                    raise ValueError(f"{name} does not hold whole records")
                begin = max(0, from_slot - shard * shard_rows) * stride
                for at in range(begin, len(raw), 1024 * stride):
                    lo = range(at, min(len(raw), at + 1024 * stride), stride)
                    slots = [shard * shard_rows + x // stride for x in lo]
                    yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int64()), "shard": pa.array([shard] * len(slots), pa.int32()), "byte_offset": pa.array(list(lo), pa.int64()), "ids": pa.array([raw[x : x + 2 * seq_len] for x in lo], pa.binary())})

    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    there = _files(spark, path)
    if from_slot:
        names = [r["path"] for r in there.filter(shard >= from_slot // shard_rows).select("path").collect()]  # one row for each shard
        there = spark.read.format("binaryFile").load(names) if names else there.limit(0)
    return map_arrow(there.select("path", "content"), run, "slot long, shard int, byte_offset long, ids binary")


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    order = stage(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    write(order, order.path)
    plan = materialise(numbered(order), "order")
    if not order.shards:
        return plan.select("sequence", "slot", "shard", F.lit(0).cast("long").alias("byte_offset"), "n_tokens", F.lit(0).cast("long").alias("ids_crc32"))
    back = materialise(read(spark, order.path).select("slot", "byte_offset", F.crc32("ids").alias("ids_crc32")), "records")
    return plan.join(back, "slot").select("sequence", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32")
