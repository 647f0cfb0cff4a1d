"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: a bit is set where over half of a text's shingle hashes set it.
Texts with equal fingerprints collapse into one class before anything is
compared, so that copies are never expanded.  Further fingerprints, from mixed
hashes, can be asked for; each has an index of its own, and a link under any counts.

Routing: two fingerprints with at most three differing bits agree on at least
one of four pieces of their 64 bits, so each class goes to four groups.  A group
with more than ``GROUP_ROWS`` members is split again by four pieces of the bits
that are still free, which keeps every link: the differences all lie in the free
bits.  After the last split at most 16 bits are free, so that a group holds at most
65,536 different fingerprints whatever the input.

Index: inside a task the members of each group are sorted by the rank of their
value in the binary reflected Gray code.  Runs of ``FANOUT`` neighbours form the
nodes above; a node's pattern is the masked set of bits on which all of its
members agree, and only the bits that its parent does not hold already.  A search
adds up differences on the way down and drops a whole node once the sum passes
the limit.  A task returns a spanning forest of the links that it found, at most
one row for each member.

Defined cases: a null text counts as the empty text, whose fingerprint is zero
and links like any other; fewer words than a shingle give one shingle of them all;
repeated ids and rows are kept and share a component; rows with a null id keep
their fingerprint and never name a component that has another member; an empty
table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, table
from .components import components, spanning

SHINGLE, SEED, LIMIT = 3, 42, 3
GROUP_ROWS = 1000
FANOUT = 8
SPLITS = 5
#: Candidate pairs that one step of a search holds at most.
_FRONTIER = 2_000_000


def _mixed(hashes: np.ndarray, table_: int) -> np.ndarray:
    """Hashes of a further fingerprint, made from those of the first."""
    if not table_:
        return hashes
    z = hashes + np.uint64(table_ * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bits_of(hashes: np.ndarray, table_: int = 0) -> int:
    """The fingerprint of shingle hashes: bits that over half of them set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = _mixed(hashes[at : at + 65536], table_)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((total * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint_list(text: str | None, shingle: int = SHINGLE, count: int = 1) -> list[int]:
    """``count`` independent fingerprints; the first is that of the plain hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * count
    digest = xxhash.xxh64_intdigest
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) > shingle else [b" ".join(words)]
    hashes = np.fromiter((digest(s, SEED) for s in runs), np.uint64, max(1, len(words) - shingle + 1))
    return [bits_of(hashes, k) for k in range(count)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return fingerprint_list(text, shingle)[0]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, count: int = 1) -> DataFrame:
    """Columns: the key and ``fps``, the fingerprints as signed 64-bit numbers."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint_list(t, shingle, count) for t in b.column(1).to_pylist()], dtype=np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * count, pa.int32()), pa.array(fps, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "fps"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias("__text"))
    return map_arrow(rows, run, f"`{key}` long, fps array<long>")


def _pieces(mask: int) -> list[int]:
    """The free bits of a mask in four near-equal pieces, each added to the mask."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [len(free) * k // (LIMIT + 1) for k in range(LIMIT + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _gray_rank(fp):
    """Position in Gray order, as a column; the sign is flipped to sort as unsigned."""
    x = fp
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _routed(classes: DataFrame) -> DataFrame:
    """Rows (tbl, mask, part, fp, rep): every class in each group that it belongs to,
    no group over its bound."""
    spark = classes.sparkSession
    masks, done = _pieces(0), []
    rows = classes.select("tbl", "fp", "rep", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    for level in range(SPLITS):
        large = materialise(rows.groupBy("tbl", "mask", "part").count().filter(F.col("count") > GROUP_ROWS).select("tbl", "mask", "part"), "groups")
        if level == SPLITS - 1 or large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, ["tbl", "mask", "part"], "left_anti"))
        finer = [(_signed(m), [_signed(x) for x in _pieces(m)]) for m in masks]
        masks = [x for m in masks for x in _pieces(m)]
        step = F.broadcast(spark.createDataFrame(finer, "mask long, finer array<long>"))  # 4**level rows, whatever the input
        rows = rows.join(large, ["tbl", "mask", "part"], "left_semi").join(step, "mask").select("tbl", "fp", "rep", F.explode("finer").alias("mask"))
        rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    return reduce(DataFrame.union, [d.select("tbl", "mask", "part", "fp", "rep") for d in done])


class Index:
    """Gray-order hierarchical index over groups that lie one after another."""

    def __init__(self, fp: np.ndarray, sizes: np.ndarray) -> None:
        self.fp = fp
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        same, some, first, count = fp, fp, np.arange(len(fp)), sizes
        levels = []
        last = np.arange(len(fp))
        while True:
            levels.append((~(same ^ some), same, first, last))
            if (count == 1).all():
                break
            offset = np.concatenate([[0], np.cumsum(count)[:-1]])
            count = -(-count // FANOUT)
            head = np.repeat(offset, count) + FANOUT * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            tail = np.concatenate([head[1:], [len(same)]]) - 1
            same, some = np.bitwise_and.reduceat(same, head), np.bitwise_or.reduceat(some, head)
            levels[-1] = (*levels[-1], head, tail)
            first, last = first[head], last[tail]
        #: From the roots down: own mask, pattern, children's bounds, last leaf.
        self.levels = levels[::-1]

    def links(self):
        """Pairs (i, j), i before j, of one group with at most LIMIT differing bits."""
        n = len(self.fp)
        step = max(1, _FRONTIER // max(1, int(np.bincount(self.group).max(initial=1))))
        for lo in range(0, n, step):
            yield self._search(np.arange(lo, min(n, lo + step)))

    def _search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = self.group[q]
        mask, pattern, *_ = self.levels[0]
        acc = np.bitwise_count((self.fp[q] ^ pattern[node]) & mask[node])
        for above, below in zip(self.levels, self.levels[1:]):
            head, tail = below[4], below[5]
            width = tail[node] - head[node] + 1
            child = np.repeat(head[node] - np.cumsum(width) + width, width) + np.arange(width.sum())
            inherited = np.repeat(above[0][node], width)
            q, acc = np.repeat(q, width), np.repeat(acc, width)
            own = below[0][child] & ~inherited
            acc = acc + np.bitwise_count((self.fp[q] ^ below[1][child]) & own)
            keep = (acc <= LIMIT) & (below[3][child] > q)
            q, node, acc = q[keep], child[keep], acc[keep]
        keep = (acc <= LIMIT) & (node > q)
        return q[keep], node[keep]


def _group_links(batches):
    """Spanning links of the groups of a partition, whole groups at a time."""
    names = ("tbl", "mask", "part", "fp", "rep")
    held: list[tuple[np.ndarray, ...]] = []

    def begins(cols) -> np.ndarray:
        """Rows whose group is not that of the row before."""
        new = np.ones(len(cols[0]), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        return np.flatnonzero(new)

    def flush(cols):
        new = begins(cols)
        sizes = np.diff(np.append(new, len(cols[0])))
        many = np.repeat(sizes > 1, sizes)
        fp, rep, sizes = cols[3][many].view(np.uint64), cols[4][many], sizes[sizes > 1]
        if len(sizes):
            parent = spanning(len(fp), Index(fp, sizes).links())
            at = np.flatnonzero(parent != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[parent[at]])], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in names))
        if sum(len(h[0]) for h in held) < 50_000:
            continue
        cols = tuple(np.concatenate(c) for c in zip(*held))
        at = int(begins(cols)[-1])
        if at:
            yield from flush(tuple(c[:at] for c in cols))
        held = [tuple(c[at:] for c in cols)]
    if held:
        yield from flush(tuple(np.concatenate(c) for c in zip(*held)))


def links(classes: DataFrame) -> DataFrame:
    """Spanning links (u, v) between the classes (fps, rep) that are near under one
    of their fingerprints."""
    each = classes.select("rep", F.posexplode("fps").alias("tbl", "fp"))
    equal = each.groupBy("tbl", "fp").agg(F.min("rep").alias("least"))
    rows = _routed(equal.select("tbl", "fp", F.col("least").alias("rep"))).withColumn("gray", _gray_rank(F.col("fp")))
    dealt = rows.repartition("tbl", "mask", "part").sortWithinPartitions("tbl", "mask", "part", "gray").select("tbl", "mask", "part", "fp", "rep")
    near = map_arrow(dealt, _group_links, "u long, v long")
    same = each.join(equal, ["tbl", "fp"]).filter("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    return near.union(same)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, count: int = 1) -> DataFrame:
    """Per document: key, fingerprint (16 hex digits, the first), component_id.

    With ``count`` over 1, texts also link when any further fingerprint is near: each
    is an independent chance to find a pair that the first puts just too far apart.
    """
    marked = materialise(fingerprints(docs, key, text, shingle, count), "fingerprints")
    classes = materialise(marked.groupBy("fps").agg(F.min(key).alias("rep")).filter("rep is not null"), "classes")
    found = components(links(classes))
    named = classes.join(found, classes.rep == found.node, "left").select("fps", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0"))
    return marked.join(named, "fps", "left").select(F.col(key), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, count: int = 1) -> DataFrame:
    """One document of each component, that with the smallest key; rows that repeat
    a key are reduced to one.  Rows with a null key stay."""
    judged = near_duplicates(docs.select(key, text), key, text, shingle, count)
    keys = judged.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("__keep")).distinct()
    kept = docs.join(keys, F.col(f"`{key}`") == F.col("__keep"), "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.filter(F.col(f"`{key}`").isNull()))


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
