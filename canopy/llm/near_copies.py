"""Near copies by exact Jaccard similarity of five-word shingles.

Texts with equal shingle sets collapse into one class.  Candidates come in three ways,
each narrower than the one before, and components are formed in between, so that a
class that is linked already is not compared again:

1. SimHash: the Gray-order index of ``simhash`` links classes whose fingerprints of
   five-word shingles differ in at most three bits.  That finds copies with few
   changes, whatever the size of their group.  At a similarity of 0.8 fingerprints
   differ in about ten bits of 64, so that the index alone misses most such pairs.
2. MinHash buckets: a class goes to ``BANDS`` buckets, each the hash of ``BAND_ROWS``
   minima of its shingle hashes; a pair of similarity s shares none with probability
   (1 - s**BAND_ROWS)**BANDS, 1.3e-7 at 0.8.  The classes of a bucket are compared
   with one of them, which then leaves the bucket.
3. Prefixes: classes in buckets that still hold several components are joined by their
   rarest shingles.  Two sets of similarity t share one of the first
   n - ceil(2 t / (1 + t) n) + 1 shingles of the smaller and the first
   m - ceil(t m) + 1 of the larger, in the order of how many classes hold a shingle,
   and from the first that they share on each has t / (1 + t) (n + m) at least.  A
   bitmap of parities bounds from below how many shingles one of the two alone holds
   (Sandes et al., 2017); that must be (1 - t) / (1 + t) (n + m) at most.  So no pair is
   lost.  In a group of many copies that differ from a common source, but too much from
   each other, the join still tests pairs by their bitmaps; few go on to be verified.

A pair counts only if its exact similarity, from the 64-bit hashes of all shingles,
is at least 0.8.

Defined cases: a null text counts as the empty text; fewer words than a shingle give
one shingle of them all; a row is named by its key and its text, so that rows that
repeat a key are judged by their own texts; rows with a null key stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise
from .components import components
from .simhash import bits_of, links as simhash_links

SHINGLE, SEED = 5, 42
#: The least similarity of a near copy, as a fraction of whole numbers.
SIMILARITY = (4, 5)
BANDS, BAND_ROWS = 40, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 256
#: Words of 64 bits in the bitmap of parities of a set; a power of two.
BITMAP_WORDS = 16


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    runs = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)])) if len(words) > SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, (hashes[at : at + _STEP, None] * _FACTORS).min(0), out=least)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64)


def _mark(batches):
    for b in batches:
        names, sizes, prints, out = [], [], [], []
        for t in b.column(2).to_pylist():
            hashes = shingle_hashes(t)
            names.append(xxhash.xxh128_hexdigest(hashes.tobytes()))
            sizes.append(len(hashes))
            prints.append(bits_of(hashes))
            out.append(buckets(hashes))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], names=["id", "text_key", "set_key", "n", "fp", "buckets"])


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["cls", "hashes"])


def _alike(common, a, b):
    return SIMILARITY[1] * common >= SIMILARITY[0] * (a + b - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of the least similarity or more."""
    a = sets.select(F.col("cls").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("cls").alias("v"), F.col("hashes").alias("b"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", F.size("a").alias("x"), F.size("b").alias("y"), F.size(F.array_intersect("a", "b")).alias("common"))
    return both.filter(_alike(F.col("common"), F.col("x"), F.col("y"))).select("u", "v")


def _by_prefix(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) among ``rest`` (cls, component, n), of different components,
    that share a rare shingle as two sets of the least similarity must.  Shingles of one
    component alone come first in the order; such pairs share none of them."""
    t, d = SIMILARITY
    held = rest.join(sets, "cls").select("cls", "component", "n", F.explode("hashes").alias("h"))
    often = held.groupBy("h").agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("h", "often")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(BITMAP_WORDS - 1)
    maps = [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(BITMAP_WORDS)]
    ranked = held.join(often, "h").groupBy("cls", "component", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("shared"), *maps)  # the shingles of one class
    lone = F.col("n") - F.size("shared")
    larger = F.col("n") - F.ceil(F.col("n") * t / d) + 1
    smaller = F.col("n") - F.ceil(F.col("n") * (2 * t) / (d + t)) + 1
    words = [f"w{k}" for k in range(BITMAP_WORDS)]
    first = ranked.select("cls", "component", "n", lone.alias("lone"), (smaller - lone).alias("smaller"), F.size("shared").alias("held"), *words, F.posexplode(F.slice("shared", F.lit(1), F.greatest(larger - lone, F.lit(0)).cast("int"))).alias("at", "x"))
    rows = materialise(first.select("cls", "component", "n", "lone", F.col("x.h").alias("h"), (F.col("at") < F.col("smaller")).alias("counts"), (F.col("held") - F.col("at")).alias("left"), *words), "prefixes")
    a = rows.filter("counts").select("h", F.col("cls").alias("u"), F.col("n").alias("un"), F.col("component").alias("uc"), F.col("left").alias("u_left"), F.col("lone").alias("u_lone"), *[F.col(w).alias(f"u_{w}") for w in words])
    b = rows.select(F.col("h").alias("other"), F.col("cls").alias("v"), F.col("n").alias("vn"), F.col("component").alias("vc"), F.col("left").alias("v_left"), F.col("lone").alias("v_lone"), *[F.col(w).alias(f"v_{w}") for w in words])
    # from the first shared shingle on, both must have as many as they have in common
    enough = F.least("u_left", "v_left") * (t + d) >= (F.col("un") + F.col("vn")) * t
    # shingles that one set alone holds: the lone ones, and at least one for each bit that differs
    apart = F.col("u_lone") + F.col("v_lone")
    for w in words:
        apart = apart + F.bit_count(F.col(f"u_{w}").bitwiseXOR(F.col(f"v_{w}")))
    few = apart * (d + t) <= (F.col("un") + F.col("vn")) * (d - t)
    order = (F.col("un") < F.col("vn")) | ((F.col("un") == F.col("vn")) & (F.col("u") < F.col("v")))
    return a.join(b, (F.col("h") == F.col("other")) & order & (F.col("uc") != F.col("vc")) & _size_fits("un", "vn") & enough & few).select("u", "v").distinct()


def _size_fits(a: str, b: str):
    return SIMILARITY[1] * F.least(a, b) >= SIMILARITY[0] * F.greatest(a, b)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, text_key, kept), one for each key that is not null and text."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).filter("id is not null")
    rows = rows.select("id", F.sha2("text", 256).alias("text_key"), "text")
    marked = materialise(map_arrow(rows, _mark, "id long, text_key string, set_key string, n long, fp long, buckets array<long>"), "marked")
    classes = marked.groupBy("set_key").agg(F.min(F.struct("id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    near = materialise(simhash_links(classes.select(F.col("cls").alias("rep"), F.array("fp").alias("fps"))), "near")
    each = classes.select("cls", "n", F.explode("buckets").alias("bucket"))
    met = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("bucket")
    each = materialise(each.join(met, "bucket", "left_semi"), "buckets")
    named_ = each.select("cls").union(near.select("u")).union(near.select("v")).distinct()
    asked = named_.join(classes, "cls").select("cls", F.col("rep.id").alias("id"), F.col("rep.text_key").alias("text_key"))
    texts = rows.join(asked, ["id", "text_key"]).dropDuplicates(["cls"]).select("cls", "text")
    sets = materialise(map_arrow(texts, _sets, "cls long, hashes array<long>"), "sets")

    def still_open(state: DataFrame, links: DataFrame) -> DataFrame:
        """Bucket rows with the component of their class, of buckets not yet in one."""
        of = components(links).withColumnRenamed("node", "cls")
        known = state.drop("component").join(of, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        mixed = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
        return materialise(known.join(mixed, "bucket", "left_semi"), "open")

    links = materialise(_verified(near, sets), "verified")
    state = still_open(each, links)
    pivot = state.groupBy("bucket").agg(F.min_by(F.struct("cls", "n", "component"), F.xxhash64("cls")).alias("p"))
    star = state.join(pivot, "bucket")
    pairs = star.filter((F.col("component") != F.col("p.component")) & _size_fits("n", "p.n")).select(F.least("cls", "p.cls").alias("u"), F.greatest("cls", "p.cls").alias("v")).distinct()
    links = links.union(materialise(_verified(pairs, sets), "verified"))
    state = still_open(star.filter(F.col("cls") != F.col("p.cls")).select("bucket", "cls", "n"), links)
    rest = materialise(state.select("cls", "component", "n").distinct(), "rest")
    links = links.union(materialise(_verified(_by_prefix(rest, sets), sets), "verified"))
    of = components(links).withColumnRenamed("node", "cls")
    named = classes.join(of, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = named.groupBy("component").agg(F.min("rep").alias("rep")).select(F.col("rep.id").alias("id"), F.col("rep.text_key").alias("text_key"))
    judged = marked.select("id", "text_key").distinct()
    return judged.join(first.withColumn("kept", F.lit(True)), ["id", "text_key"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that with the smallest key.  Rows with a null key stay."""
    kept = materialise(near_copies(docs, key, text).filter("kept").select(F.col("id").alias("__id"), F.col("text_key").alias("__text_key")), "kept")
    own = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    chosen = docs.withColumn("__own", own).join(kept, (F.col(f"`{key}`") == F.col("__id")) & (F.col("__own") == F.col("__text_key")), "left_semi")
    return chosen.dropDuplicates([key, "__own"]).drop("__own").unionByName(docs.filter(F.col(f"`{key}`").isNull()))
