"""Embedding near-duplicates with a robust-pruned flat graph.

Vectors are compared within one label and length.  Equal vectors collapse into
one class first, so copies are never expanded.

Shards: each label gets centres in proportion to its classes, fitted on a bounded
sample.  A class is indexed in the shards of its ``OVERLAP`` nearest centres and
counts in that of the nearest, its home.  It asks in every shard that can be home to
a vector within the threshold of it: unit vectors with that cosine lie within a
distance r, and if y is nearest to centre j and x to centre i, then x lies no further
than r beyond the plane between the two centres.  So the plan of shards loses no
pair, wherever a dense group is cut, and counts each once from each side.  Asking
costs one walk for each shard within reach, and a walk grows slowly with the shard, so
shards are as large as a task may hold: a shard is one chunk unless its members exceed
``CHUNK_ROWS`` or ``CHUNK_BYTES``.  Those that ask are cut into blocks, and every block
meets every chunk: no task holds more than about one of each.

Graph: in each chunk, a few rows at a time, a vector's nearest candidates are pruned robustly (a candidate
goes once a chosen neighbour is closer to it by the factor ``ALPHA``), reverse
edges are added, and the lists from overlapping shards are united.

Search: from a chunk's medoid a greedy search with a bounded list runs for a block
of queries at once; from every vector within reach it then expands by range until
nothing new is near.  Walks compare in single precision; each pair is verified by its
cosine in double precision.

Audit: in every meeting of a block and a chunk the queries whose class number hashes
to 0 modulo ``AUDIT`` are compared with the whole chunk.  If the search missed one of
their links there, all pairs of that block and chunk are compared exactly.  ``audit``
measures the recall of a finished result against brute force.

Defined cases: vectors or labels that are null, vectors of length 0, zero vectors
and those with null or non-finite components link with nothing and stay; rows
that repeat an id are vectors of their own, that share the id; rows with a null id
never name a component that has another member; an empty table gives an empty
table; further columns do not clash since only id, vector and label are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table
from .components import components, spanning

THRESHOLD = 0.98
#: Classes that a shard aims at, and about the most that a chunk holds, in rows and in
#: bytes of its vectors; classes of a block that asks, and of those that walk at once.
SHARD_ROWS, CHUNK_ROWS, CHUNK_BYTES = 8000, 20_000, 64 << 20
BLOCK_ROWS, WALK_ROWS = 4000, 1000
OVERLAP = 2
#: Bounds of the fit: sampled vectors and centres, over all labels.
SAMPLE_ROWS, MAX_CENTRES = 20_000, 4096
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 32
#: Random candidates of each vector, and the edges kept for them.
FAR, FAR_DEGREE = 24, 8
#: The range search walks on through vectors this much below the threshold.
SLACK = 0.03
#: One class in so many is audited in each search.
AUDIT = 16
SEED = 6
#: Pairs of a query and a vector that one step handles at once.
_PAIRS = 30_000
#: Distances that ``build`` holds at once.
_DISTANCES = 4_000_000
#: Room for rounding where distances to centres, and cosines in single precision, are compared.
_ROUNDING, _SINGLE = 1e-6, 1e-4


def _kind(rows: DataFrame, vector: str) -> str:
    """Element type that vectors keep: float stays float, all else is double."""
    return "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"


def _valid():
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)


def _fit_centres(sample: pd.DataFrame, sizes: dict) -> dict:
    """Centres of each (label, length): k-means on the sampled directions."""
    rng, out = np.random.default_rng(SEED), {}
    wanted = {g: -(-n // SHARD_ROWS) for g, n in sizes.items()}
    room = min(1.0, MAX_CENTRES / max(1, sum(wanted.values())))
    for group, rows in sample.groupby(["label", "dim"], sort=True):
        x = np.stack(rows.embedding.to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        k = int(min(len(x), max(1, wanted.get(group, 1) * room)))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8 if k > 1 else 0):
            of = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, of, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
        out[group] = c
    return out


def _reach(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors: the ``OVERLAP`` nearest centres, and whether a vector with a
    cosine of at least ``threshold`` can have each centre as its nearest."""
    near = x @ centres.T
    homes = np.argsort(-near, axis=1, kind="stable")[:, :OVERLAP]
    home = homes[:, 0]
    apart = np.sqrt(np.maximum(2.0 - 2.0 * (centres @ centres.T), 0.0))
    radius = np.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    return homes, near.max(1)[:, None] - near <= radius * apart[home] + _ROUNDING


def _shards(classes: DataFrame, threshold: float, kind_of: str) -> DataFrame:
    """``classes`` (cid, label, dim, n, embedding) with ``homes``, the shards that hold
    a class, nearest first, and ``asks``, the shards that it asks in."""
    sizes = {(r["label"], r["dim"]): r["n"] for r in classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label", "dim").limit(MAX_CENTRES).collect()}
    sample = classes.orderBy(F.xxhash64("embedding"), "label").limit(SAMPLE_ROWS).select("label", "dim", "embedding").toPandas()
    centres = _fit_centres(sample, sizes) if len(sample) else {}

    def run(frames):
        for f in frames:
            homes: list = [[0]] * len(f)
            asks: list = [[0]] * len(f)
            for group, at in f.groupby(["label", "dim"], sort=False).indices.items():
                c = centres.get(group)
                if c is None or len(c) < 2:
                    continue
                near, reach = _reach(_unit(f.embedding.to_numpy()[at]), c, threshold)
                for row, own, other in zip(at, near, reach):
                    homes[row], asks[row] = own.tolist(), np.flatnonzero(other).tolist()
            yield f.assign(homes=homes, asks=asks)

    kind = classes.schema["label"].dataType.simpleString()
    bounded_batches(classes.sparkSession)
    return classes.mapInPandas(run, f"cid long, label {kind}, dim int, n long, embedding array<{kind_of}>, homes array<int>, asks array<int>")


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prune(x: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """Edges (n, 2) that robust pruning keeps of the candidates ``pool`` of rows ``own``."""
    n, k = pool.shape
    row = np.arange(n)
    to_self = 2.0 - 2.0 * np.einsum("nkd,nd->nk", x[pool], x[own])
    to_self[pool == own[:, None]] = np.inf
    order = np.argsort(to_self, axis=1, kind="stable")
    pool, to_self = pool[row[:, None], order], to_self[row[:, None], order]
    vectors = x[pool]
    between = 2.0 - 2.0 * (vectors @ vectors.transpose(0, 2, 1))
    alive, chosen = np.isfinite(to_self), np.zeros((n, k), bool)
    for _ in range(min(degree, k)):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        chosen[some, pick[some]] = True
        alive &= ~((ALPHA**2 * between[row, pick] <= to_self) & some[:, None])
        alive[row, pick] = False
    return np.stack([own[np.nonzero(chosen)[0]], pool[chosen]], 1)


def build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of one chunk: pruned near candidates, pruned far ones, so that
    a search can leave and enter dense regions, and the reverse of both."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64)] * n
    x = x.astype(np.float32)
    far = np.random.default_rng(SEED).integers(0, n, (n, FAR))
    edges, step = [], min(500, max(1, _DISTANCES // n))
    for lo in range(0, n, step):
        own = np.arange(lo, min(n, lo + step))
        cosine = x[own] @ x.T
        cosine[own - lo, own] = -np.inf
        near = np.argpartition(cosine, n - k, axis=1)[:, n - k :]
        edges += [_prune(x, own, near, DEGREE - FAR_DEGREE), _prune(x, own, far[own], FAR_DEGREE)]
    edges = np.concatenate(edges)
    code = np.unique(np.concatenate([edges[:, 0] * n + edges[:, 1], edges[:, 1] * n + edges[:, 0]]))
    return np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))


class Graph:
    """Unit vectors, in double and in single precision, with neighbour lists, one after
    another in ``near``."""

    def __init__(self, x: np.ndarray, lists: list[np.ndarray]) -> None:
        self.x, self.single = x, x.astype(np.float32)
        self.size = np.array([len(a) for a in lists], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.near = np.concatenate(lists).astype(np.int64) if len(lists) else np.zeros(0, np.int64)

    def expand(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of the nodes, and for each the place of its node."""
        size = self.size[nodes]
        at = np.repeat(self.start[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.near[at], np.repeat(np.arange(len(nodes)), size)


def _cosines(x: np.ndarray, nodes: np.ndarray, queries: np.ndarray, of: np.ndarray) -> np.ndarray:
    out = np.empty(len(nodes), x.dtype)
    for lo in range(0, len(nodes), _PAIRS):
        part = slice(lo, lo + _PAIRS)
        out[part] = np.einsum("pd,pd->p", x[nodes[part]], queries[of[part]])
    return out


def search(graph: Graph, queries: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) with a cosine of at least ``threshold``."""
    x, exact, queries = graph.single, queries, queries.astype(np.float32)
    n, m = len(x), len(queries)
    seen = np.zeros((m, n), bool)
    medoid = int((x @ x.mean(0)).argmax())
    beam = np.zeros((m, BEAM), np.int64)
    score = np.full((m, BEAM), -np.inf, np.float32)
    done = np.ones((m, BEAM), bool)
    beam[:, 0], score[:, 0], done[:, 0] = medoid, queries @ x[medoid], False
    seen[:, medoid] = True
    live = np.arange(m)
    hits = [(live, beam[:, 0].copy(), score[:, 0].copy())]
    while len(live):
        pick = np.where(done[live], -np.inf, score[live]).argmax(1)
        done[live, pick] = True
        near, of = graph.expand(beam[live, pick])
        new = ~seen[live[of], near]
        near, of = near[new], of[new]
        seen[live[of], near] = True
        s = _cosines(x, near, queries, live[of])
        close = s >= threshold - SLACK
        hits.append((live[of[close]], near[close], s[close]))
        width = np.bincount(of, minlength=len(live))
        place = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
        wide_s, wide_b = np.full((len(live), width.max(initial=0)), -np.inf, np.float32), np.zeros((len(live), width.max(initial=0)), np.int64)
        wide_s[of, place], wide_b[of, place] = s, near
        all_s, all_b = np.hstack([score[live], wide_s]), np.hstack([beam[live], wide_b])
        all_d = np.hstack([done[live], wide_s == -np.inf])
        top = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM]
        r = np.arange(len(live))[:, None]
        score[live], beam[live], done[live] = all_s[r, top], all_b[r, top], all_d[r, top]
        live = live[~done[live].all(1)]
    q, at, s = (np.concatenate(c) for c in zip(*hits))
    close = s >= threshold - SLACK
    todo, found = [(q[close], at[close], s[close])], []
    while todo:
        q, at, s = todo.pop()
        if len(q) > _PAIRS:
            todo.append((q[_PAIRS:], at[_PAIRS:], s[_PAIRS:]))
            q, at, s = q[:_PAIRS], at[:_PAIRS], s[:_PAIRS]
        good = s >= threshold - _SINGLE
        found.append((q[good], at[good]))
        near, of = graph.expand(at)
        new = ~seen[q[of], near]
        code = np.unique(q[of[new]] * n + near[new])
        q, at = code // n, code % n
        seen[q, at] = True
        s = _cosines(x, at, queries, q)
        close = s >= threshold - SLACK
        if close.any():
            todo.append((q[close], at[close], s[close]))
    q, at = (np.concatenate(c) for c in zip(*found))
    good = _cosines(graph.x, at, exact, q) >= threshold
    return q[good], at[good]


def _build_group(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("cid", kind="stable")
    lists = build(_unit(frame.embedding))
    cid = frame.cid.to_numpy()
    return pd.DataFrame({"cid": cid, "near": [cid[x] for x in lists]})


def _exact(x: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) found by comparing all."""
    step = max(1, 20 * _PAIRS // max(1, len(x)))
    found = [np.nonzero(queries[lo : lo + step] @ x.T >= threshold) for lo in range(0, len(queries), step)]
    return np.concatenate([i + k * step for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def _linked(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, audited: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by the graph; by exact comparison where the audited queries miss one."""
    graph = Graph(x, lists)
    walks = [search(graph, queries[lo : lo + WALK_ROWS], threshold) for lo in range(0, len(queries), WALK_ROWS)]
    i, j = np.concatenate([q + k * WALK_ROWS for k, (q, _) in enumerate(walks)]), np.concatenate([at for _, at in walks])
    if len(audited):
        true = len(_exact(x, queries[audited], threshold)[0])
        if np.isin(i, audited).sum() < true:
            return _exact(x, queries, threshold)
    return i, j


def _search_group(members: pd.DataFrame, asking: pd.DataFrame, threshold: float) -> pd.DataFrame:
    none = pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
    if not len(members) or not len(asking):
        return none
    members = members.sort_values("cid", kind="stable")
    cid, x, q, who = members.cid.to_numpy(), _unit(members.embedding), _unit(asking.embedding), asking.cid.to_numpy()
    near, of = np.concatenate(list(members.near)), np.repeat(np.arange(len(cid)), members.near.map(len))
    at = np.minimum(np.searchsorted(cid, near), len(cid) - 1)
    here = cid[at] == near
    lists = np.split(at[here], np.searchsorted(of[here], np.arange(1, len(cid))))
    i, j = _linked(x, lists, q, np.flatnonzero(asking.audited.to_numpy()), threshold)
    counts = (who[i] != cid[j]) & members.counts.to_numpy()[j]
    i, j = i[counts], j[counts]
    links = np.bincount(i, members.n.to_numpy()[j], len(who)).astype(np.int64)
    nodes, inverse = np.unique(np.concatenate([who[i], cid[j]]), return_inverse=True)
    root = spanning(len(nodes), [(inverse[: len(i)], inverse[len(i) :])])
    at = np.flatnonzero(root != np.arange(len(nodes)))
    counted = np.flatnonzero(links)
    return pd.DataFrame({"u": np.concatenate([nodes[at], who[counted]]), "v": np.concatenate([nodes[root[at]], who[counted]]), "links": np.concatenate([np.zeros(len(at), np.int64), links[counted]])})


def _own(name: str):
    return F.pmod(F.xxhash64("cid"), F.col(name)).cast("int")


def _every(name: str):
    return F.explode(F.sequence(F.lit(0), F.col(name) - 1))


def _cut(rows: DataFrame, group: list[str], name: str, most: int) -> DataFrame:
    bound = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.lit(CHUNK_BYTES) / (8 * F.first("dim")))))
    return rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / bound).cast("int").alias(name))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    kind = _kind(rows, vector)
    base = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("embedding"), F.col(f"`{label}`").alias("label"))
    base = base.withColumn("vector_key", F.when(_valid(), F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256)))
    classes = base.filter("vector_key is not null").groupBy("label", "vector_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    named = materialise(classes.withColumns({"dim": F.size("embedding"), "cid": F.monotonically_increasing_id()}), "classes")
    sharded = materialise(_shards(named.select("cid", "label", "dim", "n", "embedding"), threshold, kind), "shards")
    group = ["label", "dim", "shard"]
    held = sharded.withColumn("shard", F.explode("homes")).withColumn("counts", F.col("shard") == F.col("homes")[0])
    first = sharded.withColumn("shard", F.explode("asks")).withColumn("audited", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(AUDIT)) == 0)
    cuts = materialise(_cut(held, group, "chunks", CHUNK_ROWS).join(_cut(first, group, "blocks", BLOCK_ROWS), group), "cuts")
    held = held.join(cuts, group).withColumn("chunk", _own("chunks"))
    lists = held.select(*group, "chunk", "cid", "embedding").groupBy(*group, "chunk").applyInPandas(_build_group, "cid long, near array<long>")
    graph = materialise(lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    members = held.join(graph, "cid").withColumn("block", _every("blocks"))
    asking = first.join(cuts, group).withColumn("block", _own("blocks")).withColumn("chunk", _every("chunks"))
    full = [*group, "chunk", "block"]
    m = members.select(*full, "cid", "n", "counts", "embedding", "near").groupBy(*full)
    a = asking.select(*[F.col(c).alias(c) for c in (*full, "cid", "audited", "embedding")]).groupBy(*full)
    found = materialise(m.cogroup(a).applyInPandas(lambda x, y: _search_group(x, y, threshold), "u long, v long, links long"), "found")
    counts = found.filter("links > 0").groupBy("u").agg(F.sum("links").alias("links"))
    grouped = components(found.filter("links = 0").select("u", "v"))
    joined = named.join(counts, named.cid == counts.u, "left").join(grouped, named.cid == grouped.node, "left")
    joined = joined.select("label", "vector_key", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "cid").alias("group"))
    least = joined.groupBy("group").agg(F.min("rep").alias("component"))
    of_class = joined.join(least, "group").select(F.col("label").alias("c_label"), F.col("vector_key").alias("c_key"), "links", "component")
    out = base.join(of_class, (base.label == F.col("c_label")) & (base.vector_key == F.col("c_key")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def audit(rows: DataFrame, judged: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, every: int = 100) -> float:
    """Share of the true links of ids divisible by ``every`` that were counted.  These
    stated queries meet all rows block by block; nothing but two sums is collected."""
    valid = rows.select(F.col(f"`{key}`").cast("long").alias("cid"), F.col(f"`{vector}`").cast(f"array<{_kind(rows, vector)}>").alias("embedding"), F.col(f"`{label}`").alias("label")).filter(_valid()).withColumn("dim", F.size("embedding"))
    asked = valid.filter(F.col("cid") % every == 0)
    group = ["label", "dim"]
    cuts = materialise(_cut(valid, group, "chunks", CHUNK_ROWS).join(_cut(asked, group, "blocks", BLOCK_ROWS), group), "cuts")
    full = [*group, "chunk", "block"]
    m = valid.join(cuts, group).withColumn("chunk", _own("chunks")).withColumn("block", _every("blocks")).groupBy(*full)
    a = asked.join(cuts, group).withColumn("block", _own("blocks")).withColumn("chunk", _every("chunks")).select(*[F.col(c).alias(c) for c in (*full, "cid", "embedding")]).groupBy(*full)

    def count(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(asking):
            return pd.DataFrame({"id": [], "n": []}).astype("int64")
        i, j = _exact(_unit(members.embedding), _unit(asking.embedding), threshold)
        who = asking.cid.to_numpy()
        n = np.bincount(i[who[i] != members.cid.to_numpy()[j]], minlength=len(who))
        return pd.DataFrame({"id": who, "n": n})

    true = m.cogroup(a).applyInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    both = true.join(judged, true.id == judged[key]).agg(F.sum("n").alias("t"), F.sum("n_links").alias("f")).first()
    return 1.0 if not both["t"] else both["f"] / both["t"]


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
