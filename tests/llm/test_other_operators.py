"""URL filter, archives and vectors against brute force; queries against SQL."""

import glob
import gzip
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from canopy.llm import secret_scan, url_filter, vector_dedup, warc
from canopy.llm import queries as llm
from canopy.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


# URL filter

URLS = [
    None, "", "no scheme", "http://", "http://Example.com", "http://example.com/", "https://a.EXAMPLE.com/en/x?y", "http://www.example.com/en/", "http://a.www.example.com/en/z#q", "http://notexample.com/en/",
    "http://x.net/es/", "http://x.net/esx/", "http://net/fr/a", "http://y.net?/es/", "http://spam-farm.example.org/a", "http://m.adult-x.example.net/en/1", "http://adult.example.net/", "ftp://a.com/:/", "http://a://b.com/", "http://x.NET/ES/", "http://x.net/es/" + "a" * 50000,
]


def brute_judge(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if re.search(r"^([^/]*\.)?spam-farm\.|^([^/]*\.)?adult-[a-z0-9]+\.|^([^/]*[.-])?casino[.-]", host + path) else "allow"


def test_urls_equal_brute_force(spark):
    data = [(i, u, "h", "v") for i, u in enumerate(URLS)] + [(None, "http://a.com/", "h", "v"), (1, "http://a.com/", "h", "v")]
    df = spark.createDataFrame(data, "page_id long, url string, host string, verdict string")
    got = sorted([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_filter.judge(df))], key=str)
    assert got == sorted([(k, *brute_judge(u)) for k, u, *_ in data], key=str)
    assert rows(url_filter.judge(df.limit(0))) == []


def test_rules_sit_under_their_rarest_token():
    index = url_filter.build_index(url_filter.LIST_RULES, {"com": 90, "example": 5, "en": 50, "www": 9, "net": 3, "es": 7, "fr": 1})
    assert index == {"com": [0], "example": [1, 2], "net": [3], "fr": [4]}


# Archives


def test_archives_round_trip(spark):
    big, nasty = "é" * 600, "WARC/1.1\r\n\r\n" * 120
    data = [(1, "u1", big), (2, "u2", big), (9, None, big), (9, "again", big), (3, "a\r\nb", nasty), (4, "u4", nasty), (5, "u5", "small"), (6, "u6", "small"), (7, "u7", None), (8, "u8", ""), (None, "n", big)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS size", "'y' AS record_type")
    path = scratch_path(spark, "t")
    warc.write(df, path)
    got = rows(warc.resolve(warc.read(spark, path, payloads=True)))
    assert len(got) == len(data)
    want = {}
    for k, _, html in data:
        body = (html or "").encode()
        same = [x for x, _, h in data if h == html and x is not None]
        revisit = len(body) >= 1000 and k != max(same, default=None)
        want[k] = (body, "revisit" if revisit else "response", f"urn:page:{max(same)}" if revisit else None)
    for r in got:
        k = None if r["record_id"] == "urn:page:none" else int(r["record_id"].rpartition(":")[2])
        assert (bytes(r["payload"]), r["record_type"], r["refers_to"]) == want[k]
        assert r["payload_bytes"] == len(want[k][0]) and r["payload_digest"] == hashlib.sha1(want[k][0]).hexdigest()
    empty = scratch_path(spark, "t")
    warc.write(df.limit(0), empty)
    assert rows(warc.resolve(warc.read(spark, empty))) == []


def test_a_file_is_gzip_of_records_and_closes_by_bytes(spark, monkeypatch):
    """Any gzip reader gets the records one after another; files stay near their bound."""
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    data = [(i, f"http://a/{i}", f"page {i} é " * 1500) for i in range(60)]
    path = scratch_path(spark, "t")
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), path)
    files = [f.removeprefix("file://") for f in spark.read.text(path).inputFiles()]
    seen = []
    for f in files:
        with gzip.open(f) as g:
            seen += [(h["warc-target-uri"], block.partition(b"\r\n\r\n")[2].decode()) for h, block in warc.parse(g.read())]
    assert len(files) >= 8 and sorted(seen) == sorted((u, t) for _, u, t in data)


def test_pages_of_megabytes_and_the_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    big = ["é\U0001f642 x%d " % i * 250_000 for i in range(3)]
    data = [(i, "u", big[i % 3]) for i in range(12)]
    path = scratch_path(spark, "t")
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string"), path)
    got = rows(warc.resolve(warc.read(spark, path, payloads=True)))
    assert sum(r["record_type"] == "response" for r in got) == 3
    for r in got:
        k = int(r["record_id"].rpartition(":")[2])
        assert bytes(r["payload"]).decode() == big[k % 3] and r["refers_to"] == (None if k > 8 else f"urn:page:{9 + k % 3}")


# Vectors


def brute_vectors(data, threshold=0.98):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            return None
        x = np.array(v, np.float32).astype(float)
        return x / np.linalg.norm(x) if np.linalg.norm(x) else None

    units = [unit(v) for _, v, _ in data]
    n = len(data)
    near = [[j for j in range(n) if j != i and data[i][2] is not None and data[i][2] == data[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min(data[j][0] for j in seen)
        out.append((data[i][0], len(near[i]), comp, data[i][0] == comp))
    return sorted(out)


def test_repeated_and_null_ids_of_vectors(spark):
    """Two vectors may share an id; a null id links but names nothing."""
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    df = spark.createDataFrame([(5, a, 1), (5, b, 1), (7, c, 1), (None, c, 1), (8, b, 2)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(vector_dedup.near_duplicates(df))), key=str)
    assert got == sorted([(5, 2, 5), (5, 0, 5), (7, 2, 5), (None, 2, 5), (8, 0, 8)], key=str)


def cloud(seed, groups, size, spread):
    rng = np.random.default_rng(seed)
    data = []
    for g in range(groups):
        c = rng.normal(size=16)
        for _ in range(size):
            data.append((len(data), (c + rng.normal(size=16) * spread).astype(np.float32).tolist(), g % 3))
    return data


@pytest.mark.parametrize(("shard", "block"), [(1500, 2000), (40, 25)])
def test_vectors_equal_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", shard)
    for name in ("CHUNK_ROWS", "BLOCK_ROWS"):
        monkeypatch.setattr(vector_dedup, name, block)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] * 16, [None, *[1.0] * 15], [1.0, 2.0]]
    data = cloud(1, 12, 14, 0.03)
    data += [(len(data) + i, v, 1) for i, v in enumerate(odd)] + [(900, data[0][1], 0), (901, data[0][1], 0), (902, [2 * x for x in data[0][1]], 0), (903, data[0][1], None), (904, data[0][1], 7)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "0L AS rep", "'n' AS near")
    got = rows(vector_dedup.near_duplicates(df))
    want = brute_vectors(data)
    found, true = sum(r["n_links"] for r in got), sum(w[1] for w in want)
    assert len(got) == len(data) and 0.97 * true <= found <= true
    if shard == 1500:
        assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert vector_dedup.audit(df, spark.createDataFrame(got)) >= 0.9
    assert rows(vector_dedup.near_duplicates(df.limit(0))) == []


def test_a_dense_group_over_many_shards_loses_no_link(spark, monkeypatch):
    """A third of all rows are distinct near copies of one vector, cut into many shards."""
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", 30)
    for name, most in (("CHUNK_ROWS", 250), ("BLOCK_ROWS", 250), ("WALK_ROWS", 60)):
        monkeypatch.setattr(vector_dedup, name, most)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 64))
    x[::3] = x[0] + rng.normal(size=(400, 64)) * 0.1
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = rows(vector_dedup.near_duplicates(df))
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    assert want.sum() > 10_000
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want))
    assert vector_dedup.audit(df, spark.createDataFrame(got)) == 1.0


# Queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    place = [c[0] for c in cursor.description]
    assert sorted(place) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[place.index(c)] for c in columns) for r in cursor.fetchall()), key=str)


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == columns, name
    assert all(a.count() >= b.count() > 0 for a, b in zip(kept, kept[1:]))
    ids = {r["doc_id"] for r in kept[2].select("doc_id").collect()}
    good = {r["doc_id"] for r in kept[1].select("doc_id").collect() if labels.get(r["doc_id"]) == 1}
    assert len(good & ids) >= 0.95 * len(good)
    texts = [r["text"] for r in kept[3].select("text").collect()]
    assert len(texts) == len(set(texts))
    again = secret_scan.report(kept[4], secret_scan.Ledger(spark, scratch_path(spark, "t")))
    assert kept[4].count() == kept[3].count() and again.filter("spans <> ''").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept[4].select("doc_id").collect()}
