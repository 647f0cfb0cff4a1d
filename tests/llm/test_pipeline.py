"""The whole pipeline against a plain version of each stage, on the smallest tables."""

import zlib

import numpy as np
import public_tokenizers
from test_near_copies import brute_kept
from test_text_operators import ODD, SF, brute_measures, brute_spans
from tokenizers import Tokenizer

import corpus_pipeline
from canopy.llm import packing, quality_classifier


def kept_by_rules(text):
    n, chars, symbols, lines, repeats = brute_measures(text)
    return n >= 20 and 100 * repeats <= 30 * n and 100 * symbols <= 20 * chars and 2 * n <= chars <= 25 * n and 10 * lines <= n


def one_of_each(docs):
    """The smallest id of each component of texts whose five-word shingles have a
    similarity of 0.8 or more, all pairs compared."""
    kept = brute_kept(docs)
    return {k: t for k, t in docs.items() if k in kept}


def redacted(text):
    out, at = "", 0
    for a, _, z, _ in brute_spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, z)
    return out + text[at:]


def test_pipeline_equals_a_plain_version(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in table.collect()}
    first = {k: v for k, v in rows.items() if kept_by_rules(v[0])}
    ruled = corpus_pipeline.drop_by_rules(spark, table, SF).cache()
    assert {r["doc_id"] for r in ruled.collect()} == set(first)
    model = quality_classifier.train(ruled, labels)
    model = quality_classifier.Model(model.bias, model.linear.astype(np.float32).astype(float), model.factors.astype(np.float32).astype(float))
    buckets = quality_classifier._Buckets()
    good = {k: t for k, (t, n) in first.items() if quality_classifier.sigmoid(model.margin(*quality_classifier.features(t, n, buckets))) >= 0.7}
    final = {k: redacted(t) for k, t in one_of_each(good).items()}
    lib = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    out: dict = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert set(out) == set(final)
    for k, parts in out.items():
        ids = np.array([*lib.encode(final[k], add_special_tokens=False).ids, 2], "<u4")
        assert sum(r["length"] for r in parts) == len(ids)
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_stages_take_odd_rows_and_clashing_columns(spark):
    odd = [(k, t, None if k == 1 else "en", None, None if k == 2 else 5, 1.0, "x", 2, "y", "z") for k, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, blob string, length int, component_id string, sequence_id string"
    docs = spark.createDataFrame(odd, schema)
    good = spark.createDataFrame([(100 + i, f"word{i} " + " ".join(f"plain{j} and{j * i}" for j in range(40)), "en", "s", None, 0.0, "x", 1, "y", "z") for i in range(3)], schema)
    for table in (docs, docs.limit(0), docs.unionByName(good).unionByName(good)):
        n = table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns and out.count() <= n, name
        packed = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert packed.filter("start = 0").count() == n
