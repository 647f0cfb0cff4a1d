"""The near-copy stage of the pipeline against brute-force similarity."""

import random

import corpus_pipeline
from canopy.llm import near_copies


def shingles(text):
    words = text.lower().split()
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) > 5 else frozenset([tuple(words)])


def brute_kept(docs):
    sets = {k: shingles(t) for k, t in docs.items()}
    near = {a: [b for b in docs if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])] for a in docs}
    kept, seen = set(), set()
    for k in sorted(docs):
        todo = [] if k in seen else [k]
        kept |= set(todo)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
    return kept


def edited(rng, words, share):
    return " ".join(f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in words)


def test_near_copies_equal_brute_force(spark):
    """Copies around the limit, and one large group of near copies."""
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        texts += [" ".join(words), *(edited(rng, words, s) for s in (0.005, 0.015, 0.025, 0.03, 0.05))]
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts += [edited(rng, words, 0.012) for _ in range(90)]
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == brute_kept(docs)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """A copy goes and a clean text stays, whatever ids they share."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (None, a)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, a)], key=str)


def test_a_dense_group_below_the_limit_loses_no_link(spark):
    """Many texts that share most of their words, at about 0.7 to 0.78, with a few
    copies among them: the shared part brings no link and no copy is missed."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    base = []
    for i in range(120):
        at = rng.randrange(300)
        base.append(" ".join([*words[:at], *(f"own{i}x{j}" for j in range(rng.randint(48, 70))), *words[at + 60 :]]))
    texts = [*base, *(edited(rng, t.split(), 0.01) for t in base[:40])]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == brute_kept(docs)
    assert 100 < len(got) < 140


def test_copies_too_far_apart_are_seldom_verified(spark, monkeypatch):
    """Copies of one source at about 0.7, short and long ones: bitmaps rule nearly all
    pairs out, and the few true pairs among them stay."""
    rng, asked = random.Random(11), []
    plain = near_copies._by_prefix
    monkeypatch.setattr(near_copies, "_by_prefix", lambda *a: asked.append(near_copies.materialise(plain(*a), "asked")) or asked[-1])
    texts = []
    for words, copies in (([f"w{rng.randrange(10**6)}" for _ in range(300)], 80), ([f"w{rng.randrange(10**6)}" for _ in range(5000)], 20)):
        group = [edited(rng, words, 0.021) for _ in range(copies)]
        texts += group + [edited(rng, t.split(), 0.018) for t in group[::8]]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == brute_kept(docs)
    assert len(got) < len(texts)
    assert asked[0].count() < 400  # of 4,400 pairs
