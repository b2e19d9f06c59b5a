"""Mutual information, tall-skinny QR and the randomised factors against numpy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from shortlane.operators import semantics


def rows_of(spark, x):
    return spark.createDataFrame([(f"w{k}", *map(float, r)) for k, r in enumerate(x)], semantics._schema("word string", x.shape[1]))


def matrix_of(df, n):
    return np.array([[r[c] for c in semantics._columns(n)] for r in sorted(df.collect(), key=lambda r: int(r["word"][1:]))])


@pytest.mark.parametrize("scale", [1.0, 1e-9])
def test_tall_skinny_qr(spark, scale):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    x[:, 5] = x[:, 0] + scale * x[:, 5]  # well and ill conditioned
    rows = rows_of(spark, x).repartition(7)
    r = semantics.triangle(rows, 6)
    assert np.allclose(r.T @ r, x.T @ x) and (np.diag(r) >= 0).all() and np.allclose(r, np.triu(r))
    if scale == 1.0:
        full = np.linalg.qr(x, mode="r")
        assert np.allclose(r, full * np.sign(np.diag(full))[:, None])
        q = matrix_of(semantics.orthonormal(rows, 6, "q"), 6)
        assert np.abs(q.T @ q - np.eye(6)).max() < 1e-12
        assert np.allclose(q @ (q.T @ x), x)  # the same space


def test_rank_below_dimensions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 5))
    q = matrix_of(semantics.orthonormal(rows_of(spark, x), 5, "q"), 5)
    assert np.allclose(np.linalg.svd(q)[1], [1, 1, 0, 0, 0], atol=1e-8)
    assert np.allclose(q @ (q.T @ x), x)


def test_factors_are_numpys(spark):
    """Leading eigenvalues, orthonormal vectors and the error of the best approximation of that rank; reruns agree."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    values = np.array([9, -7, 5, 4, -3, *(0.3 * 0.9 ** np.arange(55))])
    m = basis * values @ basis.T
    triples = spark.createDataFrame([(f"w{i}", f"w{j}", float(m[i, j])) for i in range(60) for j in range(60)], "a string, b string, ppmi double")
    rows, found = semantics.factors(triples, dims=5, extra=6)
    q = matrix_of(rows, 5)
    assert np.allclose(found, values[:5], atol=1e-6)
    assert np.abs(q.T @ q - np.eye(5)).max() < 1e-10
    error = np.linalg.norm(m - q * found @ q.T)
    assert error < np.linalg.norm(values[5:]) * 1.001
    again = semantics.factors(triples.repartition(3), dims=5, extra=6)
    assert np.allclose(again[1], found) and np.allclose(np.abs((matrix_of(again[0], 5) * q).sum(0)), 1)


def brute_ppmi(texts, window, min_docs):
    docs = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    known = {w for w, n in Counter(w for d in docs for w in set(d)).items() if n >= min_docs}
    n = Counter()
    for d in docs:
        for i in range(len(d)):
            for j in range(i + 1, min(i + window + 1, len(d))):
                if d[i] in known and d[j] in known:
                    n[d[i], d[j]] += 1
                    n[d[j], d[i]] += 1
    of = Counter()
    for (a, _), k in n.items():
        of[a] += k
    total = sum(of.values())
    return {(a, b): (k, math.log(k * total / (of[a] * of[b]))) for (a, b), k in n.items() if k * total > of[a] * of[b]}


def test_ppmi(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a a a b b c d e f rare".split(), k=rng.randint(0, 15))) for _ in range(60)] + [None, "", "a", "a a", "Unique words!"]
    got = semantics.ppmi(spark.createDataFrame([(t, 1) for t in texts], "text string, n int"), "text", 3, 2).collect()
    want = brute_ppmi(texts, 3, 2)
    assert {(r["a"], r["b"]): r["n"] for r in got} == {k: n for k, (n, _) in want.items()} and len(got) == len(want)
    assert all(abs(r["ppmi"] - want[r["a"], r["b"]][1]) < 1e-9 for r in got)


def test_pairs_meet_in_slots(spark, monkeypatch):
    """What tasks hand on is rows of slots, not of pairs; with few pairs in a slot, and few held at once, the counts are the same."""
    monkeypatch.setattr(semantics, "SLOT_PAIRS", 7)
    monkeypatch.setattr(semantics, "HELD_PAIRS", 20)
    monkeypatch.setattr(semantics, "MOST_HELD", 5)
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijklm", k=rng.randint(0, 25))) for _ in range(600)] + [None, "", " . "]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = semantics._pairs(frame.select(semantics.job.words(F.col("text")).alias("words")), list("abcdefghijklm"), 3)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(slot" in plan and "hashpartitioning(x" not in plan
    want = brute_ppmi(texts, 3, 1)
    got = semantics.ppmi(frame, "text", 3, 1).collect()
    assert {(r["a"], r["b"]): r["n"] for r in got} == {k: n for k, (n, _) in want.items()} and len(got) == len(want)
    assert all(abs(r["ppmi"] - want[r["a"], r["b"]][1]) < 1e-9 for r in got)


def test_words_of_one_topic_are_near(spark):
    rng = random.Random(5)
    topics = ["gpu tensor kernel cuda", "flour oven yeast dough", "goal striker keeper pitch"]
    docs = [(i, " ".join(rng.choices(topics[i % 3].split() + ["the", "and"], k=30))) for i in range(150)]
    frame = spark.createDataFrame(docs, "id long, text string")
    vectors = semantics.word_vectors(frame, "text", dims=3)
    v = {r["word"]: np.array(r["vector"]) for r in vectors.collect()}
    cos = lambda a, b: v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b]))
    words = [t.split() for t in topics]
    assert min(cos(a, b) for t in words for a in t for b in t) > max(cos(a, b) for t in words for u in words if t != u for a in t for b in u)
    held = {r["id"]: np.array(r["vector"]) for r in semantics.text_vectors(frame, "id", "text", vectors, 3).collect()}
    assert np.allclose(held[0], np.mean([v[w] for w in docs[0][1].split() if w in v], axis=0))


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "text string")
    assert semantics.word_vectors(empty, "text", dims=3).count() == 0


def test_nearest_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(semantics, "BLOCK", 4)
    rng = np.random.default_rng(6)
    x, y = rng.integers(-3, 4, (300, 3)).astype(float), rng.integers(-3, 4, (10, 3)).astype(float)  # ties, zero vectors
    held = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "id long, vector array<double>")
    got = {}
    for r in semantics.nearest(held, asked, 7).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["similarity"]))
    for q, v in enumerate(y):
        if not v.any():
            assert q not in got
            continue
        cos = {i: round(float(r @ v / np.linalg.norm(r) / np.linalg.norm(v)), 3) + 0.0 for i, r in enumerate(x) if r.any()}
        want = sorted(cos, key=lambda i: (-cos[i], i))[:7]
        assert sorted(got[q]) == [(n, i, cos[i]) for n, i in enumerate(want, 1)]
    assert semantics.nearest(held, asked.limit(0), 7).count() == 0


def test_words_do_not_meet_their_vectors_by_a_shuffle(spark):
    """What is shuffled for text vectors, and for a product, goes with texts and words, not with pairs of both."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "z")], "id long, text string")
        vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 4.0])], "word string, vector array<double>")
        found = semantics.text_vectors(texts, "id", "text", vectors, 2)
        product = semantics._product(spark.createDataFrame([("a", "b", 2.0)], "a string, b string, ppmi double"), rows_of(spark, np.eye(2)), 2)
        for df in (found, product):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
        assert {r["id"]: [round(x, 9) for x in r["vector"]] for r in found.collect()} == {1: [0.666666667, 1.333333333], 2: [0.0, 4.0]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
