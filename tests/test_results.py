"""Greedy clusters against all similarities, and edges of choosing among results."""

import itertools
import math
import random

from pyspark.sql import functions as F

from loomery.operators import matching, page_fields, paragraphs, strategies


def test_greedy_clusters_equal_all_similarities():
    rng = random.Random(11)
    texts = [" ".join(rng.choices("red blue green stone river cloud".split(), k=5)) for _ in range(40)] + ["", "the of"]
    vectors = paragraphs.weights(texts, frozenset(paragraphs.STOP))
    assert all(not v or math.isclose(sum(x * x for x in v.values()), 1) for v in vectors)
    alike = {(a, b): sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()) for a, b in itertools.product(range(len(texts)), repeat=2)}
    used, want = set(), []
    for a in range(len(texts)):
        if a not in used:
            members = [a] + [b for b in range(len(texts)) if b != a and b not in used and alike[a, b] >= 0.3]
            used.update(members)
            want.append(members)
    assert [m for m, _ in paragraphs.greedy(vectors, 0.3)] == want


def test_clusters_of_odd_pages(spark):
    long_word = "x" * 10000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>too short</p>"), (4, f"<p>{(long_word + ' ') * 12}</p>")], "k long, html string")
    assert [(r.k, r.place, r.members) for r in paragraphs.clusters(df, "k").collect()] == [(4, 1, [0])]
    assert paragraphs.clusters(df.limit(0), "k").collect() == []


def test_results_without_success(spark):
    df = spark.createDataFrame([("a", "css", 1, False, 0.5, 0, 1.0), ("a", "llm", 2, False, 0.6, 0, 1.0), ("b", "css", 1, False, 0.5, 0, 1.0), ("b", "llm", 2, True, 0.4, 3, 1.0), ("b", "x", 3, True, 0.9, 1, 1.0)], "k string, strategy string, position int, ok boolean, confidence double, n_fields int, seconds double")
    got = {r.k: (r.strategy, r.attempts) for r in strategies.first_success(df, "k").collect()}
    assert got == {"a": ("llm", 2), "b": ("llm", 2)}
    assert strategies.first_success(df.limit(0), "k").collect() == []


def test_null_texts_match_nothing(spark):
    df = spark.createDataFrame([(None,), ("Alpha beta",)], "t string")
    found = df.select(matching.keyword_matches(F.col("t"), {"a": ("alpha", "zzz"), "b": ("q",)}).alias("m"), page_fields.captchas(F.col("t")).alias("c")).collect()
    assert [[(m.tool, m.score) for m in r.m] for r in found] == [[], [("a", 0.4)]] and [r.c for r in found] == [[], []]
