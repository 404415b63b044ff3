"""Operators that avoid one task or all pairs, against brute force on small tables."""

import itertools
import math
import random
import statistics

from pyspark.sql import functions as F

from loomery.operators import clustering, ranking, rates, records, similarity, trends


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_near_strings_lose_no_pair(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("ab", k=rng.randrange(13))) for _ in range(120)] + ["", "", None, "aaaaaaaaaa", "aaaaaaaaab"]
    rows = [(k, f"g{k % 2}", w) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "k long, g string, t string")
    for ratio in (0.8, 0.6):
        got = {(r.a, r.b, r.a_rows, r.b_rows) for r in clustering.near_strings(df, "k", "g", "t", ratio).collect()}
        classes = {}
        for k, g, t in rows:
            if t is not None:
                classes.setdefault((g, t), []).append(k)
        want = set()
        for ((g, s), ks), ((h, t), ls) in itertools.permutations(classes.items(), 2):
            longest = max(len(s), len(t), 1)
            if g == h and min(ks) < min(ls) and 1 - edit_distance(s, t) / longest >= ratio:
                want.add((min(ks), min(ls), len(ks), len(ls)))
        assert got == want and want


def test_text_similarity_loses_no_pair(spark):
    rng = random.Random(7)
    docs = [(k, " ".join(rng.choices("the a of cat dog sun moon tree".split(), weights=[9, 8, 7, 1, 1, 1, 1, 1], k=6))) for k in range(60)] + [(60, ""), (61, None)]
    df = spark.createDataFrame(docs, "k long, t string")
    weights = similarity.tf_idf(df, "k", F.array_remove(F.split("t", " "), "")).cache()
    table = {}
    for r in weights.collect():
        table.setdefault(r.k, {})[r.word] = r.weight
    for least in (0.3, 0.8):
        found = similarity.text_similarity(weights.withColumnRenamed("k", "a"), weights.withColumnRenamed("k", "b"), "a", "b", least, F.col("a") < F.col("b"))
        got = {(r.a, r.b): r.similarity for r in found.collect()}
        want = {}
        for a, b in itertools.combinations(sorted(table), 2):
            cosine = sum(x * table[b].get(w, 0) for w, x in table[a].items())
            if cosine >= least:
                want[a, b] = cosine
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want)


def test_positions_and_medians(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1.0, 2.0, 7.5]), float(rng.randrange(50))) for k in range(101)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    assert [r.position for r in ranking.positions(df, ["y", "k"]).orderBy("y", "k").collect()] == list(range(101))
    got = dict(ranking.medians(df, ["x", "y"]).collect())
    assert got == {"x": statistics.median(x for _, x, _ in rows if x is not None), "y": statistics.median(y for *_, y in rows)}
    assert ranking.medians(df.limit(0), ["x"]).collect() == [] and ranking.positions(df.limit(0), ["k"]).collect() == []
    empty = records.price_statistics(df.limit(0).select("x"), "x").first()
    assert empty.median is None and empty.average is None


def test_windows_reach_over_slices(spark):
    rng = random.Random(9)
    seconds = sorted(rng.randrange(4000) for _ in range(200)) + [159, 160, 160]
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", s) for i, s in enumerate(seconds)], "i long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r.in_window for r in rates.sliding_rate(df, "k", "ts", 10).collect()}
    rows = [(i, "a" if i % 3 else "b", s) for i, s in enumerate(seconds)]
    assert got == {i: sum(h == k and s - 10 <= t <= s for _, h, t in rows) for i, k, s in rows}


def test_rank_agreement_of_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (4, 0.5)], "k long, score double")
    assert math.isclose(trends.rank_agreement(df, "k", "score").first()[0], (1 / 2 + 1 / 3 + 1 / 3 + 1 / 2) / 4)
