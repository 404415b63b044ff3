"""Statistics of keys in order, cut into ranges, against plain windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators import key_sequences


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    # One key holds most rows, one is null, and values are missing at times.
    data = [(i, rng.choice(["hot"] * 12 + ["a", "b", None]), rng.randrange(50), rng.choice([None, *range(9)])) for i in range(600)]
    return spark.createDataFrame(data, "id long, k string, at int, v int").repartition(3)


def plain(df, order=("id",)):
    return {r.id: tuple(r[c] for c in df.columns if c not in ("id", "k", "at", "v")) for r in df.collect()}


def test_running(rows):
    kinds = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", "k", "at", "v", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    assert plain(key_sequences.running(rows, "k", ["at", "id"], kinds)) == plain(want)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_trailing(rows, size, monkeypatch):
    monkeypatch.setattr(key_sequences, "SLICE", 2)
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(1 - size, 0)
    want = rows.select("id", "k", "at", "v", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"))
    got = key_sequences.trailing(rows, "k", ["at", "id"], {"s": ("sum", F.col("v")), "n": ("count", F.col("v"))}, size)
    assert plain(got) == plain(want) and got.count() == 600


def test_exponential(spark, rows):
    filled = rows.fillna(0, ["v"])
    want = {}
    for r in sorted(filled.collect(), key=lambda r: (r["at"], r.id)):
        want[r.k] = r.v if r.k not in want else want[r.k] * 0.8 + r.v * 0.2
    got = {r.k: r.ema for r in key_sequences.exponential(filled, "k", ["at", "id"], "v", 0.2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert key_sequences.exponential(filled.where("false"), "k", ["at", "id"], "v", 0.2).count() == 0
