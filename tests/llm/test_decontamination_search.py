"""The fingerprint search of decontamination: whole within its radius, over all items of a window's size."""

import random

from pyspark.sql import functions as F

from loomery.llm import decontamination as dec

DOC = "doc_id long, text string, lang string"


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(6)
    pairs = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(0, 26)):
            b ^= 1 << bit
        pairs.append((i, *(x - (1 << 64) if x >> 63 else x for x in (a, b))))
    frame = spark.createDataFrame(pairs, "i long, a long, b long")
    cut = lambda c: F.explode(dec.blocks(F.col(c), dec.RADIUS + 1)).alias("x")
    left, right = frame.select("i", "a", cut("a")).select("i", "a", "x.*"), frame.select("i", "b", cut("b")).select("i", "b", "x.*")
    got = {r.i for r in left.join(right, ["i", "no", "bits"]).where(dec.hamming(F.col("a"), F.col("b")) <= dec.RADIUS).select("i").distinct().collect()}
    assert got == {i for i, a, b in pairs if bin((a ^ b) & (1 << 64) - 1).count("1") <= dec.RADIUS}


def test_windows_are_searched_among_all_items_of_their_size(spark):
    """The search gets windows without item ids and returns every similar item, not others."""
    rng = random.Random(7)
    base = [rng.getrandbits(62) for _ in range(40)]
    edit = lambda n: [rng.getrandbits(62) if i < n else h for i, h in enumerate(base)]
    items = [(1, 5, 40, base), (2, 5, 40, edit(2)), (3, 5, 40, edit(20)), (4, 5, 40, [rng.getrandbits(62) for _ in range(40)])]
    items = spark.createDataFrame(items, "item_id long, k int, m int, units array<long>").withColumn("fingerprint", dec.simhash(F.col("units")))
    contents = spark.createDataFrame([(1, 1, 5, 40, base), (2, 2, 5, 40, edit(3))], "w1 long, w2 long, k int, m int, units array<long>")
    found = {(r.w1, r.item_id): r.similarity for r in dec.search_windows(contents, items, 0.8, dec.RADIUS, True).collect()}
    assert found.keys() == {(1, 1), (1, 2), (2, 1)} | ({(2, 2)} & found.keys()) and found[1, 1] == 1.0


def test_repeated_rows_and_items_and_very_long_texts(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"x{i % 997}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long + " " + passage, None), (1, long + " " + passage, None), (2, long, "en"), (None, passage, "en"), (3, "", None)], DOC)
    items = spark.createDataFrame([(5, passage), (5, passage), (6, "tiny"), (7, None)], "item_id long, text string")
    leaks = dec.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(1, 5), (None, 5)} and max(r.similarity for r in leaks) == 1.0
    assert sorted(r.doc_id for r in dec.decontaminate(docs, items).collect()) == [2, 3]


def test_seeds_are_rare_in_the_documents(spark):
    """A shingle that every document holds is not what windows are laid at."""
    common = "this line stands in every text"
    rare = " ".join(f"r{i}" for i in range(24))
    items = dec.benchmark_items(spark.createDataFrame([(1, f"{common} {rare}")], "item_id long, text string"))
    held = items.select("k", F.posexplode("units").alias("pos", "hash"))
    many = held.where("pos < 2").crossJoin(spark.range(50)).drop("id").unionByName(held)
    assert dec.seeds_of(items, many, 0.8).agg(F.min("at")).first()[0] >= 2
