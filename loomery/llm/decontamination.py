"""Benchmark decontamination by SimHash of item-sized windows, in SQL functions only.

A text's words are lower-case runs of letters and digits; its features are hashes
of five-word shingles. Windows have the size of a benchmark item and are laid where a
text holds one of the item's shingles that are rarest in the documents: so many of
these are seeds that a window of similarity ``similarity`` must hold at least one
(prefix filtering), and windows are also shifted by as many words as insertions could
move them, so laying windows loses nothing. Where a window was laid for one item, it
is searched among all of its size: each different window gets a 64-bit SimHash
fingerprint, weighted by how often a shingle occurs, and ``radius + 1`` blocks of bits,
joined on size, block number and bits, find every item's fingerprint within
``radius``. Those candidates are verified by the exact weighted Jaccard similarity.

Positions of benchmark shingles are found in one pass over the texts and carry no
array; equal windows of many documents are searched and verified once. What is
broadcast is counted first; beyond the limit the same joins shuffle. Defined cases:
null and empty texts or items match nothing; an item of fewer than five words is
matched as one whole shingle; whole texts are read; rows with one doc_id are one
document, an item that repeats is one item; an empty documents or benchmark table
gives no leaks; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.columns import bind
from loomery.session import durable

WORDS, SIMILARITY, RADIUS, BITS = 5, 0.8, 20, 64
#: Rows of shingles, seeds or windows that may be broadcast: at about 50 bytes each, 50 MB.
MOST_BROADCAST = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, size: Column | int) -> Column:
    """Hashes of all runs of ``size`` words; empty if there are fewer."""
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def _positions(text: Column, sizes: list[int]) -> tuple[list[Column], Column]:
    """Columns k, pos, hash and the generator they come from: shingles of all ``sizes``; the words are split once."""
    if len(sizes) == 1:
        # The outer forms keep the optimizer from computing the shingles a second time, in a filter.
        return [F.lit(sizes[0]).alias("k"), F.col("pos"), F.col("x").alias("hash")], F.posexplode_outer(bind(words_of(text), lambda w: shingles(w, sizes[0]))).alias("pos", "x")
    at = lambda w, k: F.transform(shingles(w, k), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), h.alias("hash")))
    return [F.col("x.k"), F.col("x.pos"), F.col("x.hash")], F.explode_outer(bind(words_of(text), lambda w: F.concat(*[at(w, k) for k in sizes]))).alias("x")


def simhash(units: Column) -> Column:
    """Sign of each bit's vote; a unit that occurs twice votes twice."""
    one, places = F.lit(1).cast("long"), F.sequence(F.lit(0), F.lit(BITS - 1))

    def votes(b: Column) -> Column:
        return F.aggregate(units, F.lit(0).cast("long"), lambda a, u: a + F.call_function("shiftrightunsigned", u, b).bitwiseAND(one))

    return F.aggregate(places, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(votes(b) * 2 > F.size(units), F.call_function("shiftleft", one, b)).otherwise(0)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks(fingerprint: Column, count: int) -> Column:
    """array<struct<no,bits>>: the fingerprint cut into ``count`` blocks; two within count - 1 bits agree in one."""
    edges = [round(i * BITS / count) for i in range(count + 1)]
    cut = [F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << b - a) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.array(*cut)


def weighted_jaccard(x: Column, y: Column) -> Column:
    """Exact, with occurrences as weights."""
    plain = F.size(F.array_intersect(x, y))
    counted = F.aggregate(F.transform(F.array_distinct(x), lambda h: F.least(F.size(F.filter(x, lambda u: u == h)), F.size(F.filter(y, lambda u: u == h)))), F.lit(0), lambda a, n: a + n)
    repeats = (F.size(F.array_distinct(x)) < F.size(x)) | (F.size(F.array_distinct(y)) < F.size(y))
    common = F.when(repeats, counted).otherwise(plain)
    return common / (F.size(x) + F.size(y) - common)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, k, m, units, fingerprint); items without words drop out."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates()
    sized = words.select("item_id", "w", F.least(F.size("w"), F.lit(WORDS)).alias("k"))
    items = sized.select("item_id", "k", shingles(F.col("w"), F.col("k")).alias("units"))
    return items.select("item_id", "k", F.size("units").alias("m"), "units", simhash(F.col("units")).alias("fingerprint"))


def seeds_of(items: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(k, hash, at, m): each item's shingles that are rarest in the documents, enough that a similar window holds one; without item ids."""
    each = items.select("item_id", "units", "k", "m", F.posexplode("units").alias("at", "hash"))
    known = held.groupBy("k", "hash").agg(F.count("*").alias("df"))
    order = Window.partitionBy("item_id", "units").orderBy(F.coalesce("df", F.lit(0)), "hash", "at")
    chosen = each.join(known, ["k", "hash"], "left").withColumn("n", F.row_number().over(order))
    return chosen.where(F.col("n") <= F.col("m") - F.ceil(F.col("m") * similarity) + 1).select("k", "hash", "at", "m").distinct()


def lay_windows(base: DataFrame, held: DataFrame, seeds: DataFrame, similarity: float, sizes: list[int], few: bool) -> DataFrame:
    """(doc_id, text_hash, k, m, start, units): item-sized windows around the seeds that a text holds."""
    hits = held.join(F.broadcast(seeds) if few else seeds, ["k", "hash"])
    # How far insertions or deletions can shift a similar window against its seed, plus one word.
    slack = (F.floor((F.col("m") - F.ceil(F.col("m") * similarity)) / 4) + 1).cast("int")
    start = (F.col("pos") - F.col("at")).cast("int")
    shifts = F.sequence(F.greatest(start - slack, F.lit(0)), F.greatest(start + slack, F.lit(0)))
    places = hits.select("doc_id", "text_hash", "k", "m", F.explode(shifts).alias("start")).distinct()
    of_text = durable(places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("k", "m", "start")).alias("places")))
    total = of_text.agg(F.sum(F.size("places"))).first()[0] or 0
    key = F.col("b.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("b.text_hash") == F.col("p.text_hash"))
    texts = base.alias("b").join((F.broadcast(of_text) if total <= MOST_BROADCAST else of_text).alias("p"), key).select("b.doc_id", "b.text_hash", "b.text", "p.places")

    def windows(k: int) -> DataFrame:
        cut = lambda h: F.transform(F.filter("places", lambda x: x["k"] == k), lambda x: F.struct(x["k"].alias("k"), x["m"].alias("m"), x["start"].alias("start"), F.slice(h, x["start"] + 1, x["m"]).alias("units")))
        laid = texts.select("doc_id", "text_hash", F.explode(bind(words_of(F.col("text")), lambda w: bind(shingles(w, k), cut))).alias("x"))
        return laid.select("doc_id", "text_hash", "x.*").where(F.size("units") > 0)

    return reduce(DataFrame.unionByName, [windows(k) for k in sizes])


def search_windows(contents: DataFrame, items: DataFrame, similarity: float, radius: int, few: bool) -> DataFrame:
    """(w1, w2, item_id, similarity) for different windows (w1, w2, k, m, units): blocks find the fingerprints within ``radius``, exact similarity decides."""
    contents = contents.withColumn("fingerprint", simhash(F.col("units")))
    send = F.broadcast if few else lambda df: df
    left = contents.select("w1", "w2", "k", "m", "fingerprint", F.explode(blocks(F.col("fingerprint"), radius + 1)).alias("b"))
    right = items.select("item_id", "k", "m", F.xxhash64("units").alias("of"), F.col("fingerprint").alias("own"), F.explode(blocks(F.col("fingerprint"), radius + 1)).alias("b"))
    flat = lambda df: df.withColumns({"no": F.col("b.no"), "bits": F.col("b.bits")}).drop("b")
    near = flat(left).join(send(flat(right)), ["k", "m", "no", "bits"]).where(hamming(F.col("fingerprint"), F.col("own")) <= radius).select("w1", "w2", "item_id", "of").distinct()
    found = near.join(contents.select("w1", "w2", "units"), ["w1", "w2"]).join(send(items.select("item_id", F.xxhash64("units").alias("of"), F.col("units").alias("goal"))), ["item_id", "of"])
    scored = found.withColumn("similarity", weighted_jaccard(F.col("units"), F.col("goal"))).where(F.col("similarity") >= similarity)
    return scored.groupBy("w1", "w2", "item_id").agg(F.max("similarity").alias("similarity"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, similarity): windows of documents that hold a benchmark item."""
    items = durable(benchmark_items(benchmark))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, similarity double")
    known = durable(items.select("k", F.explode("units").alias("hash")).distinct())
    few = known.count() <= MOST_BROADCAST // (radius + 1)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    columns, placed = _positions(F.col("text"), sizes)
    placed = base.select("doc_id", "text_hash", placed).select("doc_id", "text_hash", *columns)
    held = durable(placed.join(F.broadcast(known) if few else known, ["k", "hash"]))
    seeds = durable(seeds_of(items, held, similarity))
    windows = lay_windows(base, held, seeds, similarity, sizes, few)
    windows = durable(windows.withColumns({"w1": F.xxhash64("k", "m", "units"), "w2": F.xxhash64("units", F.lit(1))}))
    contents = durable(windows.groupBy("w1", "w2", "k", "m").agg(F.first("units").alias("units")))
    matched = durable(search_windows(contents, items, similarity, radius, few))
    small = matched.count() <= MOST_BROADCAST
    return windows.select("doc_id", "w1", "w2", "start").join(F.broadcast(matched) if small else matched, ["w1", "w2"]).select("doc_id", "item_id", "start", "similarity").distinct()


def leaks_by_document(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated doc_id: doc_id, items (sorted item ids), similarity (highest)."""
    leaks = find_leaks(docs, benchmark, **options)
    return leaks.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without a benchmark passage, with all their columns."""
    leaks = leaks_by_document(docs, benchmark, **options).select("doc_id").alias("l")
    return docs.alias("d").join(leaks, F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), "left_anti")
