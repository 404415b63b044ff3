"""How quality filters interact: who removes what under every order of application.

A relational word pipeline. Texts are dealt by row once, so that exploding them into
words, counting each (row, word) and summing up each row needs no further shuffle;
the other flags (shouting, symbols, copies of an earlier text) join by row. A row's
failures are a bit mask, and 32 conditional counts for each part hold all there is
to know: every order, step and Shapley share is a sum over masks.

Hot keys: rows, not document ids, deal the words, so repeated ids don't meet; texts
meet by checksum for their least document id with partial aggregation, and the groups
that hold over a 2,000th of all rows (at most 2,000 of them) come back by broadcast,
the rest by a shuffle in which rows of large groups get keys of their own; labels join
after equal (id, part, mask) rows are counted together.

Row numbers follow the order in which the table is read, so ``docs`` has to come from
storage (or a checkpoint), where a repeated read gives the same order.

Defined cases: a null text is empty; an empty text fails filter A alone (and E beside
other empty texts); texts of any length are read whole; repeated rows count as often
as they occur and are no copies of each other, as their ids are equal; a row without a
document id is nobody's copy and has no labels; a null part belongs to the empty one;
an id that is labelled twice has a mark if any of its rows has it; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.session import durable

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
#: Groups of copies that hold more than this share of all rows are broadcast; so at most its inverse of them.
HEAVY = 1 / 2000


def word_totals(rows: DataFrame) -> DataFrame:
    """(row, n_words, n_distinct) of rows (row, text); a row without words is absent."""
    words = rows.select("row", "text").repartition("row").select("row", F.explode(F.split("text", _SPACE)).alias("word")).where("word <> ''")
    counted = words.groupBy("row", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("row").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def copies(rows: DataFrame) -> DataFrame:
    """(row, doc_id, part, shouts, marked, copy): ``copy`` where a smaller document id has the same text."""
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    shouts, marked = 100 * capitals > 2 * F.length("text").cast("long"), F.col("text").rlike("[#$%&*|]")
    other = rows.select("row", "doc_id", "part", shouts.alias("shouts"), marked.alias("marked"), F.unhex(F.sha2("text", 256)).alias("sum"))
    groups = other.groupBy("sum").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    repeated = durable(groups.where("least < most").select("sum", "least", "n"))
    bound = F.lit(HEAVY * rows.count())
    heavy = repeated.where(F.col("n") > bound).select(F.col("sum").alias("heavy"), F.col("least").alias("heavy_least"))
    light = repeated.where(F.col("n") <= bound).select(F.col("sum").alias("key"), "least")
    known = other.join(F.broadcast(heavy), F.col("sum") == F.col("heavy"), "left")
    # Rows that have met their group get keys of their own, shorter than any checksum.
    known = known.withColumn("key", F.when(F.col("heavy").isNull(), F.col("sum")).otherwise(F.encode(F.col("row").cast("string"), "utf-8")))
    first = F.coalesce("heavy_least", "least")
    return known.join(light, "key", "left").select("row", "doc_id", "part", "shouts", "marked", F.coalesce(F.col("doc_id") > first, F.lit(False)).alias("copy"))


def failure_masks(docs: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, part, mask), one row for each of ``docs``; bit n of the mask says that it fails filter n of ``FILTERS``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = copies(rows).join(word_totals(rows), "row", "full_outer")
    words, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = (words < 200, 100 * distinct < 50 * words, F.col("shouts"), F.col("marked"), F.col("copy"))
    mask = sum((F.when(f, 1 << n).otherwise(0) for n, f in enumerate(fails)), F.lit(0))
    return joined.select("doc_id", "part", mask.alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part: documents, good ones and toxic ones by mask, as three arrays of 32 counts."""
    counted = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = counted.join(marks, "doc_id", "left")

    def counts(of: str) -> Column:
        return F.expr(", ".join(f"coalesce(sum(if(mask = {m} AND {of}, n, 0)), 0L)" for m in range(1 << len(FILTERS))).join(("array(", ")")))

    return known.groupBy("part").agg(counts("true").alias("all"), counts("good").alias("good"), counts("toxic").alias("toxic"))


def _steps() -> Column:
    """Every step of every order: its name, number, filter and the mask of the filters before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[n] for n in order)
        out += [{"filter_order": name, "step": k + 1, "own": 1 << n, "before": sum(1 << m for m in order[:k])} for k, n in enumerate(order)]
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order: string, step: int, own: int, before: int>>")


def _total(counts: str, amount: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.transform(counts, amount), F.lit(0).cast("long"), lambda a, x: a + x)


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The contract's table: one row for each part, order of the filters and step."""
    counts = mask_counts(failure_masks(docs, part), labels)
    steps = counts.select("*", F.inline(_steps()))
    own, before = F.col("own"), F.col("before")

    def where(test: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
        return lambda n, m: F.when(test(m), n).otherwise(0)

    fails, earlier = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) != 0
    here = where(lambda m: fails(m) & ~earlier(m))
    # Of all orders, one in as many as a document's failures has this filter first among them.
    share = where(fails)
    orders = factorial(len(FILTERS))
    return steps.select(
        "part", "filter_order", "step",
        _total("all", where(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0)).alias("kept"),
        _total("all", here).alias("removed"),
        _total("all", where(lambda m: fails(m) & earlier(m))).alias("redundant"),
        _total("all", where(lambda m: m == own)).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        _total("all", lambda n, m: share(n, m) * F.floor(F.lit(orders) / F.greatest(F.bit_count(m), F.lit(1)))).alias("shapley"),
    )
