"""Clusters of numeric feature rows, and similarity over shared features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def k_means(df: DataFrame, features: Sequence[str], k: int | None = None, seed: int = 42) -> DataFrame:
    """Add ``cluster``: k-means on standardised features; k is at most five, a third of the rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    if k is None:
        k = max(1, min(5, df.limit(15).count() // 3))
    rows = VectorAssembler(inputCols=list(features), outputCol="__raw", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True).fit(rows).transform(rows)
    if k < 2:
        return scaled.withColumn("cluster", F.lit(0)).drop("__raw", "__scaled")
    model = KMeans(k=k, seed=seed, featuresCol="__scaled", predictionCol="cluster").fit(scaled)
    return model.transform(scaled).drop("__raw", "__scaled")


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Size and feature means of each cluster."""
    return df.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])


def feature_similarity(pairs: Sequence[tuple[Column, Column]], kinds: Sequence[str]) -> Column:
    """Mean over shared features: equality of booleans and strings, one less relative difference of numbers."""
    parts = []
    for (a, b), kind in zip(pairs, kinds, strict=True):
        if kind == "number":
            top = F.greatest(F.abs(a), F.abs(b))
            parts.append(F.when(top == 0, 1.0).otherwise(1 - F.abs(a - b) / top))
        else:
            parts.append(F.when(a == b, 1.0).when(a.isNotNull() & b.isNotNull(), 0.0))
    scored = F.array_compact(F.array(*parts))
    return F.when(F.size(scored) > 0, F.aggregate(scored, F.lit(0.0), lambda s, x: s + x) / F.size(scored)).otherwise(0.0)


def string_classes(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(group, text, key, rows): each different string of a group, its least key, and how many rows hold it."""
    return df.where(F.col(text).isNotNull()).groupBy(F.col(group).alias("group"), F.col(text).alias("text")).agg(F.min(key).alias("key"), F.count("*").alias("rows"))


def near_strings(df: DataFrame, key: str, group: str, text: str, ratio: float = 0.8) -> DataFrame:
    """(a, b, ratio, a_rows, b_rows) of different strings of one group that few edits part, over the longer length.

    ``a`` and ``b`` are least keys of rows that hold the strings (``string_classes`` gives
    the members), so copies meet once. One edit touches two bigrams, so two strings within
    e edits share one of the 2 e + 1 rarest bigrams of each: only such strings meet. A
    string with fewer bigrams than that meets all others of the kind in its group.
    """
    classes = string_classes(df, key, group, text).where(F.col("group").isNotNull())
    edits = F.floor(F.length("text") * ((1 - ratio) / ratio) + 1e-9).cast("int")
    many = F.length("text") - 1
    bigrams = F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(2)))).otherwise(F.array())
    rows = classes.withColumns({"edits": edits, "grams": bigrams})
    # Repeats of a bigram count apart: its first, second, third occurrence.
    grams = rows.select("key", "group", "text", "rows", "edits", F.explode_outer("grams").alias("gram"))
    grams = grams.withColumn("nth", F.row_number().over(Window.partitionBy("group", "key", "gram").orderBy("gram")))
    frequency = grams.groupBy("group", "gram", "nth").agg(F.count("*").alias("frequency"))
    ranked = grams.join(frequency, ["group", "gram", "nth"])
    place = F.row_number().over(Window.partitionBy("group", "key").orderBy("frequency", "gram", "nth"))
    rare = ranked.withColumn("place", place).where(F.col("place") <= 2 * F.col("edits") + 1).select("group", "key", "text", "rows", "gram", "nth")
    few = rows.where((many < 2 * F.col("edits") + 1) & (F.col("edits") > 0)).select("group", "key", "text", "rows", F.lit("").alias("gram"), F.lit(0).alias("nth"))
    met = rare.unionByName(few)
    sides = [met.select("group", "gram", "nth", *[F.col(c).alias(f"{side}_{c}") for c in ("key", "text", "rows")]) for side in ("a", "b")]
    both = sides[0].join(sides[1], ["group", "gram", "nth"])
    longest = F.greatest(F.length("a_text"), F.length("b_text"))
    near = (F.col("a_key") < F.col("b_key")) & (F.least(F.length("a_text"), F.length("b_text")) >= ratio * longest - 1e-9)
    pairs = both.where(near).select("a_key", "b_key", "a_text", "b_text", "a_rows", "b_rows").distinct()
    score = 1 - F.levenshtein("a_text", "b_text") / F.greatest(longest, F.lit(1))
    return pairs.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), score.alias("ratio"), "a_rows", "b_rows").where(F.col("ratio") >= ratio)
