"""Profiles, statistics and comparisons of record sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators.ranking import medians

#: Price columns by precedence, and the word lists of the sentiment share.
PRICE_COLUMNS = ("price", "cost", "amount", "total", "value")
POSITIVE = ("good", "great", "excellent", "amazing", "love", "best", "wonderful", "fantastic")
NEGATIVE = ("bad", "poor", "terrible", "hate", "worst", "awful", "horrible", "disappointing")
#: Entity patterns.
ENTITIES = {
    "organizations": r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Inc|Corp|LLC|Ltd|Company|Co)\b",
    "prices": r"\$[\d,]+\.?\d*|\d+\.?\d*\s*(?:USD|EUR|GBP)",
    "dates": r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "urls": r"https?://[^\s]+",
    "numbers": r"\b\d+\.?\d*\b",
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal")]


def price_column(df: DataFrame) -> str | None:
    return next((c for c in (*PRICE_COLUMNS, *numeric_columns(df)) if c in df.columns), None)


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column, in one pass: field, count, mean, median, min, max, std_dev, sum.

    The median is exact, by counts of values summed over sorted ranges, which shuffles
    the distinct values; ``approx_profile`` needs one pass and no such shuffle.
    """
    rest = _profile(df, columns, lambda c: F.lit(None))
    exact = medians(df, list(columns or numeric_columns(df)))
    return rest.drop("median").join(F.broadcast(exact), "field", "left").select(*rest.columns)


def approx_profile(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Like ``numeric_profile`` with a bounded-memory median."""
    return _profile(df, columns, lambda c: F.percentile_approx(c, 0.5, accuracy))


def _profile(df: DataFrame, columns: Sequence[str] | None, median) -> DataFrame:
    names = list(columns or numeric_columns(df))
    parts = []
    for n in names:
        c = F.col(n).cast("double")
        parts.append(F.struct(F.lit(n).alias("field"), F.count(c).alias("count"), F.avg(c).alias("mean"), median(c).cast("double").alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std_dev"), F.sum(c).alias("sum")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def group_share(df: DataFrame, by: str) -> DataFrame:
    """Rows and percentage of each group."""
    counts = df.groupBy(by).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(by, "count", (F.col("count") / F.col("total") * 100).alias("percentage"))


def price_statistics(df: DataFrame, price: str | None = None, by: str | None = None) -> DataFrame:
    """Average, median, min, max, range and deviation of all prices, or average, min, max and count by group."""
    name = price or price_column(df)
    if name is None:
        raise ValueError("no price column")
    c = F.col(name).cast("double")
    if by:
        return df.where(c.isNotNull()).groupBy(by).agg(F.avg(c).alias("average"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("count"))
    exact = medians(df.select(c.alias("price")), ["price"]).agg(F.max("median").alias("median"))
    row = df.agg(F.avg(c).alias("average"), F.min(c).alias("min"), F.max(c).alias("max"), (F.max(c) - F.min(c)).alias("range"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std_dev"))
    return row.join(F.broadcast(exact)).select("average", "median", "min", "max", "range", "std_dev")


def histogram(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """bin, label and count over equal-width bins; an edge belongs to the lower bin, equal values form one bin."""
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    edge = lambda i: F.col("lo") + i * width
    place = sum(((c > edge(i)).cast("int") for i in range(1, bins)), F.lit(0))
    rows = df.where(c.isNotNull()).join(F.broadcast(ends)).select(F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(place).alias("bin"))
    counts = rows.groupBy("bin").agg(F.count("*").alias("n"))
    grid = ends.where(F.col("lo").isNotNull()).select("lo", "hi", F.explode(F.when(F.col("lo") == F.col("hi"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    low, high = edge(F.col("bin")), edge(F.col("bin") + 1)
    label = F.when(F.col("lo") == F.col("hi"), "single_value").otherwise(F.format_string("$%.0f-$%.0f", low, high))
    return grid.select("bin", label.alias("label")).join(F.broadcast(counts), "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("count"))


def entities(df: DataFrame, text: Column, types: Sequence[str] | None = None) -> DataFrame:
    """(entity_type, value) of every match in every row; only the patterns of the wanted ``types`` run."""
    found = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("v")) for k, p in ENTITIES.items() if types is None or k in types])
    return df.select(F.explode(found).alias("e")).select("e.entity_type", F.explode("e.v").alias("value"))


def entity_frequency(df: DataFrame, text: Column, top: int = 5, types: Sequence[str] | None = None) -> DataFrame:
    """Per type: how many distinct values, and the most frequent ones with their counts (ties by value)."""
    counts = entities(df, text, types).groupBy("entity_type", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("entity_type").orderBy(F.desc("n"), "value")
    distinct = counts.groupBy("entity_type").agg(F.count("*").alias("n_distinct"))
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(distinct, "entity_type").select("entity_type", "n_distinct", "rank", "value", "n")


def sentiment(text: Column) -> Column:
    """positive, negative or neutral, by which list has more of its words in the text."""
    low = F.lower(text)
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.when(hits(POSITIVE) > hits(NEGATIVE), "positive").when(hits(NEGATIVE) > hits(POSITIVE), "negative").otherwise("neutral")


def sentiment_share(df: DataFrame, text: Column) -> DataFrame:
    """Counts and percentages of the three labels, one row each."""
    labels = df.select(F.coalesce(sentiment(text), F.lit("neutral")).alias("label"))
    total = F.greatest(F.count("*"), F.lit(1))
    parts = [F.struct(F.lit(x).alias("label"), F.count_if(F.col("label") == x).alias("count"), (F.count_if(F.col("label") == x) / total * 100).alias("percentage")) for x in ("positive", "negative", "neutral")]
    return labels.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def data_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Completeness, missing, distinct values, uniqueness and their score for each column.

    One pass of aggregation for the counts; distinct values are counted exactly, by
    (column, value) pairs with partial aggregation.
    """
    names = list(columns or df.columns)
    values = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names])
    pairs = df.select(F.explode(values).alias("x")).select("x.*").groupBy("field", "value").agg(F.count("*").alias("n"))
    missing = F.col("value").isNull() | (F.col("value") == "")
    out = pairs.groupBy("field").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("missing"), F.count_if(~missing).alias("distinct"))
    complete, unique = (F.col("total") - F.col("missing")) / F.col("total") * 100, F.col("distinct") / F.col("total") * 100
    return out.select("field", complete.alias("completeness"), F.col("missing").alias("missing_count"), F.col("distinct").alias("unique_values"), unique.alias("uniqueness_ratio"), ((complete + F.least(unique, F.lit(100.0))) / 2).alias("quality_score"))


def frequency(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent values with count and percentage, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    total = df.agg(F.count(column).alias("total"))
    return counts.orderBy(F.desc("count"), "value").limit(top).join(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("total") * 100).alias("percentage"))


def anomalies(df: DataFrame, column: str, threshold: float = 2.0) -> DataFrame:
    """Rows whose z-score exceeds the threshold; none below three values or without spread."""
    c = F.col(column).cast("double")
    stats = df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.count(c).alias("n"))
    scored = df.join(F.broadcast(stats)).withColumn("z_score", F.when((F.col("n") >= 3) & (F.col("std") > 0), F.abs((c - F.col("mean")) / F.col("std"))))
    return scored.where(F.col("z_score") > threshold).drop("mean", "std", "n")


def trend(df: DataFrame, column: str, order: Sequence[str], by: str) -> DataFrame:
    """Per series: the means of its halves, the trend they show, and the change from first to last value."""
    w = Window.partitionBy(by).orderBy(*order)
    c = F.col(column).cast("double")
    rows = df.where(c.isNotNull()).select(by, c.alias("v"), F.row_number().over(w).alias("at"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    half = F.floor(F.col("n") / 2)
    out = rows.groupBy(by, "n").agg(F.avg(F.when(F.col("at") <= half, F.col("v"))).alias("first_avg"), F.avg(F.when(F.col("at") > half, F.col("v"))).alias("second_avg"), F.max(F.when(F.col("at") == 1, F.col("v"))).alias("start_value"), F.max(F.when(F.col("at") == F.col("n"), F.col("v"))).alias("end_value"))
    name = F.when(F.col("second_avg") > F.col("first_avg") * 1.1, "increasing").when(F.col("second_avg") < F.col("first_avg") * 0.9, "decreasing").otherwise("stable")
    change = F.col("end_value") - F.col("start_value")
    return out.where("n >= 2").select(by, name.alias("trend"), "start_value", "end_value", change.alias("total_change"), F.when(F.col("start_value") != 0, change / F.col("start_value") * 100).otherwise(0.0).alias("change_rate_percent"), F.col("n").alias("data_points"))


def compare(left: DataFrame, right: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Common keys with both values, difference and percent change of each metric, plus keys of one side only (``side``)."""
    a = left.select(key, *[F.col(m).alias(f"{m}_dataset1") for m in metrics], F.lit(True).alias("__l"))
    b = right.select(key, *[F.col(m).alias(f"{m}_dataset2") for m in metrics], F.lit(True).alias("__r"))
    both = a.join(b, key, "full")
    cols = [F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "only_in_1").otherwise("only_in_2").alias("side")]
    for m in metrics:
        x, y = F.col(f"{m}_dataset1"), F.col(f"{m}_dataset2")
        cols += [x, y, (y - x).alias(f"{m}_difference"), F.when(x != 0, (y - x) / x * 100).alias(f"{m}_percent_change")]
    return both.select(key, *cols)
