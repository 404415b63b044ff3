"""Confidence, deduplication and merging of extraction results: rows of (key, field, value, source, confidence)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import has_any


def completeness(values: Sequence[Column]) -> Column:
    """Share of non-blank values."""
    filled = sum((F.when(F.length(F.trim(v.cast("string"))) > 0, 1).otherwise(0) for v in values), F.lit(0))
    return filled / len(values) if values else F.lit(0.0)


def extraction_confidence(values: Sequence[Column]) -> Column:
    """Completeness at .7 and mean value quality at .3: a string longer than two characters counts 1, a shorter one .3."""
    given = [F.when(F.length(F.trim(v.cast("string"))) > 0, F.when(F.length(v.cast("string")) > 2, 1.0).otherwise(0.3)) for v in values]
    scored = F.array_compact(F.array(*given))
    mean = F.when(F.size(scored) > 0, F.aggregate(scored, F.lit(0.0), lambda a, x: a + x) / F.size(scored)).otherwise(0.0)
    return 0.7 * completeness(values) + 0.3 * mean


def strategy_score(confidence: Column, n_fields: Column, seconds: Column) -> Column:
    return F.least(confidence + F.least(0.1 * n_fields, F.lit(0.3)) + F.greatest(F.lit(0.0), 0.2 - seconds / 10), F.lit(1.0))


def extraction_quality(complete: Column, confidence: Column, analysis: Column) -> Column:
    return 0.4 * complete + 0.3 * confidence + 0.3 * analysis


def efficiency(success_rate: Column, seconds: Column) -> Column:
    """Success per minute of mean time."""
    return success_rate / F.nullif(seconds / 60, F.lit(0.0))


def field_weight(base: Column, confidence: Column, value: Column) -> Column:
    return base + 0.5 * confidence + F.least(F.length(value) / 100, F.lit(0.3))


def distinct_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    value = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("__key")).agg(F.min_by(value, F.col(order)).alias("row")).select("row.*")


def best_confidence(df: DataFrame, keys: Sequence[Column], confidence: str, tie: str) -> DataFrame:
    """For each key the row of highest confidence, the first on a tie."""
    value = F.struct(*[F.col(c) for c in df.columns])
    names = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*names).agg(F.min_by(value, F.struct(-F.col(confidence), F.col(tie))).alias("row")).select("row.*")


def merge_by_priority(df: DataFrame, key: str, field: str, value: str, priority: str) -> DataFrame:
    """For each key and field the first non-blank value by priority."""
    given = df.where(F.length(F.trim(F.col(value))) > 0)
    return given.groupBy(key, field).agg(F.min_by(value, priority).alias(value))


def merge_by_weight(df: DataFrame, key: str, field: str, value: str, weight: str) -> DataFrame:
    """For each key and field the value of highest weight, the least value on a tie, and how many values disagreed."""
    given = df.where(F.length(F.trim(F.col(value))) > 0)
    return given.groupBy(key, field).agg(F.min_by(value, F.struct(-F.col(weight), F.col(value))).alias(value), (F.count_distinct(value) - 1).alias("conflicts"))


def missing_fields(df: DataFrame, key: str, field: str, wanted: Sequence[str]) -> DataFrame:
    """(key, missing): wanted fields that a key lacks."""
    have = df.groupBy(key).agg(F.collect_set(field).alias("have"))
    return have.select(key, F.explode(F.array_except(F.array(*map(F.lit, wanted)), "have")).alias("missing"))


def complexity(points: Column) -> Column:
    return F.when(points >= 6, "high").when(points >= 3, "medium").otherwise("low")


def score_buckets(df: DataFrame, score: str) -> DataFrame:
    """Total, mean, maximum, minimum, and scores in [.8, 1], [.5, .8) and below."""
    s = F.col(score)
    return df.agg(F.count(s).alias("total"), F.avg(s).alias("average"), F.max(s).alias("highest"), F.min(s).alias("lowest"), F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.5) & (s < 0.8)).alias("medium"), F.count_if(s < 0.5).alias("low"))


def content_class(text: Column, classes: dict[str, Sequence[str]], default: str) -> Column:
    """The first class one of whose words occurs in the text."""
    out = None
    for name, words in classes.items():
        out = F.when(has_any(F.lower(text), words), name) if out is None else out.when(has_any(F.lower(text), words), name)
    return out.otherwise(default) if out is not None else F.lit(default)
