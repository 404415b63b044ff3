"""Choosing among and merging results of several extraction strategies.

A result row is (key, strategy, position, ok, confidence, n_fields, seconds); a key has a
handful of strategies, so each function is one aggregation by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators.merging import strategy_score
from loomery.operators.reports import labels_where

#: Structured types by purpose, fallbacks by strategy.
STRUCTURED_TYPES = {
    "product_data": ("Product",),
    "company_info": ("Organization", "LocalBusiness"),
    "news_content": ("Article",),
    "contact_discovery": ("Organization", "LocalBusiness"),
    "business_listings": ("LocalBusiness", "Organization"),
}
ANY_STRUCTURED_TYPE = ("Product", "Organization", "Article")
FALLBACKS = {
    "css_extraction": ("llm_extraction",),
    "llm_extraction": ("css_extraction",),
    "json_css_hybrid": ("llm_extraction", "css_extraction"),
    "regex_extraction": ("css_extraction", "llm_extraction"),
    "form_automation": ("llm_extraction",),
}
ANY_FALLBACK = ("llm_extraction",)


def first_success(results: DataFrame, key: str) -> DataFrame:
    """The first success of each key by position, else its last result, and how many were tried until then."""
    row = F.struct(*[F.col(c) for c in results.columns if c != key])
    chosen = F.coalesce(F.min_by(row, F.when(F.col("ok"), F.col("position"))), F.max_by(row, "position"))
    out = results.groupBy(key).agg(chosen.alias("row"), F.collect_list("position").alias("tried"))
    return out.select(key, "row.*", F.size(F.filter("tried", lambda x: x <= F.col("row.position"))).alias("attempts"))


def first_strategies(results: DataFrame, key: str, most: int = 5) -> DataFrame:
    """All results of the first ``most`` strategies of each key."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("place") <= most)


def best_of_confident(results: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Of each key's ``most`` strategies of highest confidence the result of best score; ties go to the earlier one."""
    score = strategy_score(F.col("confidence"), F.col("n_fields"), F.col("seconds"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "position"))
    tried = results.withColumns({"place": place, "score": F.when(F.col("ok"), score).otherwise(0.0)}).where(F.col("place") <= most)
    value = F.struct(*[F.col(c) for c in results.columns if c != key], "score")
    return tried.groupBy(key).agg(F.min_by(value, F.struct(-F.col("score"), F.col("place"))).alias("row")).select(key, "row.*")


def collaboration_order(results: DataFrame, key: str, raised: str = "css", by: float = 0.1) -> DataFrame:
    """Add ``place``: strategies by confidence, those named ``raised`` a tenth higher, ties by position."""
    own = F.col("confidence") + F.when(F.contains("strategy", F.lit(raised)), by).otherwise(0.0)
    return results.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(own.desc(), "position")))


def filled_in_order(fields: DataFrame, key: str, place: str = "place") -> DataFrame:
    """(key, field, value): a field's first non-blank value in that order, as later strategies only fill what is missing."""
    given = fields.where(F.length(F.trim("value")) > 0)
    return given.groupBy(key, "field").agg(F.min_by("value", place).alias("value"))


def adaptive_choice(rates: DataFrame, key: str, least: int = 3, rate: float = 0.7) -> DataFrame:
    """(key, strategy) from (key, strategy, position, attempts, rate, confidence): the best proven one, else llm, else the most confident."""
    proven = (F.col("rate") > rate) & (F.col("attempts") >= least)
    best = F.min_by("strategy", F.when(proven, F.struct(-F.col("rate"), F.col("position"))))
    sure = F.min_by("strategy", F.struct(-F.col("confidence"), F.col("position")))
    return rates.groupBy(key).agg(F.coalesce(best, F.max(F.when(F.col("strategy") == "llm", "llm")), sure).alias("strategy"))


def hybrid_outcome(results: DataFrame, key: str, base: Column, least: int) -> DataFrame:
    """(key, confidence, needs_more): ``base`` raised for several sources and many fields; whether no source has ``least`` fields."""
    n, fields = F.count("*"), F.sum("n_fields")
    bonus = F.when(n > 1, 0.15).otherwise(0.05) + F.when(fields > 5, 0.1).when(fields > 3, 0.05).otherwise(0.0)
    return results.groupBy(key).agg(F.least(F.max(base) + bonus, F.lit(1.0)).alias("confidence"), (F.max("n_fields") < least).alias("needs_more"))


def _listed(value: Column, table: dict[str, Sequence[str]], other: Sequence[str]) -> Column:
    out = None
    for name, names in table.items():
        given = F.array(*map(F.lit, names))
        out = F.when(value == name, given) if out is None else out.when(value == name, given)
    return out.otherwise(F.array(*map(F.lit, other)))


def structured_types(purpose: Column) -> Column:
    return _listed(purpose, STRUCTURED_TYPES, ANY_STRUCTURED_TYPE)


def fallbacks(strategy: Column) -> Column:
    return _listed(strategy, FALLBACKS, ANY_FALLBACK)


def needs_enhancement(found: Column, required: Column, least: float = 0.6) -> Column:
    """Whether fewer than ``least`` of the required fields are there."""
    return F.size(F.array_intersect(found, required)) / F.size(required) < least


def adjusted_rate(base: Column, confidence: Column) -> Column:
    return base * (0.7 + 0.3 * confidence)


def effectiveness_advice(quality: Column, successes: Column, goals: Column, accuracy: Column) -> Column:
    """Labels of the four ratios that are too low, or that all is well."""
    low = labels_where(("adjust_weights", quality < 0.3), ("review_filters", successes < 0.8), ("widen_goals", goals < 0.5), ("tune_scores", accuracy < 0.6))
    return F.when(F.size(low) > 0, low).otherwise(F.array(F.lit("expand_scope")))


def array_changes(old: Column, new: Column) -> Column:
    """struct(added, removed), each sorted."""
    return F.struct(F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"))


def map_changes(old: Column, new: Column) -> Column:
    """A map of the keys whose values differ to struct(old, new); a missing key is a null value."""
    both = F.map_zip_with(old, new, lambda _, a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.map_filter(both, lambda _, v: ~v["old"].eqNullSafe(v["new"]))


def discovered_parents(crawled: DataFrame, links: DataFrame) -> DataFrame:
    """(url, parent): the most recently crawled page (url, at) before a page that links (src, dst) to it, the larger url on a tie; one join on each side."""
    seen = links.join(crawled.select(F.col("url").alias("src"), F.col("at").alias("src_at")), "src")
    met = seen.join(crawled.select(F.col("url").alias("dst"), "at"), "dst").where("src_at < at")
    return met.groupBy(F.col("dst").alias("url")).agg(F.max_by("src", F.struct("src_at", "src")).alias("parent"))
