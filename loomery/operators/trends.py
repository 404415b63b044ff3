"""Trends of scores along an exploration, boosts, and adaptive limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators.ranking import positions


def trend_by_thirds(df: DataFrame, by: str, order: list[str], score: str) -> DataFrame:
    """Per series: the mean of the first third against that of the last, which rounds up; needs five rows."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.select(by, F.col(score).alias("v"), F.row_number().over(w).alias("at"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    early = F.avg(F.when(F.col("at") <= F.floor(F.col("n") / 3), F.col("v")))
    late = F.avg(F.when(F.col("at") > F.col("n") - F.ceil(F.col("n") / 3), F.col("v")))
    out = rows.groupBy(by, "n").agg(early.alias("early"), late.alias("late"))
    name = F.when(F.col("n") < 5, "insufficient_data").when(F.col("late") > F.col("early") * 1.1, "improving").when(F.col("late") < F.col("early") * 0.9, "declining").otherwise("stable")
    return out.select(by, name.alias("trend"), "n")


def depth_trend(depths: DataFrame, depth: str, quality: str) -> DataFrame:
    """How often quality rises and falls from one depth to the next, and which prevails; one row, few depths."""
    w = Window.orderBy(depth)
    steps = depths.select((F.col(quality) - F.lag(quality).over(w)).alias("d"))
    out = steps.agg(F.count_if(F.col("d") > 0).alias("rises"), F.count_if(F.col("d") < 0).alias("falls"))
    return out.select("rises", "falls", F.when(F.col("rises") > F.col("falls"), "improving").when(F.col("falls") > F.col("rises"), "declining").otherwise("stable").alias("trend"))


def boosted(score: Column, parent: Column, recent_mean: Column, kinds: Column) -> Column:
    """A score raised by a good parent, by recent quality and while few kinds of pages are known; at most 1."""
    by_parent = F.when(parent > 0.8, 1.2).when(parent > 0.6, 1.1).otherwise(1.0)
    return F.least(score * by_parent * F.when(recent_mean > 2, 1.15).otherwise(1.0) * F.when(kinds < 3, 1.1).otherwise(1.0), F.lit(1.0))


def adaptive_rate(rate: Column, base: Column, success_rate: Column) -> Column:
    """A rate a tenth higher above 95 % success (at most twice its base), a fifth lower under 80 % (at least a tenth)."""
    return F.when(success_rate > 0.95, F.least(rate * 1.1, base * 2)).when(success_rate < 0.8, F.greatest(rate * 0.8, base * 0.1)).otherwise(rate)


def rank_agreement(df: DataFrame, order: str, score: str) -> DataFrame:
    """Mean of 1 / (1 + |position - position by score|) over an exploration, ties of scores by ``order``; nulls score least."""
    rows = df.select(F.col(order).alias("o"), F.col(score).isNull().alias("unscored"), (-F.col(score)).alias("down"))
    rows = positions(positions(rows, ["o"], "a"), ["unscored", "down", "o"], "i")
    return rows.agg(F.avg(1 / (1 + F.abs(F.col("a") - F.col("i")))).alias("agreement"))


def deepest(tree: DataFrame, k: int) -> DataFrame:
    """The k deepest nodes, ties by node."""
    return tree.orderBy(F.desc("depth"), "node").limit(k)
