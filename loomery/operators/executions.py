"""Statistics over execution logs: (plan, ts, success, execution_time, tool, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that classify an error, in order of precedence.
FAILURES = {"timeout": ("timeout",), "not_found": ("not found", "404"), "permission": ("permission", "forbidden"), "extraction": ("parse", "extract")}


def failure_class(error: Column) -> Column:
    low, out = F.lower(error), None
    for name, words in FAILURES.items():
        test = low.rlike("|".join(words))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def tool_performance(log: DataFrame, tool: str, success: Column, seconds: Column) -> DataFrame:
    """Uses, successes, failures, total and mean time, and success rate of each tool."""
    return log.groupBy(tool).agg(F.count("*").alias("uses"), F.count_if(success).alias("successes"), F.count_if(~success).alias("failures"), F.sum(seconds).alias("total_time"), F.avg(seconds).alias("avg_time"), (F.count_if(success) / F.count("*")).alias("success_rate"))


def floor_percentiles(df: DataFrame, by: str, value: str, points: Sequence[int]) -> DataFrame:
    """The value at position floor(n p / 100) of each sorted group, capped at the last.

    Equal values are counted first, so a group's rows never gather in one task:
    only its distinct values are ordered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(by))
    ranked = counts.select(by, value, up_to.alias("up_to"), total.alias("total"))
    picks = [F.min(F.when(F.col("up_to") > F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1), F.col(value))).alias(f"p{p}") for p in points]
    return ranked.groupBy(by).agg(F.max("total").alias("n"), *picks)


def daily_performance(log: DataFrame, tool: str, ts: str, success: Column, seconds: Column) -> DataFrame:
    """Executions, mean time and success rate of each tool and day."""
    return log.groupBy(tool, F.date_trunc("day", F.col(ts)).alias("date")).agg(F.count("*").alias("total_executions"), (F.sum(seconds).cast("double") / F.count(seconds)).alias("avg_execution_time"), (F.count_if(success) / F.count("*")).alias("success_rate"))


def transitions(log: DataFrame, session: str, order: Sequence[str], tool: str) -> DataFrame:
    """(tool, next_tool, n, share): how often one step follows another within a session."""
    w = Window.partitionBy(session).orderBy(*order)
    pairs = log.select(F.col(tool).alias("tool"), F.lead(tool).over(w).alias("next_tool")).where(F.col("next_tool").isNotNull())
    counts = pairs.groupBy("tool", "next_tool").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("tool")))


def usage_patterns(log: DataFrame, plan: str, order: Sequence[str], tool: str, success: Column, seconds: Column) -> DataFrame:
    """Plans grouped by their sequence of tools: frequency, mean time, success rate."""
    steps = log.select(plan, F.struct(*order, F.col(tool).alias("t")).alias("s"), success.alias("ok"), seconds.alias("sec"))
    plans = steps.groupBy(plan).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"]), " -> ").alias("pattern"), F.min("ok").alias("ok"), F.sum("sec").alias("sec"))
    return plans.groupBy("pattern").agg(F.count("*").alias("frequency"), F.avg("sec").alias("avg_time"), (F.count_if("ok") / F.count("*")).alias("success_rate"))


def health(rate: Column) -> Column:
    return F.when(rate > 0.8, "healthy").when(rate > 0.5, "degraded").otherwise("unhealthy")


def modes(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most common value of each group, the least on a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x")).select(by, F.col("x.v").alias(value), (-F.col("x.m")).alias("n"))


def linear_slope(df: DataFrame, by: str, x: Column, y: Column) -> DataFrame:
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.count(y).alias("n"))


def weighted_rate(df: DataFrame, by: str, rate: Column, weight: Column) -> DataFrame:
    """Mean rate weighted by attempts."""
    return df.groupBy(by).agg((F.sum(rate * weight) / F.sum(weight)).alias("rate"), F.sum(weight).alias("attempts"))


def trailing_summary(df: DataFrame, ts: str, value: str, as_of: Column, minutes: int) -> DataFrame:
    """Average, maximum and minimum over the last minutes before ``as_of``."""
    recent = df.where((F.col(ts) > as_of - F.make_dt_interval(mins=F.lit(minutes))) & (F.col(ts) <= as_of))
    return recent.agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), F.count(value).alias("n"))
