"""Rate windows, sustained alerts and running statistics over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions.names import fresh
from loomery.operators import key_sequences

#: Length of a time slice, in windows: one event in so many is counted twice.
SLICE = 16


def sliding_rate(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Add ``in_window``: events of the key in the trailing window, this one included.

    Time is cut into slices of 16 windows, so a hot key is many groups; a slice also
    gets the events of one window before it, which are dropped once counted.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(at / (SLICE * width))
    slices = F.when(at >= (own + 1) * SLICE * width - width, F.array(own, own + 1)).otherwise(F.array(own))
    (part,) = fresh([*events.columns, "in_window"], "slice")
    rows = events.withColumn(part, F.explode(slices))
    w = Window.partitionBy(key, part).orderBy(at).rangeBetween(-width, 0)
    return rows.withColumn("in_window", F.count("*").over(w)).where(F.col(part).eqNullSafe(own)).drop(part)


def rate_limited(events: DataFrame, key: str, ts: str, rate: float, seconds: int) -> DataFrame:
    """Add ``allowed``: fewer than rate x window earlier events lie in the trailing window."""
    return sliding_rate(events, key, ts, seconds).withColumn("allowed", F.col("in_window") - 1 < rate * seconds)


def sustained(events: DataFrame, key: str, ts: str, tie: str, holds: Column, seconds: int) -> DataFrame:
    """Spans in which ``holds`` stayed true at least so long: key, began, ended, n. A false clears the span."""
    marked = events.select(key, ts, tie, holds.alias("holds"))
    marked = key_sequences.running(marked, key, [ts, tie], {"span": ("sum", (~F.col("holds")).cast("long"))})
    spans = marked.where("holds").groupBy(key, "span").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count("*").alias("n"))
    return spans.where(F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp")) >= seconds * 1_000_000).select(key, "began", "ended", "n")


def running_mean(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Add ``running_mean``; exact sums if ``value`` is a decimal."""
    total, n = fresh([*events.columns, "running_mean"], "total", "n")
    rows = key_sequences.running(events, key, order, {total: ("sum", F.col(value)), n: ("count", F.col(value))})
    return rows.withColumn("running_mean", F.col(total).cast("double") / F.col(n)).drop(total, n)


def trailing_mean(events: DataFrame, key: str, order: list[str], value: str, rows: int) -> DataFrame:
    """Add ``trailing_mean`` of the key's last ``rows`` rows."""
    total, n = fresh([*events.columns, "trailing_mean"], "total", "n")
    found = key_sequences.trailing(events, key, order, {total: ("sum", F.col(value)), n: ("count", F.col(value))}, rows)
    return found.withColumn("trailing_mean", F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n))).drop(total, n)


def moving_average(events: DataFrame, key: str, order: list[str], value: str, rate: float) -> DataFrame:
    """(key, ema, n): last value of the exponential moving average of each key; the first sample seeds it."""
    return key_sequences.exponential(events, key, order, value, rate)
