"""Structured Streaming forms of rate windows, alerts and limits.

All take a streaming DataFrame and return one; sources and sinks are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, ts: str, key: str, value: str, length: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Events, rate, mean and maximum of each key in sliding windows; rows later than ``late`` are dropped by the watermark."""
    seconds = F.col("w.end").cast("timestamp").cast("double") - F.col("w.start").cast("timestamp").cast("double")
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), key)
    counts = grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", (F.col("n") / seconds).alias("rate"), "mean", "most")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions of each key."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sustained_alerts(events: DataFrame, ts: str, key: str, holds: Column, seconds: float) -> DataFrame:
    """(key, began, at): one alert when the condition has held for ``seconds``; a false clears it.

    State is the start of the current span and whether it has been reported, for
    each key; events of one trigger are taken in time order.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        began, told = state.get if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for at, ok in zip(rows["ts"], rows["holds"], strict=True):
            now = at.timestamp()
            if not ok:
                began, told = None, False
            elif began is None:
                began = now
            if began is not None and not told and now - began >= seconds:
                told = True
                out.append((group[0], pd.Timestamp(began, unit="s"), at))
        state.update((began, told))
        yield pd.DataFrame(out, columns=["key", "began", "at"])

    shaped = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(holds, F.lit(False)).alias("holds"))
    return shaped.groupBy("key").applyInPandasWithState(step, "key string, began timestamp, at timestamp", "began double, told boolean", "append", "NoTimeout")


def token_bucket(events: DataFrame, ts: str, key: str, event_id: str, rate: float, burst: float) -> DataFrame:
    """(key, event_id, granted): a bucket of ``burst`` tokens for each key, refilled at ``rate`` a second."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for at, event in zip(rows["ts"], rows["event_id"], strict=True):
            now = at.timestamp()
            tokens = min(burst, tokens + max(0.0, now - (now if last is None else last)) * rate)
            last = now if last is None else max(last, now)
            granted = tokens >= 1
            tokens -= granted
            out.append((group[0], event, bool(granted)))
        state.update((float(tokens), last))
        yield pd.DataFrame(out, columns=["key", "event_id", "granted"])

    shaped = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(event_id).cast("long").alias("event_id"))
    return shaped.groupBy("key").applyInPandasWithState(step, "key string, event_id long, granted boolean", "tokens double, last double", "append", "NoTimeout")
