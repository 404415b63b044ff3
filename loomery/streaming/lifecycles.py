"""Session logs and job lifecycles over streams, with timers that end them and free their state.

State of a key is a few numbers, whatever it received: rows go out as they come, in
Arrow batches, each sorted by time; a batch is the unit that is sorted, so no key's
rows are held whole. Event-time timers, moved by every row, end a key that is idle; an
ended key leaves no state. The state store is RocksDB, set for the session where it is
not; it keeps state on disk and checkpoints its changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rocks(spark: SparkSession) -> None:
    if "RocksDB" not in (spark.conf.get(_PROVIDER) or ""):
        spark.conf.set(_PROVIDER, _ROCKS)


class _Timed(StatefulProcessor):
    """One value of state and one timer for each key; ``last`` is the time of its latest row in milliseconds."""

    schema = ""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def rearm(self, before: int | None, last: int) -> None:
        if before is not None and before != last:
            self.handle.deleteTimer(before + self.idle_ms)
        self.handle.registerTimer(last + self.idle_ms)

    def close(self) -> None:
        pass


class _Log(_Timed):
    schema = "session int, n int, last long"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, n, last = self.state.get() if self.state.exists() else (1, 0, None)
        before = last
        for batch in rows:
            out = []
            for ms, message in batch.sort_values(["ms", "message"])[["ms", "message"]].itertuples(index=False):
                if last is not None and ms - last > self.idle_ms:
                    session, n = session + 1, 0
                n, last = n + 1, ms if last is None else max(last, ms)
                out.append((key[0], session, n, ms, message, "message"))
            yield pd.DataFrame(out, columns=["key", "session", "n", "ms", "message", "event"])
        self.state.update((int(session), int(n), int(last)))
        self.rearm(before, int(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, n, last = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], session, n, last + self.idle_ms, None, "end")], columns=["key", "session", "n", "ms", "message", "event"])


class _Job(_Timed):
    schema = "progress double, done boolean, last long"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        progress, done, last = self.state.get() if self.state.exists() else (0.0, False, None)
        before = last
        for batch in rows:
            out = []
            for ms, given in batch.sort_values("ms")[["ms", "progress"]].itertuples(index=False):
                last = ms if last is None else max(last, ms)
                if done:
                    continue
                progress = progress if pd.isna(given) else min(100.0, max(0.0, given))
                done = progress >= 100.0
                out.append((key[0], ms, progress, "completed" if done else "running"))
            yield pd.DataFrame(out, columns=["key", "ms", "progress", "status"])
        self.state.update((float(progress), bool(done), int(last)))
        self.rearm(before, int(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        progress, done, last = self.state.get()
        self.state.clear()
        rows = [] if done else [(key[0], last + self.idle_ms, progress, "expired")]
        yield pd.DataFrame(rows, columns=["key", "ms", "progress", "status"])


def _run(shaped: DataFrame, processor: _Timed, out: str, late: str) -> DataFrame:
    _rocks(shaped.sparkSession)
    return shaped.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).groupBy("key").transformWithStateInPandas(processor, out, "append", "eventTime")


def session_log(messages: DataFrame, ts: str, key: str, message: str, idle_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(key, session, n, at, message, event): every message with its number in its session; ``end`` once the key was idle so long.

    A message that comes later than ``idle_seconds`` after the one before begins the next
    session; after an end, numbers begin anew.
    """
    shaped = messages.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(message).cast("string").alias("message"))
    rows = _run(shaped, _Log(idle_seconds * 1000), "key string, session int, n int, ms long, message string, event string", late)
    return rows.select("key", "session", "n", F.timestamp_millis("ms").alias("at"), "message", "event")


def job_lifecycle(updates: DataFrame, ts: str, key: str, progress: str, idle_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(key, at, progress, status): progress held within 0 to 100; running, completed once at 100 (later updates are ignored), expired when no update came for so long.

    An update without a number repeats the progress before it.
    """
    shaped = updates.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(progress).cast("double").alias("progress"))
    rows = _run(shaped, _Job(idle_seconds * 1000), "key string, ms long, progress double, status string", late)
    return rows.select("key", F.timestamp_millis("ms").alias("at"), "progress", "status")
