"""Streaming operators over a folder of event files."""

import datetime as dt

from pyspark.sql import functions as F

from loomery.streaming import windows

SCHEMA = "event_id long, ts timestamp, user_id long, value double"
T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, build, rows, mode="append"):
    data = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), u, v) for i, (s, u, v) in enumerate(rows)], SCHEMA)
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        return spark.sql("SELECT * FROM out").collect()
    finally:
        query.stop()


def test_token_bucket(spark, tmp_path):
    rows = [(0.0, 1, 0.0)] * 3 + [(1.0, 1, 0.0), (1.1, 1, 0.0), (0.0, 2, 0.0)]
    got = {r.event_id: r.granted for r in run(spark, tmp_path, lambda s: windows.token_bucket(s, "ts", "user_id", "event_id", 1.0, 2.0), rows)}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}


def test_sustained_alerts(spark, tmp_path):
    rows = [(0, 1, 9.0), (5, 1, 9.0), (11, 1, 9.0), (20, 1, 9.0), (21, 1, 1.0), (22, 1, 9.0), (0, 2, 9.0), (5, 2, 1.0), (12, 2, 9.0)]
    got = run(spark, tmp_path, lambda s: windows.sustained_alerts(s, "ts", "user_id", F.col("value") > 5, 10.0), rows)
    assert [(r.key, (r.at - T0).total_seconds()) for r in got] == [("1", 11.0)]


def test_windowed_rates_and_sessions(spark, tmp_path):
    rows = [(1, 1, 2.0), (2, 1, 4.0), (61, 1, 6.0)]
    got = run(spark, tmp_path / "a", lambda s: windows.windowed_rates(s, "ts", "user_id", "value", "60 seconds", "60 seconds"), rows, "complete")
    assert sorted((r.n, r.mean) for r in got) == [(1, 6.0), (2, 3.0)]
    got = run(spark, tmp_path / "b", lambda s: windows.sessions(s, "ts", "user_id", "30 seconds"), rows, "complete")
    assert sorted(r.n for r in got) == [1, 2]
