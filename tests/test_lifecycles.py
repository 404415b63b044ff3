"""Session logs and job lifecycles over several triggers, with timers."""

import datetime as dt

import pytest

from loomery.streaming import lifecycles

T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, build, triggers, schema):
    """Each list of rows is one file, and one trigger."""
    for n, rows in enumerate(triggers):
        frame = spark.createDataFrame([(T0 + dt.timedelta(seconds=s), *rest) for s, *rest in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n:02}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = build(stream).writeStream.format("memory").queryName("lives").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        kept = [p["numRowsTotal"] for p in query.lastProgress["stateOperators"]]
        return spark.sql("SELECT * FROM lives").collect(), kept
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_session_log(spark, tmp_path):
    triggers = [[(2, 1, "b"), (0, 1, "a"), (1, 2, "x")], [(70, 1, "c"), (65, 2, "y")], [(500, 3, "z")], [(501, 3, "w")], [(502, 1, "again")]]
    rows, kept = run(spark, tmp_path, lambda s: lifecycles.session_log(s, "ts", "k", "m", 60, "0 seconds"), triggers, "ts timestamp, k int, m string")
    said = [(r.key, r.session, r.n, r.message) for r in rows if r.event == "message"]
    assert sorted(x for x in said if x[3] != "again") == [("1", 1, 1, "a"), ("1", 1, 2, "b"), ("1", 2, 1, "c"), ("2", 1, 1, "x"), ("2", 2, 1, "y"), ("3", 1, 1, "z"), ("3", 1, 2, "w")]
    assert ("1", 1, 1, "again") in said
    ends = {(r.key, r.session, r.n, (r.at - T0).total_seconds()) for r in rows if r.event == "end"}
    assert ends == {("1", 2, 1, 130.0), ("2", 2, 1, 125.0)}


def test_job_lifecycle(spark, tmp_path):
    triggers = [[(0, "a", -5.0), (5, "a", 40.0), (1, "b", 10.0)], [(6, "a", None), (7, "a", 170.0), (8, "a", 20.0)], [(400, "c", 1.0)], [(401, "c", 2.0)]]
    rows, kept = run(spark, tmp_path, lambda s: lifecycles.job_lifecycle(s, "ts", "k", "p", 60, "0 seconds"), triggers, "ts timestamp, k string, p double")
    got = [(r.key, (r.at - T0).total_seconds(), r.progress, r.status) for r in rows]
    assert [x for x in got if x[0] == "a"] == [("a", 0.0, 0.0, "running"), ("a", 5.0, 40.0, "running"), ("a", 6.0, 40.0, "running"), ("a", 7.0, 100.0, "completed")]
    assert [x for x in got if x[0] == "b"] == [("b", 1.0, 10.0, "running"), ("b", 61.0, 10.0, "expired")]
    assert pytest.approx(2.0) == [x for x in got if x[0] == "c"][-1][2]
