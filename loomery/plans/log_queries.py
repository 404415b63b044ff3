"""Queries over an execution log, with SQL oracles. The log is the events table: a step of one tool in a plan of five."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import reports
from loomery.plans.queries import query, r4
from loomery.session import table

LOG = """log AS (SELECT event_id, event_type AS tool, event_id // 5 AS plan, ts, value AS seconds, value < 10 AS ok, value * 25 AS memory_mb, (user_id % 100)::DOUBLE AS cpu, user_id % 7 AS domain, (user_id % 10) / 10 AS confidence,
    CASE user_id % 3 WHEN 0 THEN 'css' WHEN 1 THEN 'llm' ELSE 'hybrid' END AS strategy,
    CASE WHEN value >= 10 THEN CASE user_id % 4 WHEN 0 THEN 'Timeout: slow site' WHEN 1 THEN 'HTTP 404: page not found' WHEN 2 THEN 'permission denied' ELSE 'parse: bad: json' END END AS error FROM events)"""
PLANS = "plans AS (SELECT plan, list(tool ORDER BY event_id) AS tools, bool_and(ok) AS ok, sum(seconds) AS seconds FROM log GROUP BY 1)"
PATTERNS = f"{PLANS}, patterns AS (SELECT tools, count(*) AS frequency, avg(seconds) AS avg_seconds, (count(*) FILTER (ok)) / count(*) AS success_rate FROM plans GROUP BY 1), scored AS (SELECT *, CASE WHEN avg_seconds > 0 THEN success_rate / (avg_seconds / 60) ELSE 0 END AS efficiency FROM patterns)"
PROFILES = "profiles AS (SELECT tool, count(*) AS executions, (count(*) FILTER (ok)) / count(*) AS success_rate, avg(seconds) AS avg_seconds, max(seconds) AS max_seconds, avg(memory_mb) AS avg_memory_mb, avg(cpu) AS avg_cpu, count(*) FILTER (NOT ok) AS failures FROM log GROUP BY 1)"


def log(spark: SparkSession, sf: str) -> DataFrame:
    u, v = F.col("user_id"), F.col("value")
    error = F.when(u % 4 == 0, "Timeout: slow site").when(u % 4 == 1, "HTTP 404: page not found").when(u % 4 == 2, "permission denied").otherwise("parse: bad: json")
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("tool"), F.floor(F.col("event_id") / 5).alias("plan"), "ts", v.alias("seconds"), (v < 10).alias("ok"), (v * 25).alias("memory_mb"), (u % 100).cast("double").alias("cpu"), (u % 7).alias("domain"), ((u % 10) / 10).alias("confidence"),
        F.when(u % 3 == 0, "css").when(u % 3 == 1, "llm").otherwise("hybrid").alias("strategy"), F.when(v >= 10, error).alias("error"),
    )


def plans(spark: SparkSession, sf: str) -> DataFrame:
    return reports.plans_of(log(spark, sf), ["event_id"])


@query(f"WITH {LOG}, {PROFILES} SELECT tool, executions, round(success_rate, 4) AS success_rate, round(avg_seconds, 4) AS avg_seconds, max_seconds, round(avg_memory_mb, 4) AS avg_memory_mb, round(avg_cpu, 4) AS avg_cpu, failures FROM profiles")
def performance_report(spark: SparkSession, sf: str) -> DataFrame:
    p = reports.tool_profiles(log(spark, sf))
    return p.select("tool", "executions", r4(F.col("success_rate")).alias("success_rate"), r4(F.col("avg_seconds")).alias("avg_seconds"), "max_seconds", r4(F.col("avg_memory_mb")).alias("avg_memory_mb"), r4(F.col("avg_cpu")).alias("avg_cpu"), "failures")


@query(f"WITH {LOG} SELECT event_id, concat_ws(',', CASE WHEN seconds > 30 THEN 'slow_execution' END, CASE WHEN memory_mb > 500 THEN 'high_memory' END, CASE WHEN cpu > 80 THEN 'high_cpu' END) AS alerts FROM log")
def execution_alerts(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.execution_alerts(F.col("seconds"), F.col("memory_mb"), F.col("cpu"))
    return log(spark, sf).select("event_id", F.array_join(found, ",").alias("alerts"))


@query(f"WITH {LOG}, {PROFILES} SELECT tool, 'reduce_execution_time' AS advice FROM profiles WHERE avg_seconds > 30 UNION ALL SELECT tool, 'reduce_memory' FROM profiles WHERE avg_memory_mb > 500 UNION ALL SELECT tool, 'reduce_cpu' FROM profiles WHERE avg_cpu > 80 UNION ALL SELECT tool, 'improve_reliability' FROM profiles WHERE success_rate < 0.8")
def profile_advice(spark: SparkSession, sf: str) -> DataFrame:
    return reports.profile_advice(reports.tool_profiles(log(spark, sf)))


def _ranked_sql(by: str) -> str:
    return f"WITH {LOG}, {PROFILES} SELECT tool, round({by}, 4) AS value, row_number() OVER (ORDER BY {by} DESC, tool) AS place FROM profiles ORDER BY 3 LIMIT 3"


def _ranked(spark: SparkSession, sf: str, by: str) -> DataFrame:
    return reports.ranked(reports.tool_profiles(log(spark, sf)), F.expr(by), 3).select("tool", r4(F.col("by")).alias("value"), F.col("place").cast("long").alias("place"))


@query(_ranked_sql("avg_seconds"))
def slowest_tools(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, "avg_seconds")


@query(_ranked_sql("avg_memory_mb"))
def memory_intensive_tools(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, "avg_memory_mb")


@query(_ranked_sql("1 - success_rate"))
def error_prone_tools(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, "1 - success_rate")


@query(f"WITH {LOG} SELECT tool, CASE WHEN position(':' IN error) > 0 THEN left(error, position(':' IN error) - 1) ELSE error END AS prefix, count(*) AS n FROM log WHERE error IS NOT NULL GROUP BY 1, 2")
def error_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.error_prefixes(log(spark, sf))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS back FROM log), m AS (SELECT domain, avg(seconds) AS mean, avg(seconds) FILTER (back <= 5) AS after, avg(seconds) FILTER (back BETWEEN 6 AND 10) AS before, count(*) FILTER (back <= 10) AS n FROM r GROUP BY 1) SELECT domain, round(before, 4) AS before, round(after, 4) AS after FROM m WHERE n = 10 AND after - before > 0.1 * mean")
def degraded_tools(spark: SparkSession, sf: str) -> DataFrame:
    return reports.degraded(log(spark, sf), ["ts", "event_id"], "domain").select("domain", r4(F.col("before")).alias("before"), r4(F.col("after")).alias("after"))


@query(f"WITH {LOG}, w AS (SELECT unnest(string_split(lower(error), ' ')) AS word FROM log WHERE error IS NOT NULL) SELECT word, count(*) AS n FROM w WHERE len(word) >= 4 GROUP BY 1")
def capability_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return reports.capability_gaps(log(spark, sf).where("error IS NOT NULL"), "error")


@query(f"WITH {LOG}, p AS (SELECT tool AS first, lead(tool) OVER (PARTITION BY plan ORDER BY event_id) AS second, bool_and(ok) OVER (PARTITION BY plan) AS fine FROM log) SELECT first, second, count(*) AS n FROM p WHERE second IS NOT NULL AND NOT fine GROUP BY 1, 2 HAVING count(*) >= 2")
def failed_combinations(spark: SparkSession, sf: str) -> DataFrame:
    return reports.failed_combinations(log(spark, sf), ["event_id"])


@query(f"WITH {LOG}, {PLANS} SELECT plan, concat_ws(',', CASE WHEN len(tools) <> len(list_distinct(tools)) THEN 'repeated_tool' END, CASE WHEN len(list_filter(tools, lambda t: t = 'view')) > 1 THEN 'parallel' END, CASE WHEN list_contains(tools, 'signup') AND list_contains(tools, 'purchase') THEN 'inefficient_sequence' END) AS issues FROM plans")
def plan_issues(spark: SparkSession, sf: str) -> DataFrame:
    return plans(spark, sf).select("plan", F.array_join(reports.plan_issues(F.col("tools"), ["view"], [("signup", "purchase")]), ",").alias("issues"))


@query(f"WITH {LOG}, {PATTERNS}, i AS (SELECT *, concat_ws(',', CASE WHEN success_rate < 0.7 THEN 'low_success_rate' END, CASE WHEN avg_seconds > 60 THEN 'slow' END, CASE WHEN efficiency < 0.5 THEN 'inefficient' END) AS issues FROM scored) SELECT array_to_string(tools, '>') AS pattern, frequency, issues FROM i WHERE issues <> ''")
def problematic_patterns(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.problematic_patterns(reports.pattern_statistics(plans(spark, sf)))
    return found.select(F.array_join("tools", ">").alias("pattern"), "frequency", F.array_join("issues", ",").alias("issues"))


@query(f"WITH {LOG}, {PATTERNS}, d AS (SELECT *, len(list_filter(list_zip(tools, ['view', 'view', 'click', 'view', 'view']), lambda z: z[1] <> z[2])) AS distance FROM scored WHERE len(tools) = 5) SELECT array_to_string(tools, '>') AS pattern, distance FROM d WHERE distance BETWEEN 1 AND 2 AND success_rate > 0.2 AND efficiency > 0.1")
def near_patterns(spark: SparkSession, sf: str) -> DataFrame:
    goal = F.array(*map(F.lit, ["view", "view", "click", "view", "view"]))
    found = reports.near_patterns(reports.pattern_statistics(plans(spark, sf)), goal, 0.2, 0.1)
    return found.select(F.array_join("tools", ">").alias("pattern"), F.col("distance").cast("long").alias("distance"))


@query(f"WITH {LOG}, {PLANS}, s AS (SELECT array_to_string(list_sort(tools), ',') AS tool_set, array_to_string(tools, '>') AS o, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END / (1 + seconds) AS score FROM plans) SELECT tool_set, (min(ROW(-score, o)))[2] AS best_order, round(max(score), 4) AS score, count(*) AS plans FROM s GROUP BY 1")
def best_orders(spark: SparkSession, sf: str) -> DataFrame:
    return reports.best_orders(plans(spark, sf)).select("tool_set", "best_order", r4(F.col("score")).alias("score"), "plans")


@query(f"WITH {LOG} SELECT domain, strategy, count(*) AS attempts, count(*) FILTER (ok) AS successes, round((count(*) FILTER (ok)) / count(*), 4) AS rate FROM log GROUP BY 1, 2 HAVING count(*) >= 3")
def attempt_rates(spark: SparkSession, sf: str) -> DataFrame:
    return reports.attempt_rates(log(spark, sf), ["domain", "strategy"], 3).withColumn("rate", r4(F.col("rate")))


@query(f"WITH {LOG}, r AS (SELECT tool, coalesce((count(*) FILTER (ok AND strategy = 'css')) / nullif(count(*) FILTER (strategy = 'css'), 0), 0) AS css, coalesce((count(*) FILTER (ok AND strategy = 'llm')) / nullif(count(*) FILTER (strategy = 'llm'), 0), 0) AS llm FROM log GROUP BY 1) SELECT tool, CASE WHEN css > llm + 0.1 THEN 'css' WHEN llm > css + 0.1 THEN 'llm' ELSE 'hybrid' END AS best FROM r")
def best_strategies(spark: SparkSession, sf: str) -> DataFrame:
    def rate(s):
        return F.coalesce(F.try_divide(F.count_if(F.col("ok") & (F.col("strategy") == s)), F.count_if(F.col("strategy") == s)), F.lit(0.0))

    rates = log(spark, sf).groupBy("tool").agg(rate("css").alias("css"), rate("llm").alias("llm"))
    return rates.select("tool", reports.best_strategy(F.col("css"), F.col("llm")).alias("best"))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts DESC, event_id DESC) AS back FROM log) SELECT tool, event_id FROM r WHERE back <= 100")
def bounded_history(spark: SparkSession, sf: str) -> DataFrame:
    return reports.last_rows(log(spark, sf), ["tool"], ["ts", "event_id"], 100).select("tool", "event_id")


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts DESC, event_id DESC) AS back FROM log WHERE ok), c AS (SELECT tool, strategy, count(*) AS n FROM r WHERE back <= 10 GROUP BY 1, 2) SELECT tool, strategy, n FROM c QUALIFY row_number() OVER (PARTITION BY tool ORDER BY n DESC, strategy) = 1")
def recent_modes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.recent_modes(log(spark, sf), "tool", ["ts", "event_id"], "strategy")


@query(f"WITH {LOG} SELECT event_id, count(*) OVER near AS near_rows, min(seconds) OVER w AS least, max(seconds) OVER w AS most, (count(*) FILTER (NOT ok) OVER w)::BIGINT AS errors FROM log WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), near AS (PARTITION BY domain ORDER BY ts, event_id ROWS 99 PRECEDING)")
def rolling_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reports.rolling_profile(log(spark, sf), ["ts", "event_id"], "domain").select("event_id", "near_rows", "least", "most", "errors")


JOBS = "jobs AS (SELECT o_orderkey AS job, 20 AS total, (o_orderkey % 21)::BIGINT AS done, (o_custkey % 100)::DOUBLE AS elapsed, (o_orderkey % 11)::BIGINT AS succeeded, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS state FROM orders)"


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.lit(20).alias("total"), (F.col("o_orderkey") % 21).alias("done"), (F.col("o_custkey") % 100).cast("double").alias("elapsed"), (F.col("o_orderkey") % 11).alias("succeeded"), state.alias("state"))


@query(f"WITH {JOBS} SELECT job, done * 100.0::DOUBLE / total AS percent, elapsed, CASE WHEN done > 0 THEN (total - done) * elapsed / done END AS seconds_left FROM jobs")
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    return reports.job_progress(jobs(spark, sf))


@query(f"WITH {JOBS} SELECT count(*) FILTER (state = 'pending') AS pending_jobs, count(*) FILTER (state = 'running') AS running_jobs, count(*) FILTER (state = 'completed') AS completed_jobs, count(*) FILTER (state = 'failed') AS failed_jobs, round(sum(done) * 60.0::DOUBLE / sum(elapsed), 4) AS urls_per_minute, round(sum(succeeded) * 100.0::DOUBLE / sum(done), 4) AS success_percent FROM jobs")
def executor_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = reports.system_metrics(jobs(spark, sf))
    return m.withColumns({c: r4(F.col(c)) for c in ("urls_per_minute", "success_percent")})


@query(f"WITH {LOG}, k AS (SELECT tool AS strategy, (count(*) FILTER (ok)) / count(*) AS rate FROM log WHERE tool <> 'click' GROUP BY 1), w AS (SELECT * FROM (VALUES ('click', 1), ('error', 2), ('purchase', 3), ('signup', 4), ('view', 5), ('other', 6)) t(strategy, position)) SELECT strategy, row_number() OVER (ORDER BY rate DESC NULLS LAST, position) AS place FROM w LEFT JOIN k USING (strategy)")
def strategy_order(spark: SparkSession, sf: str) -> DataFrame:
    known = reports.attempt_rates(log(spark, sf).where("tool <> 'click'"), ["tool"]).withColumnRenamed("tool", "strategy")
    wanted = spark.createDataFrame([(s, i) for i, s in enumerate(("click", "error", "purchase", "signup", "view", "other"), 1)], "strategy string, position int")
    return reports.strategy_order(known, wanted).select("strategy", F.col("place").cast("long").alias("place"))


@query(f"WITH {LOG} SELECT plan, max(confidence) AS largest, round(avg(confidence), 4) AS mean, round(sum(confidence * cpu) / nullif(sum(cpu), 0), 9) AS weighted, round(least(avg(confidence) + 0.1 * ((count(DISTINCT strategy) = 1)::INT), 1), 4) AS raised FROM log GROUP BY 1")
def coordination_confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf).withColumn("weight", F.col("cpu"))
    out = reports.coordination_confidence(rows, "plan", (F.count_distinct("strategy") == 1).cast("int"))
    # Nine digits: at four, weights of a few whole numbers give ties that float noise decides.
    return out.select("plan", "largest", r4(F.col("mean")).alias("mean"), F.round("weighted", 9).alias("weighted"), r4(F.col("raised")).alias("raised"))


@query(f"WITH {LOG}, q AS (SELECT domain, strategy, tool, count(*) AS n, (count(*) FILTER (ok)) / count(*) * avg(confidence) AS quality FROM log GROUP BY 1, 2, 3) SELECT domain, strategy, tool, n, CASE WHEN n >= 5 THEN CASE WHEN quality >= 0.7 THEN 'high' WHEN quality >= 0.4 THEN 'medium' ELSE 'low' END END AS name FROM q")
def adaptation_quality(spark: SparkSession, sf: str) -> DataFrame:
    return reports.adaptation_quality(log(spark, sf), ["domain", "strategy", "tool"]).select("domain", "strategy", "tool", "n", "name")


@query(f"WITH {LOG}, {PLANS} SELECT plan, len(list_intersect(tools, ['view', 'purchase', 'click'])) / greatest(len(list_distinct(tools)), 3) AS overlap FROM plans")
def tool_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tool_overlap(plans(spark, sf), F.array(*map(F.lit, ["view", "purchase", "click"]))).select("plan", "overlap")


@query("SELECT event_id, substr(sha256(event_type || ':' || user_id::VARCHAR || ':' || props), 1, 16) AS pattern_id FROM events")
def pattern_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.substring(F.sha2(F.concat_ws(":", "event_type", F.col("user_id").cast("string"), "props"), 256), 1, 16).alias("pattern_id"))


@query("SELECT event_id, array_to_string(CASE WHEN event_id % 2 = 0 THEN [event_type, user_id::VARCHAR] ELSE [event_type, 'x ' || user_id::VARCHAR] END, '|') AS items FROM events")
def string_lists(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "'), u, F.lit('"]'))).otherwise(F.concat("event_type", F.lit(" , x "), u))
    return table(spark, sf, "events").select("event_id", F.array_join(reports.string_list(text), "|").alias("items"))


@query(f"WITH {LOG} SELECT tool, count(*) AS requests, round(avg((NOT ok)::INT), 4) AS denial_share, round(avg(CASE WHEN ok THEN seconds END), 4) AS avg_success_seconds, round(count(*) / greatest(sum(seconds), 1), 4) AS per_second FROM log GROUP BY 1")
def limiter_statistics(spark: SparkSession, sf: str) -> DataFrame:
    out = log(spark, sf).groupBy("tool").agg(F.count("*").alias("requests"), F.avg((~F.col("ok")).cast("int")).alias("denial_share"), F.avg(F.when(F.col("ok"), F.col("seconds"))).alias("avg_success_seconds"), (F.count("*") / F.greatest(F.sum("seconds"), F.lit(1.0))).alias("per_second"))
    return out.select("tool", "requests", *[r4(F.col(c)).alias(c) for c in ("denial_share", "avg_success_seconds", "per_second")])
