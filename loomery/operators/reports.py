"""Reports over execution logs: alerts, advice, rankings and plan checks. A log row is one step of a plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators import key_sequences

#: Limits beyond which one execution or a tool's profile is worth a word.
SLOW_SECONDS, HIGH_MEMORY_MB, HIGH_CPU, LOW_SUCCESS = 30.0, 500.0, 80.0, 0.8


def labels_where(*tests: tuple[str, Column]) -> Column:
    """The labels whose tests hold, in order; a null test does not hold."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def execution_alerts(seconds: Column, memory_mb: Column, cpu: Column) -> Column:
    """Labels of the limits that one execution passed."""
    return labels_where(("slow_execution", seconds > SLOW_SECONDS), ("high_memory", memory_mb > HIGH_MEMORY_MB), ("high_cpu", cpu > HIGH_CPU))


def tool_profiles(log: DataFrame, tool: str = "tool") -> DataFrame:
    """Executions, success rate, mean and largest time, mean memory and CPU of each tool, and overall throughput."""
    rate = F.count_if("ok") / F.count("*")
    return log.groupBy(tool).agg(F.count("*").alias("executions"), rate.alias("success_rate"), F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("max_seconds"), F.avg("memory_mb").alias("avg_memory_mb"), F.avg("cpu").alias("avg_cpu"), F.count_if(~F.col("ok")).alias("failures"))


def profile_advice(profiles: DataFrame, tool: str = "tool") -> DataFrame:
    """(tool, advice): one row for each of four limits that a tool's profile passes."""
    tests = (("reduce_execution_time", F.col("avg_seconds") > SLOW_SECONDS), ("reduce_memory", F.col("avg_memory_mb") > HIGH_MEMORY_MB), ("reduce_cpu", F.col("avg_cpu") > HIGH_CPU), ("improve_reliability", F.col("success_rate") < LOW_SUCCESS))
    return profiles.select(tool, F.explode(labels_where(*tests)).alias("advice"))


def ranked(profiles: DataFrame, by: Column, k: int, tool: str = "tool") -> DataFrame:
    """The k first tools by ``by`` with their place, ties by name."""
    top = profiles.withColumn("by", by).orderBy(F.desc("by"), tool).limit(k)
    return top.select(tool, "by", F.row_number().over(Window.orderBy(F.desc("by"), tool)).alias("place"))


def degraded(log: DataFrame, order: Sequence[str], tool: str = "tool") -> DataFrame:
    """(tool, before, after): of its last ten executions the later five are slower than the earlier five by a tenth of the mean of all."""
    last = Window.partitionBy(tool).orderBy(*[F.desc(c) for c in order])
    # The filter on the rank bounds what each task sends; the mean needs no order.
    tail = log.select(tool, "seconds", *order).withColumn("back", F.row_number().over(last)).where("back <= 10")
    parts = tail.groupBy(tool).agg(F.avg(F.when(F.col("back") <= 5, F.col("seconds"))).alias("after"), F.avg(F.when(F.col("back") > 5, F.col("seconds"))).alias("before"), F.count("*").alias("n"))
    means = log.groupBy(tool).agg(F.avg("seconds").alias("mean"))
    return parts.where("n = 10").join(means, tool).where(F.col("after") - F.col("before") > 0.1 * F.col("mean")).select(tool, "before", "after")


def error_prefixes(log: DataFrame, by: Sequence[str] = ("tool",)) -> DataFrame:
    """How often each text before the first colon stands in the errors."""
    return log.where("error IS NOT NULL").groupBy(*by, F.substring_index("error", ":", 1).alias("prefix")).agg(F.count("*").alias("n"))


def capability_gaps(intents: DataFrame, text: str, least: int = 4) -> DataFrame:
    """Counts of the words of at least ``least`` letters in intents that failed."""
    return intents.select(F.explode(F.split(F.lower(text), " ")).alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def failed_combinations(log: DataFrame, order: Sequence[str], plan: str = "plan", tool: str = "tool", least: int = 2) -> DataFrame:
    """(first, second, n): neighbouring tools of failed plans that occur ``least`` times or more."""
    steps = Window.partitionBy(plan).orderBy(*order)
    whole = Window.partitionBy(plan)
    pairs = log.select(F.col(tool).alias("first"), F.lead(tool).over(steps).alias("second"), F.min("ok").over(whole).alias("fine"))
    return pairs.where("second IS NOT NULL AND NOT fine").groupBy("first", "second").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def plans_of(log: DataFrame, order: Sequence[str], plan: str = "plan", tool: str = "tool") -> DataFrame:
    """(plan, tools, ok, seconds): each plan's tools in order; a plan holds a bounded number of steps."""
    steps = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(tool).alias("t")))), lambda x: x["t"])
    return log.groupBy(plan).agg(steps.alias("tools"), F.min("ok").alias("ok"), F.sum("seconds").alias("seconds"))


def plan_issues(tools: Column, parallel: Sequence[str], pairs: Sequence[tuple[str, str]]) -> Column:
    """Labels of a plan: a tool repeats, a tool that could run in parallel repeats, two tools of a pair stand together."""
    often = [F.size(tools) - F.size(F.array_remove(tools, t)) > 1 for t in parallel]
    both = [F.array_contains(tools, a) & F.array_contains(tools, b) for a, b in pairs]
    some = lambda tests: F.array_contains(F.array(*tests), True) if tests else F.lit(False)
    return labels_where(("repeated_tool", F.size(tools) != F.size(F.array_distinct(tools))), ("parallel", some(often)), ("inefficient_sequence", some(both)))


def pattern_statistics(plans: DataFrame) -> DataFrame:
    """Frequency, mean time, success rate and efficiency (rate by minutes) of each sequence of tools."""
    out = plans.groupBy("tools").agg(F.count("*").alias("frequency"), F.avg("seconds").alias("avg_seconds"), (F.count_if("ok") / F.count("*")).alias("success_rate"))
    return out.withColumn("efficiency", F.when(F.col("avg_seconds") > 0, F.col("success_rate") / (F.col("avg_seconds") / 60)).otherwise(0.0))


def problematic_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns with their issues, where there is one."""
    tests = (("low_success_rate", F.col("success_rate") < 0.7), ("slow", F.col("avg_seconds") > 60), ("inefficient", F.col("efficiency") < 0.5))
    return patterns.withColumn("issues", labels_where(*tests)).where(F.size("issues") > 0)


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two equally long arrays, null otherwise."""
    return F.when(F.size(a) == F.size(b), F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)))


def near_patterns(patterns: DataFrame, goal: Column, rate: float = 0.9, efficiency: float = 1.0) -> DataFrame:
    """Good patterns that differ from ``goal`` in one or two places."""
    return patterns.withColumn("distance", hamming(F.col("tools"), goal)).where(F.col("distance").between(1, 2) & (F.col("success_rate") > rate) & (F.col("efficiency") > efficiency))


def best_orders(plans: DataFrame) -> DataFrame:
    """For each set of tools the order of highest quality by 1 + time; a failed plan has quality 0. Ties go to the first order."""
    score = F.when(F.col("ok"), 1.0).otherwise(0.0) / (1 + F.col("seconds"))
    best = F.min(F.struct((-score).alias("m"), F.array_join("tools", ">").alias("order")))
    return plans.groupBy(F.array_join(F.array_sort("tools"), ",").alias("tool_set")).agg(best.alias("b"), F.count("*").alias("plans")).select("tool_set", F.col("b.order").alias("best_order"), (-F.col("b.m")).alias("score"), "plans")


def attempt_rates(log: DataFrame, by: Sequence[str], least: int = 1) -> DataFrame:
    """Attempts, successes and success rate of each key with ``least`` attempts or more."""
    out = log.groupBy(*by).agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"))
    return out.where(F.col("attempts") >= least).withColumn("rate", F.col("successes") / F.col("attempts"))


def best_strategy(css_rate: Column, llm_rate: Column, margin: float = 0.1) -> Column:
    return F.when(css_rate > llm_rate + margin, "css").when(llm_rate > css_rate + margin, "llm").otherwise("hybrid")


def last_rows(log: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The ``most`` latest rows of each key: a bounded history."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most).drop("back")


def recent_modes(log: DataFrame, by: str, order: Sequence[str], value: str, most: int = 10) -> DataFrame:
    """The most frequent value among the last successes of each key, the least on a tie."""
    counts = last_rows(log.where("ok"), [by], order, most).groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def rolling_profile(log: DataFrame, order: Sequence[str], tool: str = "tool", rows: int = 100) -> DataFrame:
    """Every execution with the tool's profile up to it: sum over the last rows and their number, least, largest and errors over all."""
    s = F.col("seconds")
    all_of = {"least": ("min", s), "most": ("max", s), "errors": ("sum", (~F.col("ok")).cast("long"))}
    near = key_sequences.trailing(log, tool, order, {"near_sum": ("sum", s), "near_rows": ("count", s)}, rows)
    return key_sequences.running(near, tool, order, all_of)


def job_progress(jobs: DataFrame) -> DataFrame:
    """Percent done, seconds elapsed and left of each job (job, total, done, elapsed)."""
    left = F.when(F.col("done") > 0, (F.col("total") - F.col("done")) * F.col("elapsed") / F.col("done"))
    return jobs.select("job", (F.col("done") * 100.0 / F.col("total")).alias("percent"), "elapsed", left.alias("seconds_left"))


def system_metrics(jobs: DataFrame) -> DataFrame:
    """Jobs by state, URLs a minute and success share over all jobs (state, done, succeeded, elapsed)."""
    states = [F.count_if(F.col("state") == s).alias(f"{s}_jobs") for s in ("pending", "running", "completed", "failed")]
    return jobs.agg(*states, F.try_divide(F.sum("done") * 60.0, F.sum("elapsed")).alias("urls_per_minute"), F.try_divide(F.sum("succeeded") * 100.0, F.sum("done")).alias("success_percent"))


def strategy_order(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted strategies (strategy, position): those with a success rate first, best first, then the others as they were."""
    return wanted.join(known.select("strategy", "rate"), "strategy", "left").withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("rate"), "position")))


def dispatch_order(tasks: DataFrame, priority: str, position: str) -> DataFrame:
    """High before medium before low, otherwise as they came; places by range-partitioned sort would need no single task, callers limit the tasks."""
    rank = F.when(F.col(priority) == "high", 0).when(F.col(priority) == "medium", 1).otherwise(2)
    return tasks.withColumn("rank", rank).orderBy("rank", position)


def coordination_confidence(results: DataFrame, by: str, consensus: Column) -> DataFrame:
    """Largest, mean and weight-averaged confidence of each key's results (confidence, weight), the mean raised by the consensus share and held at 1."""
    out = results.groupBy(by).agg(F.max("confidence").alias("largest"), F.avg("confidence").alias("mean"), F.try_divide(F.sum(F.col("confidence") * F.col("weight")), F.sum("weight")).alias("weighted"), consensus.alias("consensus"))
    return out.withColumn("raised", F.least(F.col("mean") + 0.1 * F.col("consensus"), F.lit(1.0)))


def adaptation_quality(log: DataFrame, by: Sequence[str], least: int = 5) -> DataFrame:
    """Success rate times mean confidence of each key, named high from .7, medium from .4, else low; only keys with enough rows are named."""
    out = log.groupBy(*by).agg(F.count("*").alias("n"), (F.count_if("ok") / F.count("*") * F.avg("confidence")).alias("quality"))
    return out.withColumn("name", F.when(F.col("n") >= least, F.when(F.col("quality") >= 0.7, "high").when(F.col("quality") >= 0.4, "medium").otherwise("low")))


def tool_overlap(plans: DataFrame, goal: Column) -> DataFrame:
    """Share of common tools: |common| by the larger of both sets."""
    tools = F.array_distinct("tools")
    return plans.withColumn("overlap", F.size(F.array_intersect(tools, goal)) / F.greatest(F.size(tools), F.size(F.array_distinct(goal))))


def string_list(text: Column) -> Column:
    """A list from a JSON list, else from text cut at commas."""
    return F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.transform(F.split(text, ","), lambda x: F.trim(x)))


def content_by_depth(pages: DataFrame) -> DataFrame:
    """(depth, pages, length, links, avg_length, avg_links, richest, most_connected) of successful pages; the flags mark the leading depth, the least on a tie."""
    out = pages.where("success").groupBy("depth").agg(F.count("*").alias("pages"), F.sum("length").alias("length"), F.sum("n_links").alias("links"), F.avg("length").alias("avg_length"), F.avg("n_links").alias("avg_links"))
    best = out.agg(F.min_by("depth", F.struct(-F.col("avg_length"), F.col("depth"))).alias("long"), F.min_by("depth", F.struct(-F.col("avg_links"), F.col("depth"))).alias("linked"))
    return out.join(F.broadcast(best)).select(*out.columns, (F.col("depth") == F.col("long")).alias("richest"), (F.col("depth") == F.col("linked")).alias("most_connected"))


def performance_rollup(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attempts and success rate at every level of ``by``, from all rows to single keys; a null key stands for all of its values."""
    return log.rollup(*by).agg(F.count("*").alias("attempts"), (F.count_if("ok") / F.count("*")).alias("rate"))


def improvement_areas(profiles: DataFrame, k: int = 3, below: float = LOW_SUCCESS) -> DataFrame:
    """Of the ``k`` tools of lowest success rate those under ``below``."""
    return profiles.orderBy("success_rate", "tool").limit(k).where(F.col("success_rate") < below)


def recommendations(overall: DataFrame, profiles: DataFrame, failures: DataFrame, k: int = 5) -> DataFrame:
    """(place, kind, subject): the first ``k`` of: low overall rate (success_rate), weak and slow tools by name, common failure classes (failure, n)."""
    rows = overall.where("success_rate < 0.7").select(F.lit(0).alias("step"), F.lit("").alias("subject"), F.lit("low_success_rate").alias("kind"))
    rows = rows.unionByName(profiles.where("success_rate < 0.6").select(F.lit(1).alias("step"), F.col("tool").alias("subject"), F.lit("weak_tool").alias("kind")))
    rows = rows.unionByName(profiles.where("avg_seconds > 30").select(F.lit(1).alias("step"), F.col("tool").alias("subject"), F.lit("slow_tool").alias("kind")))
    rows = rows.unionByName(failures.where("n > 5").select(F.lit(2).alias("step"), F.col("failure").alias("subject"), F.lit("common_failure").alias("kind")))
    best = rows.orderBy("step", "subject", F.desc("kind")).limit(k)
    return best.select(F.row_number().over(Window.orderBy("step", "subject", F.desc("kind"))).alias("place"), "kind", "subject")


def common_fields(log: DataFrame, value: str, by: str, k: int = 10, above: float = 0.8) -> DataFrame:
    """(by, value, n, place): the ``k`` most frequent values of each key among its rows of confidence above ``above``."""
    counts = log.where(F.col("confidence") > above).groupBy(by, value).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def constant_parameters(calls: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Parameters (by) that had one value in all calls, with it."""
    return calls.groupBy(*by).agg(F.min(value).alias("value"), F.max(value).alias("top"), F.count(value).alias("n")).where("value = top AND n > 1").drop("top")


def failed_plans(plans: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` latest failed plans with their tools."""
    return plans.where(~F.col("ok")).orderBy(F.desc("plan")).limit(k)


def renumbered(tools: Column, confidence: Column) -> Column:
    """A plan taken over from a pattern: steps numbered from 1, a tenth less confidence."""
    return F.struct(F.transform(tools, lambda t, i: F.struct((i + 1).alias("step"), t.alias("tool"))).alias("steps"), (confidence * 0.9).alias("confidence"))
