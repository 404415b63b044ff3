"""Reports over explored pages: (url, depth, parent, success, n_links, seconds, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions import urls
from loomery.operators.ranking import positions
from loomery.session import durable


def crawl_statistics(pages: DataFrame) -> DataFrame:
    """One row: pages, successes, success rate, links, mean time, distinct hosts, greatest depth."""
    return pages.agg(
        F.count("*").alias("pages"), F.count_if("success").alias("successful"), (F.count_if("success") / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"), F.sum("n_links").alias("links"),
        F.avg("seconds").alias("avg_seconds"), F.count_distinct(urls.host(F.col("url"))).alias("hosts"), F.max("depth").alias("max_depth"),
    )


def site_map(pages: DataFrame) -> DataFrame:
    """Every page under its depth, with the depth's page count: (depth, n, url, parent, n_links), one row a page.

    Flat rows, for a depth may hold most pages; depths are few, so their counts are broadcast.
    """
    counts = pages.groupBy("depth").agg(F.count("*").alias("n"))
    return pages.join(F.broadcast(counts), "depth").select("depth", "n", "url", "parent", "n_links")


def depth_report(pages: DataFrame) -> DataFrame:
    """Each depth's share of pages and the running share down to it."""
    counts = pages.groupBy("depth").agg(F.count("*").alias("n"))
    total = pages.agg(F.count("*").alias("total"))
    shares = counts.join(F.broadcast(total)).select("depth", "n", (F.col("n") / F.col("total")).alias("share"))
    return shares.withColumn("reached", F.sum("share").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)))


def discovery_efficiency(pages: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Share of successful pages that score above the threshold."""
    return pages.where("success").agg(F.coalesce(F.avg((F.col("score") > threshold).cast("int")), F.lit(0.0)).alias("efficiency"), F.count("*").alias("n"))


def enrich_scores(pages: DataFrame, scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pages with their score (0 if none), whether it passes, and its bucket of four."""
    joined = pages.join(scores, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    bucket = F.when(F.col("score") >= 0.8, "excellent").when(F.col("score") >= 0.6, "good").when(F.col("score") >= 0.4, "fair").otherwise("poor")
    return joined.withColumns({"passes": F.col("score") >= threshold, "bucket": bucket})


def depth_first_order(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, depth, at): pre-order of a breadth-first tree, children by link position.

    A node's sort key is the list of positions on its path, so the order is one
    range-partitioned sort.
    """
    position = edges.groupBy(F.col("src").alias("parent"), F.col("dst").alias("node")).agg(F.min("pos").cast("long").alias("pos"))
    placed = tree.join(position, ["parent", "node"], "left").select("node", "parent", "depth", F.coalesce("pos", F.lit(0)).alias("pos"))
    level = done = placed.where("depth = 0").select("node", "depth", F.array("pos").alias("key"))
    for depth in range(1, (tree.agg(F.max("depth")).first()[0] or 0) + 1):
        step = placed.where(F.col("depth") == depth).alias("t").join(level.alias("p"), F.col("t.parent") == F.col("p.node"))
        level = durable(step.select("t.node", F.lit(depth).alias("depth"), F.concat("p.key", F.array("t.pos")).alias("key")))
        done = done.unionByName(level)
    return positions(done, ["key", "node"], "at").select("node", "depth", "at")


def evict(patterns: DataFrame, now: Column, days: int = 30, most: int | None = None) -> DataFrame:
    """Learned patterns that are still worth keeping: fresh, and not both well tried and failing; the newest ``most``."""
    fresh = F.col("last_used") >= now - F.make_dt_interval(days=F.lit(days))
    failing = (F.col("n") >= 10) & (F.col("rate") < 0.3) & (F.col("confidence") < 0.4)
    kept = patterns.where(fresh & ~failing)
    return kept.orderBy(F.desc("last_used"), "pattern").limit(most) if most else kept
