"""Link-graph exploration: breadth-first levels, path chains, in-links, topological generations.

Frontiers are joined with the edge table level by level; each level is written to
the shared checkpoint folder, so plans stay short and lost executors cost one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.session import durable


def breadth_first(edges: DataFrame, start: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(node, depth, parent) of nodes reached from ``start(node)`` over ``edges(src, dst, pos)``.

    A node's parent is the frontier page that comes first, by parent then link
    position. ``max_pages`` keeps the first nodes of the last level in that order,
    as a frontier limited to the pages still allowed.
    """
    seen = level = durable(start.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(start.schema["node"].dataType).alias("parent"), F.lit(0).cast("long").alias("pos")))
    count = seen.count()
    for depth in range(1, max_depth + 1):
        if max_pages is not None and count >= max_pages:
            break
        reached = level.select(F.col("node").alias("src")).join(edges, "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        first = reached.groupBy("dst").agg(F.min(F.struct("src", F.col("pos").cast("long").alias("pos"))).alias("via"))
        level = first.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.col("via.src").alias("parent"), F.col("via.pos").alias("pos"))
        if max_pages is not None:
            level = level.orderBy("parent", "pos", "node").limit(max_pages - count)
        level = durable(level)
        added = level.count()
        if not added:
            break
        count += added
        seen = seen.unionByName(level)
    return seen.select("node", "depth", "parent")


def path_chains(tree: DataFrame) -> DataFrame:
    """(node, path) from the root to every node of a (node, depth, parent) table, by depth-many self-joins."""
    done = tree.where(F.col("parent").isNull()).select("node", F.array("node").alias("path"))
    out, level, depth = done, done, 1
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    while depth <= deepest:
        step = tree.where(F.col("depth") == depth).alias("t").join(level.alias("p"), F.col("t.parent") == F.col("p.node"))
        level = durable(step.select("t.node", F.concat("p.path", F.array("t.node")).alias("path")))
        out = out.unionByName(level)
        depth += 1
    return out


def in_links(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_links"))


def depth_statistics(pages: DataFrame) -> DataFrame:
    """Pages, successes, links and their averages for each depth."""
    return pages.groupBy("depth").agg(F.count("*").alias("pages"), F.count_if("success").alias("successful"), F.sum("n_links").alias("links"), F.avg("n_links").alias("avg_links"))


def most_productive_depth(pages: DataFrame) -> DataFrame:
    """The depth whose pages hold most links, the least on a tie."""
    return pages.groupBy("depth").agg(F.sum("n_links").alias("links")).orderBy(F.desc("links"), "depth").limit(1)


def generations(needs: DataFrame) -> DataFrame:
    """(node, generation) of a dependency table (node, depends_on); raises on a cycle. Null means no dependency."""
    nodes = durable(needs.select("node").union(needs.select("depends_on").where("depends_on IS NOT NULL")).distinct())
    edges = durable(needs.where("depends_on IS NOT NULL").distinct())
    placed = None
    left, number = nodes, 0
    while not left.isEmpty():
        open_ = edges if placed is None else edges.join(placed.select(F.col("node").alias("depends_on")), "depends_on", "left_anti")
        ready = durable(left.join(open_.select("node").distinct(), "node", "left_anti").select("node", F.lit(number).alias("generation")))
        if ready.isEmpty():
            raise ValueError("the dependencies form a cycle")
        placed = ready if placed is None else durable(placed.unionByName(ready))
        left = durable(left.join(ready, "node", "left_anti"))
        number += 1
    return placed


def best_first_order(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates by score, highest first, ties by URL; with a limit, the best of them (a top-k)."""
    ordered = scored.orderBy(F.desc("score"), "url")
    return ordered.limit(limit) if limit else ordered


def top_per_group(df: DataFrame, group: str, score: str, k: int, tie: str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
