"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.session import durable

#: Links up to which their nodes may be broadcast: at about 60 bytes each, 12 MB.
MOST_BROADCAST = 100_000
ROWS_A_TASK = 20_000


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b); a component is its least node.

    Alternating large-star and small-star steps: every step regroups links with
    partial aggregation and adds no more links than it had, so neither a long chain
    nor a hub gathers in one task beyond a count of its neighbours' least. While
    the links are few, the table of least neighbours is broadcast.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = _checksum(edges)
    while seen[0]:
        sent = F.broadcast if seen[0] <= MOST_BROADCAST else lambda df: df
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(sent(least), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = large.where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(sent(low), "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(low.select("a", F.col("least").alias("b")))
        # Links never grow, so their number so far bounds the tasks that the next step needs.
        edges = durable(small.where("a <> b").distinct().coalesce(-(-seen[0] // ROWS_A_TASK)))
        before, seen = seen, _checksum(edges)
        if seen == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
