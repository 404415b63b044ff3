"""Walks over stored pages: next links by pointer jumping, and best-first discovery with a bounded queue in batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators import url_predicates
from loomery.operators.ranking import positions
from loomery.session import durable


def paginated(pages: DataFrame, starts: DataFrame, url: str = "url", next_url: str = "next_url", most: int = 10) -> DataFrame:
    """(start, page_no, url, stop): the pages that next links lead to from each start, at most ``most``; ``stop``, in the last row, says why it ends.

    Pointers double: after round n a page knows the one 2^n links ahead, and a walk is
    twice as long, so ``most`` pages take log2(most) rounds whatever the length of a
    chain. ``stop`` is no_next, missing (the next page is not stored), cycle (it was
    visited before) or max_pages. A page that is not stored is no row; ``pages`` has one
    row for each url.
    """
    known = pages.select(F.col(url).alias("at"), F.col(next_url).alias("ahead")).hint("merge")
    stored = known.select(F.col("at").alias("ahead"))
    # Pages may come from rows that are built or exploded, whose size Spark guesses too low: nothing here is broadcast.
    kept = lambda df: durable(df).hint("merge")
    jumps = kept(known.where("ahead IS NOT NULL").join(stored, "ahead", "left_semi").select("at", "ahead"))
    walk = starts.select(F.col(url).alias("at")).distinct().join(known.select("at"), "at", "left_semi").select(F.col("at").alias("start"), F.lit(0).alias("page_no"), "at").hint("merge")
    reach = 1
    while reach < most:
        further = walk.join(jumps, "at").select("start", (F.col("page_no") + reach).alias("page_no"), F.col("ahead").alias("at"))
        # A cycle only repeats what is known: the first visit counts.
        walk = kept(walk.unionByName(further).where(F.col("page_no") < most).groupBy("start", "at").agg(F.min("page_no").alias("page_no")).select("start", "page_no", "at"))
        reach *= 2
        if reach < most:
            jumps = kept(jumps.join(jumps.select(F.col("at").alias("ahead"), F.col("ahead").alias("further")), "ahead").select("at", F.col("further").alias("ahead")))
    ends = walk.groupBy("start").agg(F.max("page_no").alias("page_no"), F.max_by("at", "page_no").alias("at")).join(known, "at").select("start", "page_no", "ahead").hint("merge")
    visited = walk.select("start", F.col("at").alias("ahead"), F.lit(True).alias("visited"))
    there = stored.withColumn("stored", F.lit(True))
    ends = ends.join(visited, ["start", "ahead"], "left").join(there, "ahead", "left")
    stop = F.when(F.col("ahead").isNull(), "no_next").when(F.col("stored").isNull(), "missing").when(F.col("visited"), "cycle").otherwise("max_pages")
    return walk.join(ends.select("start", "page_no", stop.alias("stop")), ["start", "page_no"], "left").select("start", "page_no", F.col("at").alias(url), "stop")


def boosted(score: Column, parent: Column, boosts: Sequence[float] = ()) -> Column:
    """A link's score after its parent's quality and the walk's own boosts, at most 1."""
    raised = score * F.when(parent > 0.8, 1.2).when(parent > 0.6, 1.1).otherwise(1.0)
    for boost in boosts:
        raised = raised * boost
    return F.least(raised, F.lit(1.0))


def best_first(links: DataFrame, scores: DataFrame, starts: DataFrame, most: int, max_depth: int = 3, batch: int = 100, boosts: Mapping[str, Sequence[str]] | None = None, trend: float = 2.0) -> DataFrame:
    """(visit, round, url, depth, parent, score): pages in the order of a priority queue that takes ``batch`` pages at a time.

    ``links`` are (src, dst), ``scores`` (url, score, and ``content``, the length of a
    page's text). A round takes the best of the queue by score, then url, by a
    distributed top-k; what they link to joins the queue with its score, raised for good
    parents, while fewer than three of the kinds in ``boosts`` (words looked for in
    visited urls) were found, and while the last five pages hold ``trend`` thousand
    characters on average. The queue keeps its ``most`` best rows, ranked over sorted
    ranges where it holds more. With a batch of one the
    order is that of a heap. A page is queued once, by the parent visited first.
    """
    kinds = dict(boosts or {})
    known = scores.select("url", F.col("score").cast("double").alias("score"), F.coalesce("content", F.lit(0)).alias("content"))
    queue = durable(starts.select("url").distinct().join(known, "url").select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), "score", "content"))
    seen = queue.select("url")
    visited, count, turn, found, recent = None, 0, 0, set(), []
    while count < most:
        chosen = durable(queue.orderBy(F.desc("score"), "url").limit(min(batch, most - count)))
        # A round's rows are bounded by the batch; only lengths and kinds come to the driver.
        marks = [F.max(F.when(F.lower("url").rlike("|".join(words)), 1)).alias(f"kind_{n}") for n, words in enumerate(kinds.values())]
        tail = chosen.orderBy("score", F.desc("url")).limit(5).select("content").collect()
        n, *held = chosen.agg(F.count("*"), *marks).first()
        if not n:
            break
        placed = chosen.withColumn("round", F.lit(turn)).withColumn("offset", F.lit(count))
        visited = placed if visited is None else visited.unionByName(placed)
        found |= {name for name, hit in zip(kinds, held, strict=True) if hit}
        recent = (recent + [r["content"] for r in reversed(tail)])[-5:]
        count, turn = count + n, turn + 1
        boost = [1.15] * (sum(recent) / len(recent) / 1000 > trend) + [1.1] * (bool(kinds) and len(found) < 3)
        parents = chosen.where(F.col("depth") < max_depth).select(F.col("url").alias("src"), "depth", F.col("score").alias("above"))
        fresh = links.select("src", F.col("dst").alias("url")).distinct().join(parents, "src").join(seen, "url", "left_anti").join(known, "url")
        first = fresh.groupBy("url").agg(F.min(F.struct((-F.col("above")).alias("low"), "src", "depth")).alias("p"), F.first("score").alias("score"), F.first("content").alias("content"))
        added = first.select("url", (F.col("p.depth") + 1).alias("depth"), F.col("p.src").alias("parent"), boosted(F.col("score"), -F.col("p.low"), boost).alias("score"), "content")
        added = durable(added)
        seen = durable(seen.unionByName(added.select("url")))
        queue = durable(queue.join(chosen.select("url"), "url", "left_anti").unionByName(added))
        if queue.count() > most:
            queue = positions(queue.withColumn("down", -F.col("score")), ["down", "url"], "place").where(F.col("place") < most).drop("down", "place")
    if visited is None:
        return queue.select(F.lit(0).alias("visit"), F.lit(0).alias("round"), "url", "depth", "parent", "score")
    within = F.row_number().over(Window.partitionBy("round").orderBy(F.desc("score"), "url"))
    return visited.select((F.col("offset") + within - 1).alias("visit"), "round", "url", "depth", "parent", "score")


#: What each goal of a discovery includes, as patterns of urls.
GOALS = {
    "contact_information": ("*/contact*", "*/about*", "*/team*", "*/location*"),
    "product_catalog": ("*/product*", "*/service*", "*/solution*", "*/catalog*"),
    "company_information": ("*/about*", "*/company*", "*/history*", "*/mission*"),
    "news_content": ("*/news*", "*/blog*", "*/press*", "*/announcement*"),
    "comprehensive_analysis": (),
}


def goal_pages(walk: DataFrame, goal: str, least: float = 0.7) -> DataFrame:
    """(url, depth, score, meets, place): visited pages that a goal's patterns admit (starts always), best first."""
    patterns = GOALS[goal]
    rows = walk.where(url_predicates.matches_globs(F.col("url"), patterns) | (F.col("depth") == 0)) if patterns else walk
    placed = positions(rows.withColumn("down", -F.col("score")), ["down", "url"], "place")
    return placed.select("url", "depth", "score", (F.col("score") >= least).alias("meets"), "place")
