"""Matching requests to the tools of a catalogue.

A catalogue of keywords is a parameter of the job, as word lists are, so each of its
matches is a column expression over the requests and needs no join; these matches are
arrays of struct(tool, score). ``text_matches`` searches a catalogue that is a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators import similarity
from loomery.session import durable

#: A table of so many rows at most is sent to every task.
BROADCAST_ROWS = 300_000


def _hits(low: Column, words: Sequence[str]) -> Column:
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def _any(low: Column, words: Sequence[str]) -> Column:
    return _hits(low, words) > 0


def _matches(scores: Mapping[str, Column]) -> Column:
    """struct(tool, score) of the tools that score above 0, in the catalogue's order."""
    return F.array_compact(F.array(*[F.when(score > 0, F.struct(F.lit(tool).alias("tool"), score.cast("double").alias("score"))) for tool, score in scores.items()]))


def keyword_matches(request: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """The share of a tool's keywords that stand in the request, by .8."""
    low = F.lower(request)
    return _matches({tool: _hits(low, words) / len(words) * 0.8 for tool, words in keywords.items() if words})


def capability_matches(wanted: Column, inputs: Column, outputs: Column, tools: Mapping[str, tuple[Sequence[str], Sequence[str], Sequence[str]]]) -> Column:
    """The share of wanted capabilities that a tool has, .3 more if it takes one of the inputs, .3 if it gives one of the outputs."""

    def score(own: tuple[Sequence[str], Sequence[str], Sequence[str]]) -> Column:
        able, takes, gives = (F.array(*map(F.lit, x)).cast("array<string>") for x in own)
        share = F.size(F.array_intersect(wanted, able)) / F.greatest(F.size(wanted), F.lit(1))
        return share + F.when(F.arrays_overlap(inputs, takes), 0.3).otherwise(0.0) + F.when(F.arrays_overlap(outputs, gives), 0.3).otherwise(0.0)

    return _matches({tool: score(own) for tool, own in tools.items()})


def best_tools(matches: Sequence[Column], quality: Mapping[str, tuple[float, float]], k: int = 5) -> Column:
    """The ``k`` best tools of several matchers: the largest score at .6, performance and reliability at .2 each; ties by name."""
    found = F.concat(*matches)

    def final(tool: str, performance: float, reliability: float) -> Column:
        top = F.array_max(F.transform(F.filter(found, lambda m: m["tool"] == tool), lambda m: m["score"]))
        score = 0.6 * top + 0.2 * performance + 0.2 * reliability
        return F.when(top.isNotNull(), F.struct((-score).alias("down"), F.lit(tool).alias("tool")))

    ranked = F.array_sort(F.array_compact(F.array(*[final(t, *q) for t, q in quality.items()])))
    return F.slice(F.transform(ranked, lambda x: F.struct(x["tool"].alias("tool"), (-x["down"]).alias("score"))), 1, k)


def intent_scores(request: Column, capabilities: Mapping[str, Sequence[str]], groups: Sequence[Sequence[str]]) -> Column:
    """2 for each of a tool's capabilities that the request names, 1 for each in a group of synonyms that it touches."""
    low = F.lower(request)

    def score(own: Sequence[str]) -> Column:
        total = F.lit(0.0)
        for capability in own:
            total = total + F.when(F.contains(low, F.lit(capability.lower())), 2.0).otherwise(0.0)
            for group in groups:
                if any(w in capability.lower() for w in group):
                    total = total + F.when(_any(low, group), 1.0).otherwise(0.0)
        return total

    return _matches({tool: score(own) for tool, own in capabilities.items()})


def template_match(request: Column, keywords: Sequence[str]) -> Column:
    """Share of a template's keywords in the request."""
    return _hits(F.lower(request), keywords) / len(keywords)


def expanded_template(available: Column, template: Sequence[str]) -> Column:
    """A template's tools that are available; a name ending in * stands for the first available tool that begins so."""

    def step(name: str) -> Column:
        if name.endswith("*"):
            return F.get(F.filter(available, lambda t: F.startswith(t, F.lit(name[:-1]))), 0)
        return F.when(F.array_contains(available, name), name)

    return F.array_compact(F.array(*map(step, template)))


def alternatives(catalogue: DataFrame) -> DataFrame:
    """(tool, other): different tools of a catalogue (tool, capability) that share a capability."""
    other = catalogue.select(F.col("tool").alias("other"), "capability")
    return catalogue.join(other, "capability").where("tool <> other").select("tool", "other").distinct()


def faster_alternatives(profiles: DataFrame, others: DataFrame, below: float = 0.7) -> DataFrame:
    """(tool, other, saved) of alternatives (tool, other) whose mean time lies under ``below`` of the tool's; profiles are (tool, avg_seconds)."""
    mine = profiles.select("tool", F.col("avg_seconds").alias("own"))
    theirs = profiles.select(F.col("tool").alias("other"), F.col("avg_seconds").alias("their"))
    met = others.join(mine, "tool").join(theirs, "other").where(F.col("their") < below * F.col("own"))
    return met.select("tool", "other", (F.col("own") - F.col("their")).alias("saved"))


def text_matches(requests: DataFrame, request: str, catalogue: DataFrame, tool: str, k: int, least: float = 0.1, text: str = "text", words: str = r"\W+") -> DataFrame:
    """(request, tool, score, place, touched): the ``k`` tools of a table whose texts are most like each request's, above a cosine of ``least``.

    Weights are TF-IDF, fitted on the catalogue. An inverted index of its words is
    searched with upper bounds. A word adds at most its request weight times its largest
    weight in the catalogue; the words with the smallest bounds whose sum stays within
    ``least`` can't make a match alone, so they fetch no tools. What the others add is a
    tool's partial score; a tool that can't reach the k-th best partial score of its
    request even with all the bounds left out goes before it is scored in full.
    ``touched`` counts the tools that a request fetched. Exact; ties go by the tool's name.

    Words are runs of letters, digits and underscores of two characters or more.
    """
    split = lambda c: F.filter(F.split(F.lower(c), words), lambda w: F.length(w) > 1)
    index = durable(similarity.tf_idf(catalogue, tool, split(F.col(text))))
    # A counted, small index goes to the requests; a large one meets them by word.
    small = F.broadcast if index.count() <= BROADCAST_ROWS else (lambda df: df)
    total = catalogue.agg(F.count("*").alias("tools"))
    known = index.groupBy("word").agg(F.count("*").alias("df"), F.max("weight").alias("most")).join(F.broadcast(total))
    # Texts are dealt by request once; counts, weights and ranks of a request stay where it is.
    dealt = requests.select(F.col(request), F.col(text).alias("text")).repartition(request)
    words_of = dealt.select(request, F.explode(split(F.col("text"))).alias("word")).join(small(known), "word")
    counts = words_of.groupBy(request, "word", "df", "most", "tools").agg(F.count("*").alias("tf"))
    raw = counts.withColumn("raw", F.col("tf") * (F.log((1 + F.col("tools")) / (1 + F.col("df"))) + 1))
    whole = Window.partitionBy(request)
    asked = raw.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(whole))).withColumn("bound", F.col("weight") * F.col("most"))
    rising = whole.orderBy("bound", "word").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("fetches", F.sum("bound").over(rising) > least - 1e-9)
    asked = durable(asked.withColumn("rest", F.sum(F.when(~F.col("fetches"), F.col("bound"))).over(whole)).select(request, "word", "weight", "fetches", "rest"))
    held = index.select(tool, "word", F.col("weight").alias("own"))
    partial = asked.where("fetches").join(small(held), "word").groupBy(request, tool).agg(F.sum(F.col("weight") * F.col("own")).alias("partial"), F.max("rest").alias("rest"))
    best = whole.orderBy(F.desc("partial"), tool)
    met = partial.withColumn("at", F.row_number().over(best)).withColumn("touched", F.count("*").over(whole))
    met = met.withColumn("floor", F.max(F.when(F.col("at") == k, F.col("partial"))).over(whole))
    able = met.where(F.col("partial") + F.coalesce("rest", F.lit(0.0)) >= F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(least)) - 1e-9)
    able = durable(able.select(request, tool, "partial", "touched"))
    late = asked.where("NOT fetches").join(able.select(request, tool), request).join(small(held), [tool, "word"]).groupBy(request, tool).agg(F.sum(F.col("weight") * F.col("own")).alias("late"))
    scored = able.join(late, [request, tool], "left").withColumn("score", F.col("partial") + F.coalesce("late", F.lit(0.0))).where(F.col("score") > least)
    placed = scored.withColumn("place", F.row_number().over(whole.orderBy(F.desc(F.round("score", 12)), tool)))
    return placed.where(F.col("place") <= k).select(request, tool, "score", "place", "touched")
