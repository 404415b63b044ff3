"""Quality rules with risk-controlled thresholds, in SQL functions only.

Text statistics feed a set of rules of the form "reject above a cutoff". A
configuration is a subset of the rules at a common level, from each rule's loosest
cutoff (level 1) to its strictest. For each stratum (language) and subset, labelled
holdout documents test the levels in that order: the exact binomial tail
P(X <= k | n, limit), where k good documents of n fall to any rule of the subset, must
not exceed the error divided by the number of strata and subsets (Bonferroni); the
first level that fails ends the subset. So with probability 1 - ``error`` every
admitted configuration, and whichever is chosen, rejects at most ``limit`` of the good
documents of its stratum by all its rules together. Chosen is the one that catches
most documents labelled bad, then loses fewest good ones. A stratum without enough
labels gets no cutoffs and loses no document to the rules.

Defined cases: null and empty texts have no words and fail the base rule; texts
of any length are read whole; repeated rows are judged alike; a null language belongs
to the stratum of the empty one; an empty table gives an empty result; extra columns
pass through, those named like a result column are replaced, in any case of letters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.columns import fresh, named
from loomery.session import durable

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the six counts of ``_STATS``; windows of five words are compared by 64-bit hash within one text."""
    base = docs.drop(*[c for c in docs.columns if named(c, *_STATS)])
    words_at, lines_at, grams_at, twice_at, sorted_at, places_at = fresh([*base.columns, *_STATS], "words", "lines", "grams", "twice", "ordered", "places")
    step = base.withColumn(words_at, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), ""))
    step = step.withColumn(lines_at, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(_WORD)))
    step = step.withColumns(
        {
            "n_words": F.size(words_at).cast("long"),
            "word_chars": F.length(F.array_join(words_at, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size(lines_at).cast("long"),
            "n_dup_lines": (F.size(lines_at) - F.size(F.array_distinct(lines_at))).cast("long"),
        }
    )
    words = F.col(words_at)
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    step = step.withColumn(grams_at, F.when(F.size(words) >= 6, grams))
    step = step.withColumn(twice_at, F.size(F.array_distinct(grams_at)) < F.size(grams_at))
    # Only texts that repeat a window sort them; neighbours with one hash are the repeated positions.
    ordered = F.sort_array(F.transform(F.col(grams_at), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn(sorted_at, F.when(F.col(twice_at), ordered))
    near = F.col(sorted_at)
    alike = F.filter(near, lambda x, i: ((i > 0) & (F.get(near, i - 1)["h"] == x["h"])) | F.coalesce(F.get(near, i + 1)["h"] == x["h"], F.lit(False)))
    step = step.withColumn(places_at, F.sort_array(F.transform(alike, lambda x: x["i"])))
    at = F.col(places_at)
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return step.drop(words_at, lines_at, grams_at, twice_at, sorted_at, places_at)


@dataclass(frozen=True)
class RiskRule:
    """Reject where ``value`` (SQL over the statistics) lies above a cutoff of the grid."""

    name: str
    value: str
    grid: tuple[float, ...]


RULES = (
    RiskRule("symbols", "n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    RiskRule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    RiskRule("repeated_words", "n_repeat_words / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.15)),
    RiskRule("long_words", "word_chars / greatest(n_words, 1)", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
    RiskRule("short_words", "-word_chars / greatest(n_words, 1)", (-4.5, -4.0, -3.5, -3.0, -2.5)),
    RiskRule("few_words_a_line", "-n_words / greatest(n_lines, 1)", (-8.0, -5.0, -3.0, -2.0)),
)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exactly, summed downwards from k until terms vanish."""
    if k >= n:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, factor, j = 0.0, 1.0, k
    while j >= 0 and (factor > 1e-18 * max(total, 1e-300) or j > n * p):
        total += factor
        factor *= j * (1 - p) / ((n - j + 1) * p)
        j -= 1
    return min(1.0, math.exp(log_term + math.log(total)))


def subsets(rules) -> list[tuple[int, ...]]:
    """All non-empty sets of rule numbers, by bit pattern."""
    return [tuple(n for n in range(len(rules)) if bits >> n & 1) for bits in range(1, 1 << len(rules))]


def select_cutoffs(counts: list[tuple], rules=RULES, limit: float = 0.01, error: float = 0.05) -> dict[str, list[float | None]]:
    """Cutoffs by stratum from rows (stratum, grid steps passed by each rule, good labels, bad labels).

    How many cutoffs of each rule's grid a document exceeds is all that any
    configuration needs, so one small table serves them all.
    """
    strata = sorted({c[0] for c in counts})
    sets = subsets(rules)
    tests = max(1, len(strata) * len(sets))
    levels = max((len(r.grid) for r in rules), default=0)
    chosen = {}
    for stratum in strata:
        own = [c for c in counts if c[0] == stratum]
        n, best, taken = sum(c[2] for c in own), None, None
        for number, subset in enumerate(sets):
            for level in range(1, levels + 1):
                # Level 1 needs every step of a grid to be passed, the last level one.
                hit = [c for c in own if any(c[1][r] >= max(1, len(rules[r].grid) + 1 - level) for r in subset)]
                good, bad = sum(c[2] for c in hit), sum(c[3] for c in hit)
                if not n or binomial_tail(good, n, limit) > error / tests:
                    break
                if best is None or (-bad, good, number, level) < best:
                    best, taken = (-bad, good, number, level), (subset, level)
        cutoffs: list[float | None] = [None] * len(rules)
        for r in taken[0] if taken else ():
            cutoffs[r] = rules[r].grid[max(0, len(rules[r].grid) - taken[1])]
        chosen[stratum] = cutoffs
    return chosen


def judge_quality(docs: DataFrame, labels: DataFrame, limit: float = 0.01, error: float = 0.05, rules=RULES) -> DataFrame:
    """Add the statistics, ``base_failed``, ``rejected_by`` and ``kept`` to ``docs`` (its text is dropped)."""
    docs = docs.drop(*[c for c in docs.columns if named(c, "base_failed", "rejected_by", "kept")])
    stats = durable(text_statistics(docs).drop("text"))
    stratum = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    values = [F.expr(r.value) for r in rules]
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality IS NOT NULL")
    steps = F.array(*[sum(((v > c).cast("int") for c in r.grid), F.lit(0)) for r, v in zip(rules, values, strict=True)])
    (label,) = fresh(stats.columns, "label")
    holdout = stats.join(known.select("doc_id", F.col("quality").alias(label)), "doc_id").select(stratum.alias("stratum"), steps.alias("passed"), F.col(label).alias("label"))
    # At most the product of the grids' sizes for each stratum.
    counts = holdout.groupBy("stratum", "passed").agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).collect()
    chosen = select_cutoffs([(c[0], tuple(c[1]), c[2], c[3]) for c in counts], rules, limit, error)
    kind = T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))
    if chosen:
        pairs = [y for s, cs in chosen.items() for y in (F.lit(s), F.array(*[F.lit(c).cast("double") for c in cs]))]
        cutoffs = F.try_element_at(F.create_map(*pairs), stratum)
    else:
        cutoffs = F.try_element_at(F.lit(None).cast(kind), stratum)
    broken = F.array_compact(F.array(*[F.when(v > F.get(cutoffs, F.lit(n)), F.lit(r.name)) for n, (r, v) in enumerate(zip(rules, values, strict=True))]))
    out = stats.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    out = out.withColumn("rejected_by", broken)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
