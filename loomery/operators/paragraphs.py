"""Greedy clusters of a page's paragraphs by TF-IDF cosine, and a semantic filter over them.

Weights are fitted on one page's paragraphs, so a page is one unit of work and pages stay
where they lie. A seed meets the paragraphs that share a word with it; no matrix of all
pairs is held.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators import markup

TOKEN = re.compile(r"\b\w\w+\b")
#: Words that say little; a parameter of the functions.
STOP = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()


def weights(texts: Sequence[str], stop: frozenset[str]) -> list[dict[str, float]]:
    """Normalised smoothed TF-IDF weights of the words and word pairs of each text."""
    counts = []
    for text in texts:
        words = [w for w in TOKEN.findall(text.lower()) if w not in stop]
        counts.append(Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
    frequency = Counter(w for c in counts for w in c)
    out = []
    for c in counts:
        raw = {w: n * (math.log((1 + len(texts)) / (1 + frequency[w])) + 1) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        out.append({w: x / size for w, x in raw.items()})
    return out


def greedy(vectors: Sequence[dict[str, float]], least: float) -> list[tuple[list[int], float]]:
    """(members, mean similarity to the seed, itself included): in order, each unused text takes all unused ones near it."""
    holders = defaultdict(list)
    for i, v in enumerate(vectors):
        for w, x in v.items():
            holders[w].append((i, x))
    used, out = set(), []
    for i, v in enumerate(vectors):
        if i in used:
            continue
        near = defaultdict(float)
        for w, x in v.items():
            for j, y in holders[w]:
                near[j] += x * y
        members = [i] + sorted(j for j, s in near.items() if j != i and j not in used and s >= least)
        used.update(members)
        out.append((members, sum(near[j] for j in members) / len(members)))
    return out


def clusters(pages: DataFrame, key: str, html: str = "html", least_words: int = 10, least: float = 0.3, k: int = 3, query: str | None = None, stop: Sequence[str] = tuple(STOP)) -> DataFrame:
    """(key, place, score, members, text): the ``k`` best clusters of each page's paragraphs of ``least_words`` words or more, each a whole element.

    With a ``query``, clusters whose text is less similar to it than ``least`` go, and the
    similarity is their score. Ties keep page order; a page without such paragraphs has no row.
    """
    nodes = markup.element_table(pages, key, html)
    blocks = markup.with_text(nodes.where("tag IN ('p', 'div', 'section', 'article')"), nodes, key).where(F.size(F.split("text", r"\s+")) >= least_words)
    texts = blocks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]).alias("texts"))
    kind, skip = pages.schema[key].dataType.simpleString(), frozenset(stop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, parts in zip(batch["key"], batch["texts"], strict=True):
                parts = list(parts)
                best = [(score, members, " ".join(parts[i] for i in members)) for members, score in greedy(weights(parts, skip), least)]
                if query is not None:
                    asked, *others = weights([query, *(text for *_, text in best)], skip)
                    scored = [(sum(x * v.get(w, 0.0) for w, x in asked.items()), members, text) for v, (_, members, text) in zip(others, best, strict=True)]
                    best = [row for row in scored if row[0] >= least]
                rows += [(name, place, score, members, text) for place, (score, members, text) in enumerate(sorted(best, key=lambda x: -round(x[0], 12))[:k], 1)]
            yield pd.DataFrame(rows, columns=[key, "place", "score", "members", "text"])

    given = texts.select(F.col(key).alias("key"), "texts")
    return given.mapInPandas(run, f"`{key}` {kind}, place int, score double, members array<int>, text string")
