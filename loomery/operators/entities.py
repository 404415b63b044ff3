"""Entities in texts, with their places and contexts.

Texts are read where they lie, in Arrow batches; what leaves a batch are matches, never
texts. Overlaps within a kind are taken once, by an interval sweep: from the left, the
longest match that begins outside the last one taken. The best match of each value
comes from a partial aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators import page_fields
from loomery.session import importable

#: Patterns of each kind of entity; letters match in either case.
KINDS: dict[str, tuple[str, ...]] = {
    "price": (r"\$[\d,]+\.?\d*", r"€[\d,]+\.?\d*", r"£[\d,]+\.?\d*", r"[\d,]+\.?\d*\s*(USD|EUR|GBP|dollars?|euros?|pounds?)", r"Price:?\s*[\d,]+\.?\d*"),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",),
    "phone": (r"\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", r"\+?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}"),
    "date": (r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}"),
    "url": (r"https?://[^\s<>\"']+", r"www\.[^\s<>\"']+", r"[a-zA-Z0-9-]+\.[a-zA-Z]{2,}[^\s<>\"']+"),
    "company": (r"\b[A-Z][a-z]+\s+(Inc|LLC|Corp|Corporation|Ltd|Limited|Co|Company)\b", r"\b[A-Z][a-z]+\s+&\s+[A-Z][a-z]+\b"),
    "person": (r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",),
}
#: Characters around a match that are its context; shorter matches than this say nothing.
AROUND, SHORTEST = 50, 3


def spans(text: str, patterns: Sequence[re.Pattern], disjoint: bool) -> list[tuple[int, int]]:
    """(start, end) of all matches of the patterns by place; with ``disjoint`` none overlaps another."""
    found = sorted({m.span() for p in patterns for m in p.finditer(text)}, key=lambda s: (s[0], -s[1]))
    if not disjoint:
        return found
    out: list[tuple[int, int]] = []
    for start, end in found:
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def mentions(docs: DataFrame, key: str, text: str = "text", kinds: Mapping[str, Sequence[str]] | None = None, disjoint: bool = True) -> DataFrame:
    """(key, kind, value, start, end, context, named): every match; ``named`` says whether the text holds the kind's name.

    Null and empty texts have none; places count characters from 0, the end is
    exclusive; value and context are trimmed.
    """
    importable(docs.sparkSession)
    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    wanted = dict(kinds or KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {kind: [re.compile(p, re.IGNORECASE) for p in ps] for kind, ps in wanted.items()}
        for batch in batches:
            at, rows = [], []
            for n, content in enumerate(batch.column(1).to_pylist()):
                low = (content or "").lower()
                for kind, patterns in compiled.items():
                    for start, end in spans(content or "", patterns, disjoint):
                        value = content[start:end].strip()
                        if len(value) >= SHORTEST:
                            at.append(n)
                            rows.append((kind, value, start, end, content[max(0, start - AROUND) : end + AROUND].strip(), kind in low))
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=["key", "kind", "value", "start", "end", "context", "named"])

    schema = f"key {given.schema['key'].dataType.simpleString()}, kind string, value string, start int, end int, context string, named boolean"
    return given.mapInArrow(run, schema).withColumnRenamed("key", key)


def entities(docs: DataFrame, key: str, text: str = "text", kinds: Mapping[str, Sequence[str]] | None = None, least: float = 0.5, disjoint: bool = True) -> DataFrame:
    """(key, kind, value, start, context, confidence, mentions): different values, whatever their case, above a confidence; the surest mention stands, then the first."""
    found = mentions(docs, key, text, kinds, disjoint)
    sure = found.withColumn("confidence", page_fields.entity_confidence(F.col("value"), F.col("kind"), F.when(F.col("named"), F.col("kind")).otherwise("")))
    best = F.min_by(F.struct("value", "start", "context", "confidence"), F.struct((-F.col("confidence")).alias("c"), "start"))
    summed = sure.groupBy(key, "kind", F.lower("value").alias("low")).agg(best.alias("x"), F.count("*").alias("mentions"))
    return summed.where(F.col("x.confidence") > least).select(key, "kind", "x.*", "mentions")
