"""Importance resampling of documents towards a target distribution.

Features are runs of 1 to ``depth`` consecutive words, hashed into buckets. Each
Arrow batch of a partition numbers its words and sorts their positions by the
following ``depth`` words (a suffix array, by prefix doubling); neighbours with a
common prefix of n words or more form the run of one n-gram, which is hashed once,
and its bucket goes to all its occurrences. Bucket counts of corpus and target (a
bounded table) give each bucket a gain; a second pass scatters gains to occurrences
and sums them up by document. Gumbel noise from a checksum of the id makes the
highest scores a draw without replacement, ranked over sorted ranges, not in one task.

A batch is bounded in bytes, so memory is; one text longer than the bound is a batch
of its own. Batches are independent: where they end changes no count.

Defined cases: null and empty texts have no features, weight 0 and are never drawn;
texts of any length are read whole; repeated rows are scored alike and take ranks of
their own; a null document id scores as the empty text would and comes first among
equal scores; an empty target or corpus leaves gains as the formula gives them; an
empty table gives an empty result; extra columns pass through, those named like a
result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.columns import fresh, map_texts, named
from loomery.operators.ranking import positions
from loomery.session import durable

BUCKETS = 10_000
_BREAKS = bytes(set(range(0x80)) - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
#: Lower case for A-Z, a space for other ASCII characters that are no digit or letter; other bytes stay.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_BREAKS))


class _Numbers(dict):
    """Numbers words from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self) + 1
        return out


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` words from there on, by prefix doubling; the end sorts first."""
    order, ranks, width = np.argsort(ids, kind="stable"), ids.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        ahead = np.zeros_like(ranks)
        ahead[:-step] = ranks[step:]
        keys = ranks * (int(ranks.max(initial=0)) + 1) + ahead
        order = np.argsort(keys, kind="stable")
        ranks[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]] - 1) != 0)
        width += step
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the suffix array, the words it has in common with the place before, up to ``depth``."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    out = np.zeros(len(order), np.int64)
    for n in range(depth):
        same = padded[order[1:] + n] == padded[order[:-1] + n]
        out[1:] += same & (out[1:] == n)
    return out


def feature_runs(texts: pa.Array, depth: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Where each text's words begin (and the last ends), and for every n the bucket of each run, the run of each occurrence and its position."""
    words: list[bytes] = []
    starts = [0]
    for text in texts.cast(pa.binary()).to_pylist():
        if text:
            words += text.translate(_PLAIN).split()
        starts.append(len(words))
    bounds, total = np.array(starts), len(words)
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, total)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(total)
    order = suffix_order(ids, depth)
    prefixes = common_prefixes(ids, order, depth)
    found = []
    for n in range(1, depth + 1):
        whole = left[order] >= n
        at = order[whole]
        runs = np.cumsum(prefixes < n)[whole]
        first = np.flatnonzero(np.diff(runs, prepend=-1))
        hashed = np.array([crc32(b" ".join(words[p : p + n])) % buckets for p in at[first].tolist()], np.int64)
        found.append((hashed, np.cumsum(np.diff(runs, prepend=-1) != 0) - 1, at))
    return bounds, found


def bucket_counts(docs: DataFrame, depth: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n): occurrences of features over all texts; a partition sends each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for hashed, runs, _ in feature_runs(batch.column(0), depth, buckets)[1]:
                counts += np.bincount(hashed, np.bincount(runs, minlength=len(hashed)), buckets).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["new_0", "new_1"])

    return map_texts(docs, [], text, {"bucket": "long", "n": "long"}, run).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, depth: int = 1, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket; both counts have at most ``buckets`` rows."""
    s, t = (dict(map(tuple, bucket_counts(df, depth, buckets).collect())) for df in (corpus, target))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * s_all / ((s.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def weigh(docs: DataFrame, gains: list[int], depth: int = 1, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight``, the sum of gains; the text itself is dropped."""
    keep = [c for c in docs.columns if not named(c, text, "n_words", "n_features", "weight", "score", "rank")]
    table = np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, found = feature_runs(batch.column(len(keep)), depth, len(table))
            features, weights = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, np.int64)
            for hashed, runs, at in found:
                scattered, present = np.zeros(bounds[-1] + 1, np.int64), np.zeros(bounds[-1] + 1, np.int64)
                scattered[at + 1], present[at + 1] = table[hashed[runs]], 1
                weights += np.diff(np.cumsum(scattered)[bounds])
                features += np.diff(np.cumsum(present)[bounds])
            new = [pa.array(x) for x in (np.diff(bounds), features, weights)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=[*batch.schema.names[: len(keep)], "new_0", "new_1", "new_2"])

    return map_texts(docs, keep, text, {"n_words": "long", "n_features": "long", "weight": "long"}, run)


def resample(docs: DataFrame, target: DataFrame, depth: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """Add ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null where not drawn) to ``docs``; the text is dropped."""
    weighed = weigh(docs, bucket_gains(docs, target, depth, buckets), depth)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    row, late, down, at = fresh([*weighed.columns, "score", "rank"], "row", "late", "down", "at")
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn(row, F.monotonically_increasing_id())
    # The copy is small, and the ranges are sampled from it, not from the texts.
    scored = durable(scored.withColumn(late, F.col("n_words") < least_words).withColumn(down, -F.col("score")))
    drawn = F.lit(scored.where(~F.col(late)).count() * percent // 100)
    placed = positions(scored, [late, down, "doc_id", row], at)
    rank = F.when(~F.col(late) & (F.col(at) < drawn), F.col(at) + 1)
    return placed.withColumn("rank", rank).drop(row, late, down, at)
