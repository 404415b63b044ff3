"""Packing by non-negative least squares over length combinations.

Every document becomes token ids plus an end id. Full windows leave at once; what
remains of a document (1 to window - 1 ids) enters a histogram of lengths, which
has at most ``window`` entries however large the corpus is. Shallow combinations
(two or three lengths that fill a window exactly) get repeat counts by non-negative
least squares against the histogram; the counts are rounded down to what is there.
Residual remainders are packed greedily: longest first, laid end to end and cut
where a window ends; the last window splits into powers of two, which need no
padding. A remainder's place follows from its rank among those of its length, so
placing needs one shuffle of remainders and no global order; lengths that many
documents share are ranked in hashed slices.

Defined cases: a null or empty text is the end id alone; long texts are cut into
whole windows first; repeated rows (or ids) are packed once each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.tokens import word_bpe
from loomery.session import durable, importable

#: Remainders of one length that are ranked together.
SLICE = 1000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _piece_rows(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(path).ids
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                if np.frombuffer(ids, "<u4").max() > 0xFFFF:
                    raise ValueError("ids above 65,535 need a wider store")
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    length = len(part) // 4
                    packed = None if length == window else zlib.compress(np.frombuffer(part, "<u4").astype("<u2").tobytes(), 1)
                    for col, value in zip(cols, (doc_id, start, length, zlib.crc32(part), total, packed), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def combinations(lengths: np.ndarray, window: int, partners: int = 4) -> list[tuple[int, ...]]:
    """Pairs that fill the window, and triples built on each length's best-stocked partners."""
    stock = {int(x): int(n) for x, n in enumerate(lengths) if n and 0 < x < window}
    common = sorted(stock, key=lambda x: (-stock[x], x))
    found = {tuple(sorted((a, window - a))) for a in stock if window - a in stock}
    for a in stock:
        taken = 0
        for b in common:
            c = window - a - b
            if c > 0 and c in stock:
                found.add(tuple(sorted((a, b, c))))
                taken += 1
                if taken == partners:
                    break
    return sorted(found)


def solve_counts(lengths: np.ndarray, patterns: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares by coordinate descent: |A x - lengths|, A counting lengths in patterns."""
    rest = [float(n) for n in lengths]
    counts = [0.0] * len(patterns)
    columns = [[(length, pattern.count(length)) for length in sorted(set(pattern))] for pattern in patterns]
    norms = [sum(k * k for _, k in column) for column in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            step = sum(k * rest[length] for length, k in column) / norms[j]
            step = max(step, -counts[j])
            if step:
                counts[j] += step
                for length, k in column:
                    rest[length] -= k * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return np.array(counts)


def plan_packing(lengths: np.ndarray, window: int) -> dict:
    """Where the remainders of each length go, by rank: runs of slots in combinations, then the residual stream."""
    left = lengths.astype(np.int64).copy()
    patterns = combinations(lengths, window)
    repeats = np.floor(solve_counts(lengths, patterns) + 1e-9).astype(np.int64) if patterns else np.zeros(0, np.int64)
    used = np.zeros_like(left)
    runs, sequence = [], 0
    for j in np.argsort(-repeats, kind="stable"):
        pattern = patterns[j]
        times = min(int(repeats[j]), *(int(left[x]) // pattern.count(x) for x in pattern))
        if times <= 0:
            continue
        offset = 0
        for x in pattern:
            runs.append((x, int(used[x]), sequence, offset))
            used[x] += times
            left[x] -= times
            offset += x
        sequence += times
    runs.sort()
    base, at = np.zeros(len(left), np.int64), 0
    for x in range(window - 1, 0, -1):
        base[x] = at
        at += int(left[x]) * x
    # Positions of the residual stream where a sequence begins: whole windows, then falling powers of two.
    tail, begin = [], at - at % window
    for bit in range(window.bit_length() - 1, -1, -1):
        if (at - begin) >> bit & 1:
            tail.append(begin)
            begin += 1 << bit
    return {"runs": runs, "used": used, "base": base, "stream": sequence, "total": at, "tail": tail, "next": sequence + at // window + len(tail), "window": window}


def _place_rows(plan: dict):
    window = plan["window"]
    lengths = np.array([r[0] for r in plan["runs"]] or [0], np.int64)
    firsts = np.array([r[1] for r in plan["runs"]] or [0], np.int64)
    where = np.array([r[2:] for r in plan["runs"]] or [(0, 0)], np.int64)
    bounds = {x: (int(np.searchsorted(lengths, x)), int(np.searchsorted(lengths, x, "right"))) for x in range(window + 1)}
    whole = plan["total"] // window

    def stream_place(at: int) -> tuple[int, int, int]:
        """Sequence, offset and room left there, for a position of the residual stream."""
        if at < whole * window:
            return plan["stream"] + at // window, at % window, window - at % window
        n = int(np.searchsorted(plan["tail"], at, "right")) - 1
        stop = plan["tail"][n + 1] if n + 1 < len(plan["tail"]) else plan["total"]
        return plan["stream"] + whole + n, at - plan["tail"][n], stop - at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out: list[tuple] = []
            for doc_id, start, length, crc, total, ids, rank in zip(*(rows[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank")), strict=True):
                if length == window:
                    out.append((doc_id, start, length, crc, total, plan["next"] + rank, 0))
                elif rank < plan["used"][length]:
                    lo, hi = bounds[length]
                    n = lo + int(np.searchsorted(firsts[lo:hi], rank, "right")) - 1
                    out.append((doc_id, start, length, crc, total, int(where[n][0]) + rank - int(firsts[n]), int(where[n][1])))
                else:
                    at = int(plan["base"][length]) + (rank - int(plan["used"][length])) * length
                    done, numbers = 0, None
                    while done < length:
                        sequence, offset, room = stream_place(at + done)
                        size = min(room, length - done)
                        if size < length:
                            numbers = np.frombuffer(zlib.decompress(ids), "<u2").astype("<u4") if numbers is None else numbers
                            crc = zlib.crc32(numbers[done : done + size].tobytes())
                        out.append((doc_id, start + done, size, crc, total, sequence, offset))
                        done += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``tokenizer`` is a path that executors can read."""
    importable(docs.sparkSession)
    pieces = durable(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(_piece_rows(tokenizer, window, end_id), _PIECES))
    lengths = np.zeros(window + 1, np.int64)
    for length, count in pieces.groupBy("length").count().collect():
        lengths[length] = count
    plan = plan_packing(np.where(np.arange(window + 1) < window, lengths, 0), window)
    slices = F.array(*[F.lit(int(-(-n // SLICE) or 1)) for n in lengths])
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.get(slices, F.col("length"))))
    sizes = pieces.groupBy("length", "slice").count()
    # Slices are summed within blocks of SLICE, then blocks within a length: no task orders all slices of a frequent length.
    sizes = sizes.withColumn("block", F.floor(F.col("slice") / SLICE))
    earlier = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("length", "block").agg(F.sum("count").alias("count"))
    blocks = blocks.select("length", "block", earlier(Window.partitionBy("length").orderBy("block")).alias("first"))
    sizes = sizes.select("length", "slice", "block", earlier(Window.partitionBy("length", "block").orderBy("slice")).alias("within")).join(blocks, ["length", "block"])
    sizes = sizes.select("length", "slice", (F.col("first") + F.col("within")).alias("before"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1)
    ranked = ranked.join(sizes, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank").mapInArrow(_place_rows(plan), _PACKED)
