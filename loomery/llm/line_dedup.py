"""Line dedup by a suffix array over line ids, built with distributed prefix doubling.

Every document is a sequence of line ids (128-bit hashes of its non-blank lines).
Only lines that occur twice or more can take part in a repeated run, so suffixes
start there. Doubling round k ranks the pairs (rank of 2^k lines here, rank of 2^k
lines further on): pairs are counted with partial aggregation, those found once end
their suffix, and a range-partitioned sort with per-partition offsets gives the
others their rank among all suffixes, so ranks keep the suffix array's order and no
task holds a frequent line's group. Each suffix is only refined until its prefix
has ``min_words`` words.

Suffixes that share such a prefix form one longest-common-prefix interval: they are
neighbours in the suffix array, and their rank, the number of suffixes that sort
before them, is where the interval begins. So a rank from the range-partitioned sort
is the interval's name, and a run's rank pair (its first and last 2^k lines) names the
interval of its whole length. The earliest member stays, and every line that lies in a
later member is deleted. Runs that end at a line are named likewise, so a maximal
repeated run is covered to its last line. Members meet their interval's earliest one
in salted groups, so a run that many documents share is no single task's.

Order is by doc_id, then a hash of the text, then line number. Defined cases: null
and empty texts have no lines and pass unchanged; blank lines neither count nor
break a run, and are kept; a run may repeat within one text; rows that repeat both
doc_id and text are one document and get the same result; an empty table gives an
empty result; other columns pass through, ``n_lines`` and ``n_removed`` are
replaced if present, in any case of letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.columns import fresh, named
from loomery.session import durable, importable

#: Parts into which the members of one interval are dealt.
SALTS = 64
_LINES = "doc_id long, text_hash long, line int, h1 long, h2 long, forward int, back int, level int"


def run_lengths(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line: lines of the shortest run of ``min_words`` words that starts there, that ends there (0: none), and the doubling level needed."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(total, total[:-1] + min_words)
    forward = np.where(stop <= n, stop - np.arange(n), 0)
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    back = np.where(start >= 0, np.arange(1, n + 1) - start, 0)
    level = np.full(n, -1)
    # Only a run of two lines or more raises the level, over all its lines.
    for lengths, ends in ((forward, False), (back, True)):
        for i in np.flatnonzero(lengths):
            size = int(lengths[i])
            a = i - size + 1 if ends else i
            level[a : a + size] = np.maximum(level[a : a + size], size.bit_length() - 1)
    return forward, back, level


def _line_rows(min_words: int):
    import xxhash

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
                words = np.array([len(x.split()) for x in lines], np.int64)
                if words.sum() < min_words:
                    continue
                forward, back, level = run_lengths(words, min_words)
                for i in np.flatnonzero(level >= 0).tolist():
                    h = xxhash.xxh3_128_intdigest(lines[i].encode("utf-8", "surrogatepass"))
                    for col, value in zip(cols, (doc_id, text_hash, i, signed(h >> 64), signed(h & (1 << 64) - 1), int(forward[i]), int(back[i]), int(level[i])), strict=True):
                        col.append(value)
            kinds = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 3
            names = ["doc_id", "text_hash", "line", "h1", "h2", "forward", "back", "level"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def suffix_ranks(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Rank of each distinct (first, second) among all suffixes: how many sort before it.

    ``pairs`` has one row per pair and its count ``n``. Ranges of the sorted pairs
    are summed apart; the driver only holds one sum for each range.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(pairs.repartitionByRange(parts, first, second).withColumn("range", F.spark_partition_id()))
    sums = dict(ranged.groupBy("range").agg(F.sum("n")).collect())
    offsets, at = {}, 0
    for part in sorted(sums):
        offsets[part] = at
        at += sums[part]
    if not offsets:
        return ranged.select(first, second, F.lit(0).cast("long").alias("rank"))
    starts = pairs.sparkSession.createDataFrame(sorted(offsets.items()), "range int, start long")
    within = Window.partitionBy("range").orderBy(first, second).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(within), F.lit(0))
    # One row for each range: their number is a setting, not a size of the data.
    return ranged.withColumn("before", before).join(F.broadcast(starts), "range").select(first, second, (F.col("before") + F.col("start")).alias("rank"))


def _runs(group: list[dict]) -> list[tuple[int, int, int, int, int]]:
    """(lines, first rank, last rank, first line, end line) of every wholly ranked run of one document."""
    ranks = {r["line"]: r["ranks"] for r in group}
    out = set()
    for r in group:
        for size, a in ((r["forward"], r["line"]), (r["back"], r["line"] - r["back"] + 1)):
            if size:
                k = size.bit_length() - 1
                head, tail = ranks.get(a, ()), ranks.get(a + size - (1 << k), ())
                if k < len(head) and k < len(tail) and head[k] is not None and tail[k] is not None:
                    out.add((size, head[k], tail[k], a, a + size))
    return sorted(out)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "size", "head", "tail", "first", "end"]
    for batch in batches:
        rows = []
        for doc_id, text_hash, group in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows += [(doc_id, text_hash, *x) for x in _runs(group)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names=names)


def repeated_runs(docs: DataFrame, min_words: int, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, runs): line ranges of each document that repeat an earlier run."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    lines = durable(keyed.mapInArrow(_line_rows(min_words), _LINES))
    shared = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    ranks = suffix_ranks(shared, "h1", "h2")
    suffixes = lines.join(ranks, ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["doc_id", "text_hash", "line"])
    state = durable(suffixes.withColumn("ranks", F.array("rank")).withColumnRenamed("rank", "r"))
    deepest = state.agg(F.max("level")).first()[0] or 0
    for k in range(deepest):
        # Lines absent here occur once: the range frame then finds nothing and the suffix ends.
        ahead = Window.partitionBy("doc_id", "text_hash").orderBy("line").rangeBetween(1 << k, 1 << k)
        paired = durable(state.withColumn("s", F.when(F.col("level") > k, F.max("r").over(ahead))))
        pairs = paired.where("r IS NOT NULL AND s IS NOT NULL").groupBy("r", "s").agg(F.count("*").alias("n")).where("n > 1")
        ranks = suffix_ranks(pairs, "r", "s")
        state = paired.join(ranks, ["r", "s"], "left").drop("r", "s").withColumn("ranks", F.concat("ranks", F.array("rank"))).withColumnRenamed("rank", "r")
    grouped = state.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line", "forward", "back", "ranks")).alias("group"))
    runs = durable(grouped.mapInArrow(_run_rows, "doc_id long, text_hash long, size long, head long, tail long, first long, end long"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("text_hash"), F.col("first"))
    name = ["size", "head", "tail"]
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "first"), F.lit(SALTS)))
    parts = salted.groupBy(*name, "salt").agg(F.min(place).alias("keeper"), F.count("*").alias("n"))
    whole = Window.partitionBy(*name)
    intervals = parts.select(*name, "salt", F.min("keeper").over(whole).alias("keeper"), F.sum("n").over(whole).alias("n")).where("n > 1")
    later = salted.join(intervals, [*name, "salt"]).where(place > F.col("keeper"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "end")).alias("runs"))


def _strip(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
    lines = (text or "").split("\n")
    solid = [i for i, x in enumerate(lines) if x and not x.isspace()]
    gone = {solid[j] for r in runs or () for j in range(r["first"], r["end"])}
    return ("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text), len(solid), len(gone)


def dedup_lines(docs: DataFrame, min_words: int = 40, text: str = "text", names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, plus the numbers of lines and of removed ones under ``names``."""
    importable(docs.sparkSession)
    keep = [c for c in docs.columns if not named(c, *names)]
    hashed, cut = fresh(keep, "text_hash", "runs")
    found = repeated_runs(docs, min_words, text)
    left = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(f"`{text}`").alias(hashed)).alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{hashed}") == F.col("b.text_hash"))
    joined = left.join(found.alias("b"), same, "left").select(*[F.col(f"a.`{c}`") for c in keep], F.col("b.runs").alias(cut))
    # Names by position: those of the user may clash or be read as paths to fields.
    joined = joined.toDF(*(f"kept_{n}" for n in range(len(keep))), "runs")
    at = keep.index(text)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:-1]), "n_lines int, n_removed int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_strip(t, r) for t, r in zip(batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist(), strict=True)]
            cols = [*batch.columns[: len(keep)], pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())]
            cols[at] = pa.array([d[0] for d in done], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[: len(keep)], "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema).toDF(*keep, *names)
