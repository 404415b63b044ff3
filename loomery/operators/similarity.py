"""Vector search and text similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.session import durable


#: Vectors in a block at most, of the searched and of the queries: a block pair's similarities fill 1 MB.
BLOCK, QUERY_BLOCK = 1024, 128


def _packed(vectors: DataFrame, key: str, group: Column, vector: str, most: int, names: tuple[str, str, str]) -> DataFrame:
    """Blocks (ids, block, group) of vectors of one group; vectors that are null or without direction are similar to none and left out.

    They are stored, so the task that compares them needs no second Python worker, and none is packed again for each part of the other side.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            at: dict = {}
            for i, g in enumerate(groups):
                at.setdefault(g, []).append(i)
            rows = [(rows[i : i + most], g) for g, rows in at.items() for i in range(0, len(rows), most)]
            values = [np.array(batch.column(2).take(pa.array(r)).to_pylist(), np.float64) for r, _ in rows]
            keep = [(v * v).sum(axis=1) > 0 for v in values]
            arrays = [
                pa.array([ids[r][k] for (r, _), k in zip(rows, keep, strict=True)], pa.list_(pa.int64())),
                pa.array([v[k].tobytes() for v, k in zip(values, keep, strict=True)], pa.binary()),
                pa.array([g for _, g in rows], batch.column(1).type),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=list(names))

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), group.alias("group"), vector)
    return durable(rows.mapInArrow(blocks, f"{names[0]} array<long>, {names[1]} binary, {names[2]} {rows.schema['group'].dataType.simpleString()}"))


def _best_of_blocks(k: int):
    """From block pairs (q_ids, q, ids, v, group): each task's k best of each query and group."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column(4).type
            for q_ids, q, ids, v, group in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not q_ids or not ids:
                    continue
                q, v = (np.frombuffer(x, np.float64).reshape(len(n), -1).T for x, n in ((q, q_ids), (v, ids)))
                # Summed in the order of the components, so equal vectors tie exactly wherever they lie.
                both, own, other = np.zeros((len(ids), len(q_ids))), np.zeros(len(ids)), np.zeros(len(q_ids))
                for x, y in zip(v, q, strict=True):
                    both += x[:, None] * y
                    own += x * x
                    other += y * y
                found, names = both / np.sqrt(own[:, None] * other), np.repeat(np.array(ids)[:, None], len(q_ids), axis=1)
                at = (tuple(q_ids), group)
                if at in best:
                    found, names = np.concatenate([best[at][0], found]), np.concatenate([best[at][1], names])
                first = np.lexsort((names, -found), axis=0)[:k]
                best[at] = np.take_along_axis(found, first, 0), np.take_along_axis(names, first, 0)
        for (q_ids, group), (found, names) in best.items():
            arrays = [pa.array(np.tile(q_ids, len(found))), pa.array(names.ravel()), pa.array([group] * found.size, kind), pa.array(found.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "key", "group", "similarity"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", group: str | None = None) -> DataFrame:
    """(query, key, group, similarity): the k vectors most similar by cosine to each row of ``queries``, ties by key.

    Blocks of vectors meet blocks of queries; a task keeps its k best of each query
    (with ``group``, of each collection) before the shuffle. All vectors have as many components.
    """
    one = F.lit(0)
    asked = _packed(queries, key, one, vector, QUERY_BLOCK, ("q_ids", "q", "q_group"))
    blocks = _packed(vectors, key, F.col(group) if group else one, vector, BLOCK, ("ids", "v", "group"))
    kind = blocks.schema["group"].dataType.simpleString()
    found = blocks.crossJoin(asked).select("q_ids", "q", "ids", "v", "group").mapInArrow(_best_of_blocks(k), f"query long, key long, group {kind}, similarity double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    rows = found.withColumn("rank", best).where(F.col("rank") <= k)
    return rows.select("query", F.col("key").alias(key), *([F.col("group").alias(group)] if group else []), "similarity")


def tf_idf(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, word, weight): L2-normalised smoothed TF-IDF weights of each document's words."""
    tokens = docs.select(F.col(key), F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())
    tf = durable(tokens.groupBy(key, "word").agg(F.count("*").alias("tf")))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n_docs"))
    raw = tf.join(df, "word").join(F.broadcast(n)).select(key, "word", (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    size = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, key).select(key, "word", (F.col("w") / F.col("size")).alias("weight"))


def _rare_words(weights: DataFrame, key: str, frequency: DataFrame, least: float) -> DataFrame:
    """(key, word): each text's rarest words; its other words alone can't reach a cosine of ``least``.

    Words are summed from the commonest on, and go while the squares of the weights stay below least².
    """
    common = Window.partitionBy(key).orderBy(F.desc("frequency"), "word").rowsBetween(Window.unboundedPreceding, 0)
    ranked = weights.join(frequency, "word").withColumn("square", F.sum(F.col("weight") * F.col("weight")).over(common))
    return ranked.where(F.col("square") >= (least - 1e-9) ** 2).select(key, "word")


def text_similarity(left: DataFrame, right: DataFrame, a: str, b: str, least: float, keep: Column | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs with a cosine of at least ``least``, from two TF-IDF tables (a, word, weight) and (b, word, weight).

    Two texts meet only where they share one of their rare words (a prefix filter with
    one order of words for both sides, which loses no pair); ``keep`` may narrow the
    pairs by their keys. Weights are normalised, as ``tf_idf`` gives them.
    """
    if least <= 0:
        raise ValueError("least has to be above 0")
    frequency = left.select("word").unionAll(right.select("word")).groupBy("word").agg(F.count("*").alias("frequency"))
    met = _rare_words(left, a, frequency, least).join(_rare_words(right, b, frequency, least), "word")
    met = (met if keep is None else met.where(keep)).select(a, b).distinct()
    pairs = met.join(left.select(a, "word", F.col("weight").alias("x")), a).join(right.select(b, "word", F.col("weight").alias("y")), [b, "word"])
    return pairs.groupBy(a, b).agg(F.sum(F.col("x") * F.col("y")).alias("similarity")).where(F.col("similarity") >= least)
