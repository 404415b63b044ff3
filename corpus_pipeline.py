"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet below the cluster's shared checkpoint folder and rereads it as the
next stage's documents; a result goes once its successor is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from loomery.llm.columns import fresh
from loomery.llm.queries import WORD_BPE
from loomery.session import delete_folder, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score, predicted = fresh(docs.columns, "score", "predicted")
    scored = toxicity.score_toxicity(docs, model, keep_text=True, names=(score, predicted))
    return scored.where(F.col(predicted) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; a document of which nothing is left goes."""
    lines, removed = fresh(docs.columns, "n_lines", "n_removed")
    stripped = line_dedup.dedup_lines(docs, names=(lines, removed))
    kept = stripped.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.drop_near_duplicates(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", keep_one_near_duplicate),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
