"""Queries of this subpackage: each applies one operator to a whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import chat_formatting, decontamination, filter_audit, importance_resampling, license_scans, line_dedup, near_dedup, packing, quality_rules, secret_scans, token_counts, toxicity, url_filters
from loomery.llm.oracles import ORACLES
from loomery.session import table

#: Parameter: where the vocabulary files lie; executors read the same path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind_no"] < 3)
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = {f"n_{kind}": (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long") for kind in secret_scans.KINDS[:3]}
    return found.select("doc_id", *[c.alias(name) for name, c in counts.items()], F.sha2(secret_scans.span_digest(base), 256).alias("base_sha256"), secret_scans.span_digest(F.col("spans")).alias("spans"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    formatted = chat_formatting.format_chats(turns.unionByName(extra), BYTE_BPE)
    digests = chat_formatting.digest_chats(formatted, BYTE_BPE)
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaks = decontamination.leaks_by_document(docs, table(spark, sf_dir, "benchmark"))
    joined = docs.select("doc_id").alias("d").join(leaks.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), "left")
    return joined.select("d.doc_id", F.col("l.items").isNotNull().alias("contaminated"), F.coalesce(F.array_join(F.transform("l.items", lambda i: i.cast("string")), ","), F.lit("")).alias("items"), F.round("l.similarity", 6).alias("similarity"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.judge_quality(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resampling.resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_secret_scans, op4_chat_formatting, op5_decontamination, op6_line_dedup, op7_quality_rules, op8_near_dedup, op9_url_filters, op10_token_counts, op11_license_scans, op12_importance_resampling, op13_filter_audit)}

__all__ = ["ORACLES", "QUERIES"]
