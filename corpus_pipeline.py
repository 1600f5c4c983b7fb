"""A corpus pipeline: each stage works on what its predecessor kept."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.llm import decontaminate, langid, neardup, packing, secret_scan, workload
from tabulark.llm.tables import written

#: SQL cannot express language identification, tokenizing and packing; tests hold the stages against plain versions.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: texts without letters, and those that no language has half of the probability of, go."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, "text", "lang")
    known = langid.predict(docs, "text", model)
    return known.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more: the one with the smallest id."""
    found = neardup.near_duplicates(docs, "doc_id", "text")
    return docs.select(*COLUMNS).join(found.filter("not kept").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark question."""
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    found = decontaminate.contaminated(docs, "doc_id", "text", benchmark, "item_id", "text")
    return docs.select(*COLUMNS).join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    findings, _ = secret_scan.scan(docs, "doc_id", "text")
    hits = findings.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    marked = docs.select(*COLUMNS).withColumn("blob", F.sha2(F.col("text"), 256)).join(hits, "blob", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secret_scan.redacted(F.col("text"), F.col("spans")))
    marked = marked.withColumn("text", text)
    count = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return marked.withColumn("n_chars", count).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, each with its sequence and its place there."""
    pieces = packing.tokenized(docs.select("doc_id", "text"), public_tokenizers.path(workload.TOKENIZER))
    return packing.pack(pieces).drop("piece_key")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_removal", secret_removal),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
