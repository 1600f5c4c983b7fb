"""Oversampling: every class is brought to the size of the largest one."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.config import SEED
from tabulark.functions.columns import column, digest_int, row_digest
from tabulark.operators.knn import knn_join
from tabulark.operators.lookup import join_lookup, settle
from tabulark.operators.ordered import mark_first

logger = logging.getLogger(__name__)

SMOTE_NEIGHBOURS = 5
_COPIES_PER_ROW = 1000  # more copies of one row are spread over tasks


def class_needs(df: DataFrame, label: str) -> DataFrame:
    """(label, n, need): rows per class and how many it lacks. One row per class, counted once."""
    counts, _ = settle(df.groupBy(column(label).alias(label)).agg(F.count(F.lit(1)).alias("n")))
    largest = counts.agg(F.max("n")).first()[0] or 0
    return counts.withColumn("need", F.lit(largest) - F.col("n"))


def _with_draws(
    df: DataFrame, needs: DataFrame, label: str, keys: Sequence[str], seed: int, purpose: str
) -> DataFrame:
    """Each row with the number of extra rows it gives: need div n, and one more for the
    first need mod n rows of its class in hash order."""
    quota = needs.select(column(label), F.expr("need % n").alias("quota"))
    marked = mark_first(df, [label], keys, quota, purpose, seed, "_extra")
    whole = needs.select(column(label), F.expr("need div n").alias("_whole"))
    joined = join_lookup(marked, whole, [label])
    return joined.withColumn("_draws", F.col("_whole") + F.col("_extra").cast("int")).drop("_whole", "_extra")


def _numbered_draws(df: DataFrame, needs: DataFrame, keys: Sequence[str], first: int, name: str) -> DataFrame:
    """One row per number from `first` to `_draws`; long runs are cut and spread first."""
    most = needs.agg(F.max(F.expr("need div n"))).first()[0] or 0
    if most < _COPIES_PER_ROW:
        numbers = F.when(F.col("_draws") >= first, F.sequence(F.lit(first).cast("bigint"), F.col("_draws")))
        return df.withColumn(name, F.explode(numbers)).drop("_draws")
    size = F.lit(_COPIES_PER_ROW).cast("bigint")
    starts = F.when(
        F.col("_draws") >= first, F.sequence(F.lit(first).cast("bigint"), F.col("_draws"), size)
    )
    cut = df.withColumn("_start", F.explode(starts)).repartition(*[column(c) for c in keys], "_start")
    numbers = F.sequence(F.col("_start"), F.least(F.col("_start") + size - 1, F.col("_draws")))
    return cut.withColumn(name, F.explode(numbers)).drop("_draws", "_start")


def oversample_random(
    df: DataFrame, label: str, keys: Sequence[str], seed: int = SEED, copy: str = "copy"
) -> DataFrame:
    """All rows (copy 0) and repeats of the smaller classes' rows (copy 1, 2, …)."""
    needs = class_needs(df, label)
    return _numbered_draws(_with_draws(df, needs, label, keys, seed, "oversample"), needs, keys, 0, copy)


def oversample_smote(
    df: DataFrame,
    label: str,
    key: str,
    vector: str,
    k: int = SMOTE_NEIGHBOURS,
    seed: int = SEED,
    draw: str = "draw",
) -> DataFrame:
    """All rows (draw 0) and synthetic rows between a row and one of its k nearest of its class.

    Base row, neighbour and position on the segment come from hashes of the row key and the
    draw number. If a class that needs rows has no more than k, nothing is added.
    """
    needs = class_needs(df, label)
    too_small = needs.filter(F.col("need") > 0).filter(F.col("n") <= k).limit(1).count()
    originals = df.withColumn(vector, column(vector).cast("array<double>"))
    if too_small:
        logger.warning("oversampling left out: a class has no more than %d rows", k)
        return originals.withColumn(draw, F.lit(0).cast("bigint"))
    growing = join_lookup(originals, needs.filter(F.col("need") > 0).select(column(label), "need"), [label], "inner")
    growing = growing.drop("need")
    # Only rows that give a draw look for neighbours, and only the chosen neighbour's vector moves.
    base = _with_draws(originals, needs, label, [key], seed, "smote").filter("_draws > 0")
    neighbours = knn_join(base, growing, k, key, key, vector, vector, within=label, exclude_self=True)
    digest = smote_digest(key, draw, seed)
    drawn = _numbered_draws(base, needs, [key], 1, draw)
    drawn = drawn.withColumn("_rank", (F.pmod(digest_int(digest, 1), F.lit(k)) + 1).cast("int"))
    drawn = drawn.withColumn("_share", digest_int(digest, 9) / F.lit(4294967296.0))
    chosen = neighbours.select(column("query_key").alias(key), F.col("rank").cast("int").alias("_rank"), "neighbour_key")
    drawn = drawn.join(chosen, [key, "_rank"])
    drawn = drawn.join(growing.select(column(key).alias("neighbour_key"), column(vector).alias("_to")), "neighbour_key")
    between = F.zip_with(column(vector), F.col("_to"), lambda x, y: x + F.col("_share") * (y - x))
    synthetic = drawn.withColumn(vector, between).select(*[column(c) for c in originals.columns], draw)
    return originals.withColumn(draw, F.lit(0).cast("bigint")).unionByName(synthetic)


def smote_digest(key: str, draw: str, seed: int) -> Column:
    return row_digest([key, draw], "smote", seed)
