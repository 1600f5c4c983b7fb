"""Reproducible splits and folds from hashes of the row key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulark.config import CV_FOLDS, HOT_GROUP_ROWS, SEED, TEST_FRACTION
from tabulark.functions.columns import column, hash_int, hash_unit
from tabulark.operators.lookup import join_lookup
from tabulark.operators.ordered import largest_group, mark_first


def train_test_split(
    df: DataFrame,
    keys: Sequence[str],
    test_fraction: float = TEST_FRACTION,
    seed: int = SEED,
    stratify: str | None = None,
    exact: bool = False,
    name: str = "split",
) -> DataFrame:
    """A `split` column, `train` or `test`.

    By default each row decides for itself by its hash: no shuffle, and every class is
    split in the same proportion up to chance. With `exact`, every class has exactly
    round(fraction · rows) test rows, found by counting hashes.
    """
    if not exact:
        test = hash_unit(keys, "split", seed) < test_fraction
    else:
        by = [stratify] if stratify else []
        quota = F.round(F.col("n") * test_fraction)
        df = mark_first(df, by, keys, quota, "split", seed, "_test")
        test = F.col("_test")
    return df.withColumn(name, F.when(test, "test").otherwise("train")).drop("_test")


def kfold(
    df: DataFrame,
    keys: Sequence[str],
    k: int = CV_FOLDS,
    seed: int = SEED,
    stratify: str | None = None,
    name: str = "fold",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """A `fold` column 0..k-1: the row's place in hash order within its class, modulo k.

    Hashes are uniform, so a class too large for one task is cut into equal hash ranges; a
    row's place is its place in the range plus the sizes of the ranges before it.
    """
    by = [stratify] if stratify else []
    bits = max(0, math.ceil(math.log2(max(largest_group(df, by), 1) / hot_rows)) + 1) if hot_rows else 0
    ranges = df.withColumn("_hash", hash_int(keys, "fold", seed)).withColumn(
        "_range", F.shiftright(F.col("_hash"), 32 - min(bits, 32))
    )
    cut = [*by, "_range"]
    order = [F.col("_hash"), *[column(c) for c in keys]]
    placed = ranges.withColumn(
        "_place", F.row_number().over(Window.partitionBy(*[column(c) for c in cut]).orderBy(*order))
    )
    if bits:
        before = Window.partitionBy(*([column(c) for c in by] or [F.lit(0)])).orderBy("_range")
        sizes = ranges.groupBy(*[column(c) for c in cut]).count()
        offsets = sizes.select(
            *[column(c) for c in cut],
            F.sum("count").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        )
        placed = join_lookup(placed, offsets, cut)
    else:
        placed = placed.withColumn("_before", F.lit(0))
    place = F.col("_place") + F.coalesce(F.col("_before"), F.lit(0)) - 1
    return placed.withColumn(name, F.pmod(place, F.lit(k)).cast("int")).drop(
        "_hash", "_range", "_place", "_before"
    )
