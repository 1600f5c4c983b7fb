"""Order-dependent operators that no hot group can push into one task.

A group up to `hot_rows` rows is handled by an ordinary window. With a larger group
the whole frame is range-sorted once, written to shared storage so that the partition
boundaries cannot move, and each partition works on its own part; what a group
carries over from earlier partitions is at most one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulark.config import HOT_GROUP_ROWS
from tabulark.functions.columns import column, hash_int
from tabulark.operators.lookup import join_lookup, settle
from tabulark.session import materialize


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    if not by:
        return df.count()
    row = df.groupBy(*[column(c) for c in by]).count().agg(F.max("count")).first()
    return row[0] or 0


def _partition_by(by: Sequence[str]):
    return Window.partitionBy(*([column(c) for c in by] or [F.lit(0)]))


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Inclusive running sums inside each group; `order` must be a total order."""
    if largest_group(df, by) <= hot_rows:
        window = _partition_by(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(e).over(window).alias(n) for n, e in sums.items()])

    part, at = "_part", "_at"
    laid_out = materialize(
        df.orderBy(*[column(c) for c in by], *order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id())
    )
    keys = [*by, part]
    totals = laid_out.groupBy(*[column(c) for c in keys]).agg(
        *[F.sum(e).alias(f"_carry_{n}") for n, e in sums.items()]
    )
    earlier = _partition_by(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[column(c) for c in keys],
        F.count(F.lit(1)).over(earlier).alias("_earlier"),
        *[F.sum(f"_carry_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
    ).filter("_earlier > 0")
    inside = _partition_by(keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = laid_out.select("*", *[F.sum(e).over(inside).alias(n) for n, e in sums.items()])
    joined = join_lookup(local, carried, keys)
    return joined.select(
        *[column(c) for c in df.columns],
        *[(F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """1, 2, 3, … inside each group in a total order."""
    if largest_group(df, by) <= hot_rows:
        return df.withColumn(name, F.row_number().over(_partition_by(by).orderBy(*order)).cast("bigint"))
    return running_sums(df, by, order, {name: F.lit(1).cast("bigint")}, hot_rows)


def with_next(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    following: dict[str, Column],
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Values of the next row of the same group, NULL on the last one."""
    if largest_group(df, by) <= hot_rows:
        window = _partition_by(by).orderBy(*order)
        return df.select("*", *[F.lead(e).over(window).alias(n) for n, e in following.items()])
    placed = materialize(numbered(df, by, order, "_no", hot_rows))
    after = placed.select(
        *[column(c).alias(f"_by_{i}") for i, c in enumerate(by)],
        (F.col("_no") - 1).alias("_no_before"),
        *[e.alias(n) for n, e in following.items()],
    )
    condition = F.col("_no") == F.col("_no_before")
    for i, c in enumerate(by):
        condition = condition & column(c).eqNullSafe(F.col(f"_by_{i}"))
    return placed.join(after, condition, "left").select(
        *[column(c) for c in df.columns], *[F.col(n) for n in following]
    )


def mark_first(
    df: DataFrame,
    by: Sequence[str],
    keys: Sequence[str],
    quota: DataFrame | Column,
    purpose: str,
    seed: int,
    name: str,
) -> DataFrame:
    """Mark the first `quota` rows of each group in hash order, exactly.

    `quota` is an expression of the group size `n`, or a frame of `by` and `quota`; groups without
    an entry get none. The row that ends a quota is found by counting hash prefixes (65,536 per
    group), then the rows below that one prefix. Only counts and those few rows move; the
    table is read three times and never shuffled.
    """
    groups = [column(c) for c in by]
    hashed = df.withColumn("_hash", hash_int(keys, purpose, seed))
    prefix = F.shiftright(F.col("_hash"), 16)
    by_prefix = materialize(hashed.groupBy(*groups, prefix.alias("_at")).agg(F.count(F.lit(1)).alias("_rows")))
    sizes = by_prefix.groupBy(*groups).agg(F.sum("_rows").alias("n"))
    if isinstance(quota, Column):
        wanted = sizes.withColumn("quota", quota.cast("bigint"))
    else:
        wanted = join_lookup(sizes, quota.select(*groups, F.col("quota").cast("bigint").alias("quota")), by)
    wanted, _ = settle(wanted.withColumn("quota", F.coalesce("quota", F.lit(0))))

    def end(counts: DataFrame, asked: DataFrame) -> DataFrame:
        """Where in hash order each group's quota ends, and how much of it falls there."""
        window = _partition_by(by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        running = join_lookup(counts.withColumn("_upto", F.sum("_rows").over(window)), asked, by, "inner")
        ends = (F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_rows") < F.col("quota"))
        left = F.col("quota") - F.col("_upto") + F.col("_rows")
        return running.filter(ends).select(*groups, F.col("_at").alias("_end"), left.alias("quota"))

    ends = end(by_prefix, wanted.filter("quota > 0").select(*groups, "quota"))
    own = [column(k) for k in keys if k not in by]
    near = join_lookup(hashed.select(*groups, *own, "_hash"), ends, by, "inner").filter(prefix == F.col("_end"))
    near = materialize(near.drop("_end", "quota"))
    by_hash = near.groupBy(*groups, F.col("_hash").alias("_at")).agg(F.count(F.lit(1)).alias("_rows"))
    # Rows of one 32-bit hash are few, so a window numbers them.
    tied = join_lookup(near, end(by_hash, ends.drop("_end")), by, "inner").filter("_hash = _end")
    place = F.row_number().over(_partition_by(by).orderBy(*[column(k) for k in keys]))
    last = F.struct(F.col("_hash"), *[column(k) for k in keys])
    lasts = tied.withColumn("_place", place).filter("_place = quota").select(*groups, last.alias("_last"))
    plan = join_lookup(wanted, lasts, by).select(*groups, (F.col("quota") >= F.col("n")).alias("_all"), "_last")
    taken = F.col("_all") | F.coalesce(last <= F.col("_last"), F.lit(False))
    marked = join_lookup(hashed, plan, by)
    return marked.select(*[column(c) for c in df.columns], F.coalesce(taken, F.lit(False)).alias(name))
