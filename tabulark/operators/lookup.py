"""Joins with per-class lookups, broadcast only after their size is checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tabulark.config import LOOKUP_BYTES, LOOKUP_ROWS
from tabulark.functions.columns import column
from tabulark.session import materialize


def settle(frame: DataFrame, max_rows: int = LOOKUP_ROWS, max_bytes: int = LOOKUP_BYTES) -> tuple[DataFrame, bool]:
    """The frame computed once, and whether it is small enough to broadcast.

    It is held by the driver up to `max_rows` rows of `max_bytes` bytes (as text) together, and written to
    shared storage beyond that.
    """
    kept = frame.persist()
    try:
        width = F.octet_length(F.to_json(F.struct(*[column(c) for c in frame.columns])))
        size = kept.agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).first()
        if size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes:
            return frame.sparkSession.createDataFrame(kept.collect(), frame.schema), True
        return materialize(kept), False
    finally:
        kept.unpersist()


def join_lookup(
    df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Join `lookup` (unique in `on`, NULL matches NULL) to `df`.

    The lookup is computed once. With at most `max_rows` rows it is broadcast, so `df` is
    not shuffled. A larger one is joined by shuffle, where adaptive execution splits hot keys.
    """
    if not on:
        return _with_constants(df, lookup, how)
    renamed = lookup.select(
        *[column(c).alias(f"_on_{i}") for i, c in enumerate(on)],
        *[column(c) for c in lookup.columns if c not in on],
    )
    side, small = settle(renamed, max_rows)
    if small:
        side = F.broadcast(side)
    condition = F.lit(True)
    for i, c in enumerate(on):
        condition = condition & column(c).eqNullSafe(F.col(f"_on_{i}"))
    return df.join(side, condition, how).drop(*[f"_on_{i}" for i in range(len(on))])


def _with_constants(df: DataFrame, lookup: DataFrame, how: str) -> DataFrame:
    """A lookup without keys has at most one row: its values become constants of `df`."""
    rows = lookup.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("a lookup without keys must have one row")
    if not rows and how == "inner":
        return df.withColumns({c: F.lit(None).cast(lookup.schema[c].dataType) for c in lookup.columns}).limit(0)

    def constant(value, kind):
        if isinstance(value, Row):
            return F.struct(*[constant(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
        return F.lit(value).cast(kind)

    values = rows[0] if rows else [None] * len(lookup.columns)
    return df.withColumns({f.name: constant(v, f.dataType) for f, v in zip(lookup.schema, values)})
