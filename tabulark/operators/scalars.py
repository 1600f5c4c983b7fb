"""Many scalar aggregates of one table, fetched as a dictionary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame

_PER_SCAN = 400


def collect_scalars(df: DataFrame, aggregates: Mapping[str, Column], per_scan: int = _PER_SCAN) -> dict:
    """Values of the aggregates by name.

    Very wide tables take several scans. Each reads only its own columns, so together they
    read no more than one scan would, and generated code stays small.
    """
    names, values = list(aggregates), {}
    for start in range(0, len(names), per_scan):
        batch = names[start : start + per_scan]
        row = df.agg(*[aggregates[n].alias(f"a{i}") for i, n in enumerate(batch)]).first()
        values.update({n: row[f"a{i}"] for i, n in enumerate(batch)})
    return values
