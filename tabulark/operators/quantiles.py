"""Exact quantiles with linear interpolation, without one buffer for a column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.config import EXACT_PERCENTILE_CELLS, HOT_GROUP_ROWS
from tabulark.functions.columns import number
from tabulark.operators.ordered import running_sums

_SKETCH = 2000  # sketch accuracy: rank error at most rows / _SKETCH
_MARGIN = 2.0 / _SKETCH
_COLUMNS_PER_SCAN = 40


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    max_buffer_cells: int = EXACT_PERCENTILE_CELLS,
    hot_rows: int = HOT_GROUP_ROWS,
    rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles per column, as fitted parameters on the driver.

    Up to `max_buffer_cells` cells (rows times columns of a scan) one buffer counts them all; `rows` saves counting where
    the caller knows the number. Larger tables are read twice: a sketch brackets each
    quantile, then only the rows inside the brackets (about 1 in 500) are counted by
    value, which gives the exact order statistics. A bracket that turns out not to hold
    its quantile is widened to the whole column.
    """
    if not columns:
        return {}
    if len(columns) > _COLUMNS_PER_SCAN:
        rows, found = df.count() if rows is None else rows, {}
        for start in range(0, len(columns), _COLUMNS_PER_SCAN):
            part = columns[start : start + _COLUMNS_PER_SCAN]
            found.update(exact_quantiles(df, part, probabilities, max_buffer_cells, hot_rows, rows))
        return found
    data = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = data.columns
    probabilities = [float(p) for p in probabilities]
    if (data.count() if rows is None else rows) * len(columns) <= max_buffer_cells:
        row = data.agg(*[F.percentile(c, F.array(*map(F.lit, probabilities))).alias(c) for c in names]).first()
        return {c: list(row[n]) if row[n] is not None else [None] * len(probabilities) for c, n in zip(columns, names)}

    edges = [min(max(p + side, 0.0), 1.0) for p in probabilities for side in (-_MARGIN, _MARGIN)]
    sketch = data.agg(
        *[F.count(n).alias(f"n_{n}") for n in names],
        *[F.percentile_approx(n, edges, _SKETCH).alias(f"q_{n}") for n in names],
    ).first()
    brackets = {}
    for n in names:
        for j, p in enumerate(probabilities):
            if sketch[f"n_{n}"]:
                low, high = sketch[f"q_{n}"][2 * j : 2 * j + 2]
                brackets[n, j] = (-math.inf if p <= _MARGIN else low, math.inf if p >= 1 - _MARGIN else high)
    counts = {n: sketch[f"n_{n}"] for n in names}
    if not brackets:
        return {c: [None] * len(probabilities) for c in columns}
    found = _select(data, brackets, counts, probabilities, hot_rows)
    missed = {k: (-math.inf, math.inf) for k in brackets if found.get(k) is None}
    if missed:
        found.update(_select(data, missed, counts, probabilities, hot_rows))
    return {
        c: [found.get((n, j)) for j in range(len(probabilities))] for c, n in zip(columns, names)
    }


def _select(data, brackets, counts, probabilities, hot_rows):
    keys = list(brackets)

    def inside(k):
        low, high = brackets[k]
        return (F.col(k[0]) >= F.lit(low)) & (F.col(k[0]) <= F.lit(high))

    below = data.agg(
        *[F.count_if(F.col(n) < F.lit(brackets[n, j][0])).alias(f"b{i}") for i, (n, j) in enumerate(keys)]
    ).first()
    hits = F.array(*[F.when(inside(k), F.struct(F.lit(i).alias("k"), F.col(k[0]).alias("v"))) for i, k in enumerate(keys)])
    by_value = (
        data.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
        .groupBy(F.col("h.k").alias("k"), F.col("h.v").alias("v"))
        .count()
    )
    ranked = running_sums(by_value, ["k"], [F.col("v")], {"upto": F.col("count")}, hot_rows)
    spots = {i: probabilities[j] * (counts[n] - 1) for i, (n, j) in enumerate(keys)}

    def at(rank):
        # Order statistics count from 0 over the whole column; `upto` counts inside the bracket.
        wanted = F.create_map(*[x for i in spots for x in (F.lit(i), F.lit(rank(spots[i]) - below[f"b{i}"]))])
        return F.min(F.when(F.col("upto") > wanted[F.col("k")], F.col("v")))

    rows = (
        ranked.groupBy("k")
        .agg(at(math.floor).alias("low"), at(math.ceil).alias("high"))
        .collect()
    )
    found = {}
    for row in rows:
        spot = spots[row["k"]]
        if math.floor(spot) >= below[f"b{row['k']}"] and row["low"] is not None and row["high"] is not None:
            share = spot - math.floor(spot)
            found[keys[row["k"]]] = row["low"] if share == 0 else (1 - share) * row["low"] + share * row["high"]
    return found
