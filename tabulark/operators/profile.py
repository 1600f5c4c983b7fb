"""Dataset profile: missing values, classes, statistics and correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.functions.columns import (
    categorical_columns,
    column,
    is_missing,
    number,
    numeric_columns,
    ratio,
)
from tabulark.operators.quantiles import exact_quantiles
from tabulark.operators.scalars import collect_scalars

#: Columns whose products with all others one pass adds up: a task holds 6 numbers for each pair.
_ROWS_PER_SCAN = 500
_QUARTILES = (0.25, 0.5, 0.75)

_STATISTICS = T.StructType(
    [T.StructField("column", T.StringType()), T.StructField("count", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")]
)
_CORRELATIONS = T.StructType(
    [
        T.StructField("col_a", T.StringType()),
        T.StructField("col_b", T.StringType()),
        T.StructField("correlation", T.DoubleType()),
    ]
)


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: the number of rows and of missing cells per column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing cells per column that has any, as count and percent of the rows."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"))
            for i, c in enumerate(df.columns)
        ]
    )
    return (
        missing_counts(df)
        .select("n_rows", F.inline(cells))
        .filter("missing > 0")
        .select("column", "missing", (ratio(F.col("missing"), F.col("n_rows")) * 100).alias("percent"))
    )


def total_missing_pct(df: DataFrame) -> DataFrame:
    """Missing cells as percent of all cells; NULL for an empty table."""
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0).cast("bigint"))
    cells = F.col("n_rows") * len(df.columns)
    return missing_counts(df).select((ratio(total, cells) * 100).alias("total_missing_pct"))


def class_distribution(df: DataFrame, target: str) -> DataFrame | None:
    """Rows per target value, missing left out; None if there is no such column."""
    if target not in df.columns:
        return None
    return (
        df.filter(~is_missing(df, target))
        .groupBy(column(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


class _Scan:
    """Scalars of all columns from one pass: rows, missing cells, moments and range."""

    def __init__(self, df: DataFrame, numeric: Sequence[str], missing: Sequence[str] = ()):
        moments = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        aggregates = {("rows",): F.count(F.lit(1))}
        aggregates |= {("missing", c): F.count_if(is_missing(df, c)) for c in missing}
        aggregates |= {(name, c): fn(number(df, c)) for c in numeric for name, fn in moments.items()}
        found = collect_scalars(df, aggregates)
        self.rows = found["rows",]
        self.missing = {c: found["missing", c] for c in missing}
        self.moments = {c: {name: found[name, c] for name in moments} for c in numeric}

    def constant(self, name: str) -> bool:
        return not self.moments[name]["std"]


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max per numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], _STATISTICS)
    return _describe(df, columns, _Scan(df, columns))


def _describe(df: DataFrame, columns: Sequence[str], scan: _Scan) -> DataFrame:
    quartiles = exact_quantiles(df, columns, _QUARTILES, rows=scan.rows)
    records = [
        (c, m["n"], m["mean"], m["std"], m["min"], *quartiles[c], m["max"])
        for c, m in ((c, scan.moments[c]) for c in columns)
    ]
    return df.sparkSession.createDataFrame(records, _STATISTICS)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Absolute Pearson correlation of every numeric pair over the rows that have both values.

    NULL where a column is constant on these rows. All pairs come from one pass, in which every task adds up
    products of the columns and of their marks of presence; above `_ROWS_PER_SCAN` columns there is a pass for
    each so many of them. The pairs stay rows of a table.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    return _correlate(df, columns, _Scan(df, columns))


def _correlate(df: DataFrame, columns: Sequence[str], scan: _Scan) -> DataFrame:
    columns = list(columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], _CORRELATIONS)
    # Values less their mean keep their digits in the sums of squares.
    centred = df.select(*[(number(df, c) - F.lit(scan.moments[c]["mean"])).alias(f"c{i}") for i, c in enumerate(columns)])
    blocks = [range(start, min(start + _ROWS_PER_SCAN, len(columns))) for start in range(0, len(columns), _ROWS_PER_SCAN)]
    pairs = reduce(DataFrame.unionByName, [_pair_sums(centred, block) for block in blocks])
    spread_x, spread_y = F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    # What rounding leaves of a constant is no spread.
    both = (spread_x > F.col("n") * F.col("xx") * 1e-12) & (spread_y > F.col("n") * F.col("yy") * 1e-12)
    r = ratio(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(spread_x) * F.sqrt(spread_y))
    varies = F.array(*[F.lit(not scan.constant(c)) for c in columns])
    both = both & F.element_at(varies, F.col("i") + 1) & F.element_at(varies, F.col("j") + 1)
    r = F.when(both, F.least(F.abs(r), F.lit(1.0)))
    names = F.array(*[F.lit(c) for c in columns])
    return pairs.select(
        F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"), r.alias("correlation")
    )


def _pair_sums(centred: DataFrame, block: range) -> DataFrame:
    """For i in `block` and j > i, over the rows that have both: n, and the sums x, xx, y, yy, xy."""
    width, first, last = len(centred.columns), block[0], block[-1] + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, last - first, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            own, mine = x[:, first:last], there[:, first:last]
            for k, (a, b) in enumerate(((mine, there), (own, there), (own**2, there), (mine, x), (mine, x**2), (own, x))):
                total[k] += a.T @ b
        rows = total.transpose(1, 0, 2).reshape(last - first, 6 * width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last, dtype=np.int32)), pa.array(list(rows), pa.list_(pa.float64()))], ["i", "sums"])

    parts = centred.mapInArrow(products, "i int, sums array<double>")
    sums = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("s"))
    cut = lambda k: F.slice("s", k * width + 1, width)
    zipped = F.arrays_zip(*[cut(k).alias(name) for k, name in enumerate(("n", "x", "xx", "y", "yy", "xy"))])
    return sums.select("i", F.posexplode(zipped).alias("j", "p")).filter("j > i").select("i", "j", "p.*")


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The n strongest pairs."""
    return _strongest(correlations(df, columns), n)


def _strongest(pairs: DataFrame, n: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc_nulls_last("correlation"), "col_a", "col_b").limit(n)


def dataset_profile(df: DataFrame, target: str) -> DataFrame:
    """One row: shape, columns by kind, types, missing share and target name."""
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0).cast("bigint"))

    def names(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return missing_counts(df).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        names(df.columns).alias("columns"),
        names(numeric_columns(df)).alias("numeric_columns"),
        names(categorical_columns(df)).alias("categorical_columns"),
        types.alias("feature_types"),
        (ratio(total, F.col("n_rows") * len(df.columns)) * 100).alias("total_missing_pct"),
        F.lit(target).alias("target_column"),
    )


def profile(df: DataFrame, target: str) -> DataFrame:
    """Everything about a dataset as rows of (section, name, item, value).

    One pass for all scalars, one for the quartiles, one for the correlations; classes are counted when
    the result is read, and stay rows however many there are.
    """
    spark, numeric = df.sparkSession, numeric_columns(df)
    scan = _Scan(df, numeric, df.columns)
    cells, gaps = scan.rows * len(df.columns), sum(scan.missing.values())
    header = [
        ("table", "rows", None, float(scan.rows)),
        ("table", "columns", None, float(len(df.columns))),
        ("table", "missing_pct", None, 100.0 * gaps / cells if cells else None),
        *[("missing", c, None, float(n)) for c, n in scan.missing.items() if n],
    ]
    result = spark.createDataFrame(header, "section string, name string, item string, value double")

    def add(frame, section, name, item, value):
        return result.unionByName(
            frame.select(
                F.lit(section).alias("section"),
                name.cast("string").alias("name"),
                item.cast("string").alias("item"),
                value.cast("double").alias("value"),
            )
        )

    classes = class_distribution(df, target)
    if classes is not None:
        result = add(classes, "class", F.lit(target), F.col("class"), F.col("count"))
    if numeric:
        items = [f.name for f in _STATISTICS if f.name != "column"]
        long = F.array(*[F.struct(F.lit(i).alias("i"), F.col(i).cast("double").alias("v")) for i in items])
        statistics = _describe(df, numeric, scan).select("column", F.inline(long))
        result = add(statistics, "statistics", F.col("column"), F.col("i"), F.col("v"))
    if len(numeric) > 1:
        strongest = _strongest(_correlate(df, numeric, scan))
        result = add(strongest, "correlation", F.col("col_a"), F.col("col_b"), F.col("correlation"))
    return result


def profile_text(sections: DataFrame, df: DataFrame, shown: dict[str, int] | None = None) -> str:
    """The rows of a profile as text, a paragraph per section, largest values first.

    `shown` bounds the rows that reach the driver per section (statistics are left to the table); a paragraph
    says how many are left out.
    """
    shown = {"table": 100, "missing": 50, "class": 50, "correlation": 10, **(shown or {})}
    sizes = {r["section"]: r["count"] for r in sections.groupBy("section").count().collect()}
    kinds = {"numeric": numeric_columns(df), "categorical": categorical_columns(df)}
    paragraphs = [f"{kind}: {len(names)} ({', '.join(names) or 'none'})" for kind, names in kinds.items()]
    for section, most in shown.items():
        if not sizes.get(section):
            continue
        ranked = sections.filter(F.col("section") == section).orderBy(F.desc_nulls_last("value"), "name", "item").limit(most)
        entries = []
        for r in ranked.collect():
            label = "/".join(x for x in (r["name"], r["item"]) if x is not None)
            entries.append(f"{label} {'undefined' if r['value'] is None else format(r['value'], '.6g')}")
        rest = sizes[section] - len(entries)
        paragraphs.append(f"{section}: {'; '.join(entries)}{f'; and {rest} more' if rest else ''}")
    return "\n".join(paragraphs)
