"""Datasets by registered name or by path."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.functions.columns import column
from tabulark.operators.scalars import collect_scalars
from tabulark.session import materialize
from tabulark.sources.csv_records import parsed

Catalog = Mapping[str, Callable[[SparkSession], DataFrame]]

TARGET = "target"
ROW_KEY = "row_key"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on the file system the path belongs to, object stores included."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matches = files.globStatus(where)
    return matches is not None and len(matches) > 0


#: What counts as missing, quoted or not, unless the caller says otherwise.
NA_MARKS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)
_TRUE, _FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", na_marks: Sequence[str] = NA_MARKS
) -> DataFrame:
    """A CSV file or folder with a header in each file, read in parallel whatever is quoted.

    Quoted fields may hold separators, line feeds and doubled quotes. Fields in `na_marks` are missing. Columns are
    integers (64 bits where 32 are too few), else numbers, else booleans, else texts; one without any value is of numbers. With a schema its names and types are taken
    and what does not fit is missing. Short records end in missing fields; a longer one than the header is an error. The
    parsed records are written once to shared storage, so later passes read columns and no text.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Dataset not found: {path}")
    records = parsed(spark, path, sep)
    headers = [r["fields"] for r in records.filter("header").select("fields").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"files with different headers: {headers[0]} and {headers[1]}")
    names = _column_names(headers[0]) if headers else []
    rows = records.filter("not header")
    wide = rows.filter(F.size("fields") > len(names)).limit(1).collect()
    if wide:
        raise ValueError(f"a record has {len(wide[0]['fields'])} fields, the header {len(names)}: {wide[0]['fields']}")
    if schema is not None:
        given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        names, kinds = given.names, {f.name: f.dataType.simpleString() for f in given}
    else:
        kinds = {}
    fields = [F.get(F.col("fields"), F.lit(i)) for i in range(len(names))]
    texts = rows.select(*[F.when(~f.isin(*na_marks), f).alias(n) for f, n in zip(fields, names)])
    if schema is None:
        kinds = _inferred(texts)
    return texts.select(*[_typed(column(n), kinds[n]).alias(n) for n in names])


def _column_names(header: Sequence[str]) -> list[str]:
    """Names of columns: empty ones by their place, repeated ones numbered."""
    names: list[str] = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        plain, n = name, 0
        while name.lower() in (x.lower() for x in names):
            n += 1
            name = f"{plain}.{n}"
        names.append(name)
    return names


def _inferred(texts: DataFrame) -> dict[str, str]:
    """The narrowest type of each column, from one pass over the texts."""

    def holds(name: str, fits: Column) -> Column:
        return F.bool_and(F.when(column(name).isNotNull(), F.coalesce(fits, F.lit(False))))

    tests = {}
    for name in texts.columns:
        c = column(name)
        integer = c.rlike(_INTEGER)
        tests[name, "int"] = holds(name, F.when(integer, F.trim(c).try_cast("int").isNotNull()))
        tests[name, "bigint"] = holds(name, F.when(integer, F.trim(c).try_cast("bigint").isNotNull()))
        tests[name, "double"] = holds(name, c.rlike(_NUMBER) & (~integer | F.trim(c).try_cast("bigint").isNotNull()))
        tests[name, "boolean"] = holds(name, c.isin(*_TRUE, *_FALSE))
    found = collect_scalars(texts, tests)
    kinds = {}
    for name in texts.columns:
        fitting = [kind for kind in ("int", "bigint", "double", "boolean") if found[name, kind]]
        kinds[name] = "double" if found[name, "int"] is None else (fitting or ["string"])[0]
    return kinds


def _typed(text: Column, kind: str) -> Column:
    if kind == "string":
        return text
    return F.trim(text).try_cast(kind)


def load_named(spark: SparkSession, name: str, catalog: Catalog) -> DataFrame:
    if name not in catalog:
        raise ValueError(f"Unknown dataset '{name}'. Available: {sorted(catalog)}")
    return catalog[name](spark)


def named_table(path: str, target: str | None = None, fmt: str = "parquet") -> Callable[[SparkSession], DataFrame]:
    """A catalog entry: a stored table whose target column is called `target`."""

    def load(spark: SparkSession) -> DataFrame:
        df = spark.read.format(fmt).load(path)
        return df.withColumnRenamed(target, TARGET) if target else df

    return load


def load_dataset(spark: SparkSession, identifier: str, catalog: Catalog | None = None) -> DataFrame:
    """A registered name wins; anything else is a path, read by its suffix (CSV by default)."""
    if catalog and identifier in catalog:
        return load_named(spark, identifier, catalog)
    bare = identifier.rstrip("/").lower()
    for suffix in ("parquet", "orc", "json"):
        if bare.endswith("." + suffix):
            if not path_exists(spark, identifier):
                raise FileNotFoundError(f"Dataset not found: {identifier}")
            return spark.read.format(suffix).load(identifier)
    return load_csv(spark, identifier)


def with_row_key(df: DataFrame, name: str = ROW_KEY) -> DataFrame:
    """A unique key per row for tables that have none, fixed by writing the table once."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))
