"""Missing values, column kinds and hashes that are stable under repartitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATING = (T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns. Booleans are categorical, timestamps neither."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of that exact name, also when it holds dots or blanks."""
    return F.col(quoted(name))


def is_missing(df: DataFrame, name: str) -> Column:
    col = column(name)
    if isinstance(df.schema[name].dataType, _FLOATING):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN read as missing."""
    col = column(name)
    if isinstance(df.schema[name].dataType, _FLOATING):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double"))
    return col.cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL, not an error, for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def row_digest(keys: Sequence[str], purpose: str | Column, seed: int | Column) -> Column:
    """md5 of `key:key:purpose:seed`, the source of every random choice."""
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    seed = F.lit(seed) if isinstance(seed, int) else seed
    parts = [column(k).cast("string") for k in keys] + [purpose.cast("string"), seed.cast("string")]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def digest_int(digest: Column, start: int = 1) -> Column:
    """Eight hex digits of a digest as an integer below 2**32."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def hash_int(keys: Sequence[str], purpose: str | Column, seed: int | Column) -> Column:
    return digest_int(row_digest(keys, purpose, seed))


def hash_unit(keys: Sequence[str], purpose: str | Column, seed: int | Column) -> Column:
    """A number in [0, 1) fixed by the row key."""
    return hash_int(keys, purpose, seed) / F.lit(4294967296.0)
