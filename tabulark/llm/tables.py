"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.session import scratch_path

#: Largest table, in rows, that is sent whole to every executor; above it the join shuffles.
BROADCAST_ROWS = 100_000


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet to the shared folder and read again, so that lost executors cost no new result."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast only if it has at most ``rows`` rows (of a few numbers each)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def doc_crc(column: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def held_out(column: str = "doc_id"):
    """Whether a document belongs to the fold that no classifier learns from."""
    return doc_crc(column) % 3 == 1
