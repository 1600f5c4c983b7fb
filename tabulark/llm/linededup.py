"""Lines repeated across documents, dropped by bitmaps.

Hashes of lines are range-partitioned and sorted by document (largest first) and place. A task streams
its range: the first document of a hash keeps its lines, and from the third document on it is known that
the others drop theirs. What a range begins or ends with may go on next door; those rows wait for a
table of the edges, which has at most six rows for each range. The result is a compressed bitmap for each
document; texts move only when a bitmap is applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.llm.tables import small_side, written

#: White space that is no part of a line's key.
SPACE = " \t\n\x0b\f\r"
#: Fewest code points of a key, and fewest documents that have it, for lines to be dropped.
LEAST_CHARS, LEAST_DOCUMENTS = 20, 3

_DROP, _OPEN, _EDGE = 0, 1, 2
_COLUMNS = ["h1", "h2", "doc", "text_key", "pos"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc"), whole.alias("text"))
    return docs.withColumn("text_key", F.xxhash64("text", F.length("text")))


def _hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    lines = docs.filter("doc is not null").select("doc", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # The bare line is as long as its key, and most short lines are so without being bare.
    lines = lines.filter(F.length("line") >= least_chars).withColumn("line", line_key(F.col("line")))
    lines = lines.filter(F.length("line") >= least_chars)
    return lines.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "doc", "text_key", F.col("pos").cast("long").alias("pos")
    )


def _streamed(least_documents: int):
    """A task's rows of (h1, h2, doc, text_key, pos), sorted, to drops, rows that wait for the edges, and edges."""

    def batch_of(rows: np.ndarray, kind: int) -> pa.RecordBatch:
        columns = [pa.array(rows[:, i]) for i in range(5)] + [pa.array(np.full(len(rows), kind, np.int32))]
        return pa.RecordBatch.from_arrays(columns, [*_COLUMNS, "kind"])

    def edges(key: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        rows = np.zeros((len(docs), 5), np.int64)
        rows[:, :2], rows[:, 2] = key, docs
        return batch_of(rows, _EDGE)

    def largest(docs: np.ndarray) -> np.ndarray:
        return np.unique(docs)[::-1][:least_documents]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key = None
        first_docs = closed_docs = np.zeros(0, np.int64)
        carry, closed = np.zeros((0, 5), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(5)])
            first_key = rows[0, :2].copy() if first_key is None else first_key
            ahead = int(np.argmin(np.append((rows[:, :2] == first_key).all(axis=1), False))) if not len(carry) and closed is None else 0
            if ahead:
                first_docs = largest(np.concatenate((first_docs, rows[:ahead, 2])))
                yield batch_of(rows[:ahead], _OPEN)
                rows = rows[ahead:]
            if closed is not None:
                more = int(np.argmin(np.append((rows[:, :2] == closed).all(axis=1), False)))
                yield batch_of(rows[:more], _DROP)
                rows = rows[more:]
            if not len(rows):
                continue
            rows, closed = np.concatenate((carry, rows)), None
            new_group = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            new_doc = new_group | np.append(True, rows[1:, 2] != rows[:-1, 2])
            starts, group = np.flatnonzero(new_group), np.cumsum(new_group) - 1
            nth = np.cumsum(new_doc)
            rank = nth - nth[starts][group]
            documents = rank[np.append(starts[1:], len(rows)) - 1] + 1
            yield batch_of(rows[(documents[group] >= least_documents) & (rank > 0)], _DROP)
            carry = rows[starts[-1] :]
            if documents[-1] >= least_documents:
                closed, closed_docs, carry = carry[0, :2].copy(), largest(carry[:, 2]), carry[:0]
        if first_key is not None:
            yield edges(first_key, first_docs)
        if closed is not None:
            yield edges(closed, closed_docs)
        elif len(carry):
            yield batch_of(carry, _OPEN)
            yield edges(carry[0, :2], largest(carry[:, 2]))

    return stream


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``doc``, ``text_key`` and ``pos`` of every line that goes; ``docs`` has ``doc``, ``text_key`` and ``text``."""
    lines = written(_hashed_lines(docs, least_chars), "lines")
    order = ["h1", "h2", F.desc("doc"), "text_key", "pos"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(*_COLUMNS)
    kinds = "h1 long, h2 long, doc long, text_key long, pos long, kind int"
    found = written(ranged.mapInArrow(_streamed(least_documents), kinds), "streamed")
    edges = found.filter(f"kind = {_EDGE}").select("h1", "h2", "doc").distinct()
    shared = edges.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
    shared = shared.filter(F.col("n") >= least_documents).drop("n")
    waiting = found.filter(f"kind = {_OPEN}").join(small_side(shared), ["h1", "h2"]).filter("doc < keeper")
    return found.filter(f"kind = {_DROP}").select("doc", "text_key", "pos").unionByName(waiting.select("doc", "text_key", "pos"))


def line_bitmaps(
    df: DataFrame, id_col: str, text: str, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """For each id and text: ``text_key`` (a hash of the text), ``n_lines``, ``n_dropped`` and ``keep``; other columns are not read.

    A text is split at line feeds; null and empty texts are one empty line. Lines whose key has at least ``least_chars``
    code points and is in at least ``least_documents`` documents go from all documents but the one with the largest id.
    ``keep`` has a bit for each line, the lowest of a byte first, 1 for lines that stay, deflated; it is null where all
    stay. Rows with the same id are one document, and equal ones give one row. A row without an id keeps all its lines and counts
    for no document. An empty table gives an empty result.
    """
    docs = _keyed(df, id_col, text)
    word = F.floor(F.col("pos") / 64).cast("long").alias("word")
    bits = F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits")
    words = dropped_lines(docs, least_chars, least_documents).groupBy("doc", "text_key", word).agg(bits)
    words = words.groupBy("doc", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped")
    )
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    all_docs = docs.select("doc", "text_key", lines.cast("long").alias("n_lines")).distinct()
    joined = all_docs.join(words, ["doc", "text_key"], "left")
    joined = joined.select("doc", "text_key", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "words.word", "words.bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, word, bits in zip(batch.column(2).to_pylist(), batch.column(4), batch.column(5)):
                if not word.is_valid:
                    keep.append(None)
                    continue
                bitmap = np.full((n + 63) // 64, -1, "<i8")
                bitmap[word.values.to_numpy()] = ~bits.values.to_numpy()
                keep.append(zlib.compress(bitmap.tobytes()[: (n + 7) // 8], 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keep, pa.binary())], [*batch.schema.names[:4], "keep"])

    packed = joined.mapInArrow(pack, "doc long, text_key long, n_lines long, n_dropped long, keep binary")
    return packed.withColumnRenamed("doc", id_col)


def kept_text(df: DataFrame, id_col: str, text: str, bitmaps: DataFrame) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_lines``, ``n_dropped`` and ``kept``, the text of the lines that stay."""
    marks = bitmaps.select(F.col(id_col).alias("_doc"), F.col("text_key").alias("_key"), "n_lines", "n_dropped", "keep")
    docs = _keyed(df, id_col, text)
    joined = docs.join(marks, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for whole, keep in zip(batch.column(3), batch.column(4)):
                if keep.is_valid:
                    lines = whole.as_py().split("\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), bitorder="little")
                    kept.append("\n".join([lines[i] for i in np.flatnonzero(bits[: len(lines)]).tolist()]))
                else:
                    kept.append(whole.as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.large_string()).cast(pa.string())], ["doc", "n_lines", "n_dropped", "kept"])

    out = joined.select("doc", "n_lines", "n_dropped", "text", "keep").mapInArrow(apply, "doc long, n_lines long, n_dropped long, kept string")
    return out.withColumnRenamed("doc", id_col)
