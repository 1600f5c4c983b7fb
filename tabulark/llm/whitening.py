"""Whitening of embeddings: principal directions of their distinct, quantised rows, each scaled to unit variance.

Tasks reduce their centred rows to a triangular factor by blockwise QR; factors are combined, eight at a time,
until one is left, a square as wide as an embedding. Its squared singular values are the eigenvalues of the
covariance, found without ever forming the covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.bidiagonal import principal
from tabulark.llm.tables import written

SCALE = 256.0
#: Quantised entries of this size or more have no exact arithmetic in 64 bits.
_LIMIT = 2.0**61
_BLOCK, _FAN = 2048, 8


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct rows with ``sums``; ``directions`` (unit columns) and their ``values`` (variances); ``total`` variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    total: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean, rounded once."""
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.directions) / np.sqrt(self.values)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, each in the narrowest integers that hold it, so that equal rows have equal bytes."""
    size = np.abs(x).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    for kind, low, high in (("<i2", -1, 2**15), ("<i4", 2**15, 2**31), ("<i8", 2**31, 2**63 - 1)):
        rows = np.flatnonzero((size >= max(low, 0)) & (size < high))
        mark, part = kind[-1].encode(), x[rows].astype(kind)
        for i, row in zip(rows.tolist(), part):
            out[i] = mark + row.tobytes()
    return out


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    out = np.empty((len(column), dims), np.int64)
    values = column.to_pylist()
    kinds = np.array([x[:1] for x in values], "S1")
    for mark in (b"2", b"4", b"8"):
        rows = np.flatnonzero(kinds == mark)
        if len(rows):
            out[rows] = np.frombuffer(b"".join([values[i][1:] for i in rows]), f"<i{mark.decode()}").reshape(-1, dims)
    return out


def quantised(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id``, ``dims`` and ``x``, the packed floors of ``SCALE`` times each entry, of the rows whose entries are all finite."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("vector is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            entries = np.floor(SCALE * pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)) + 0.0
            sound = np.abs(entries) < _LIMIT
            starts = np.concatenate(([0], np.cumsum(lengths)))
            bad = np.concatenate(([0], np.cumsum(~sound)))
            good = (bad[starts[1:]] == bad[starts[:-1]]) & (lengths > 0)
            for dims in np.unique(lengths[good]).tolist():
                chosen = np.flatnonzero(good & (lengths == dims))
                x = entries[starts[chosen][:, None] + np.arange(dims)].astype(np.int64)
                columns = [batch.column(0).take(pa.array(chosen)), pa.array(np.full(len(chosen), dims, np.int32)), pa.array(_packed(x), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "dims", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"id {kind}, dims int, x binary")


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each entry, from sums of the high and low halves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(2 * dims, np.int64)
        for batch in batches:
            n += batch.num_rows
            x = _unpacked(batch.column(0), dims)
            sums += np.concatenate(((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64()))], ["n", "sums"])

    parts = fit.mapInArrow(add, "n long, sums array<long>")
    by_place = parts.select("n", F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(28,0)")).alias("value"))
    rows = sorted(by_place.collect())
    halves = [int(r.value) for r in rows]
    return rows[0].n, [(high << 32) + low for high, low in zip(halves[:dims], halves[dims:])]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _factor(fit: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows: blockwise in each task, then eight factors into one until one is left."""
    one = pa.schema([("part", pa.int64()), ("r", pa.binary())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                x = _unpacked(batch.column(0).slice(at, _BLOCK), dims)
                r = _triangle(np.concatenate((r, _centred(x, n, sums))))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], schema=one)

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        r = np.zeros((0, dims))
        for raw in table.column("r"):
            r = _triangle(np.concatenate((r, np.frombuffer(raw.as_py()).reshape(-1, dims))))
        return pa.table([[table.column("part")[0].as_py() // _FAN], [r.tobytes()]], schema=one)

    factors = written(fit.mapInArrow(reduce, "part long, r binary"), "factors")
    last = factors.agg(F.max("part")).first()[0]
    while last:
        factors = factors.groupBy(F.floor(F.col("part") / _FAN).alias("group")).applyInArrow(combine, "part long, r binary")
        last //= _FAN
    r = np.frombuffer(factors.first().r).reshape(-1, dims)
    return np.concatenate((r, np.zeros((dims - len(r), dims))))


def _spread(fit: DataFrame, dims: int, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list less the identity."""
    k = len(model.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = model.whitened(_unpacked(batch.column(0), dims))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["total"])

    cells = fit.mapInArrow(products, "total array<double>").select(F.posexplode("total").alias("at", "value"))
    rows = sorted(cells.groupBy("at").agg(F.sum("value").alias("value")).collect())
    return float(np.abs(np.array([r.value for r in rows]).reshape(k, k) / model.n - np.eye(k)).max(initial=0.0))


def fit(rows: DataFrame, dims: int, components: int) -> Whitening:
    """A whitening learnt from each distinct ``x`` of ``quantised`` rows of ``dims`` entries once."""
    distinct = written(rows.filter(F.col("dims") == dims).select("x").distinct(), "distinct")
    n, sums = _sums(distinct, dims)
    squares, directions = principal(_factor(distinct, dims, n, sums) / np.sqrt(n), components)
    model = Whitening(n, sums, directions, squares[: directions.shape[1]], float(squares.sum()), 0.0)
    return Whitening(n, sums, directions, model.values, model.total, _spread(distinct, dims, model))


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The exact sum of squares of n x - S for each row; None beyond 64 bits."""
    widest = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
    if widest**2 * x.shape[1] < 2**63:
        return ((model.n * x - np.array(model.sums)) ** 2).sum(axis=1).tolist()
    exact = [sum((model.n * a - s) ** 2 for a, s in zip(row, model.sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whitened(df: DataFrame, id_col: str, vector: str, components: int = 4) -> DataFrame:
    """For each row and component its id, ``component`` (from 1, by falling variance), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Entries are multiplied by 256 and rounded down. The model is learnt from each distinct row of such entries once, ``n`` in all.
    ``deviation`` is the squared distance to the mean, times n squared, exact, and null where it needs more than 64 bits.
    ``explained`` is the component's share of all variance; ``identity_error`` says how far the learnt rows are from being white.
    Rows whose vector is null, empty or holds a null, not a finite number or one of 2^53 or more give nothing, nor do
    rows whose length is not the commonest one (of several, the longest). Repeated rows and null ids are kept. Only directions with variance
    are components, so fewer than ``components`` may come, and none from an empty table or equal rows.
    """
    rows = written(quantised(df, id_col, vector), "quantised")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = common.dims
    model = fit(rows, dims, components)
    k = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                x, n = _unpacked(part.column(1), dims), part.num_rows
                each = np.repeat(np.arange(n), k)
                columns = [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n, np.int64)),
                    pa.array(_deviations(x, model), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.values / model.total, n)),
                    pa.array(np.full(n * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    chosen = rows.filter(F.col("dims") == dims).select("id", "x")
    return chosen.mapInArrow(project, schema).withColumnRenamed("id", id_col)
