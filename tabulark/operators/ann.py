"""Approximate nearest neighbours by an inverted file of coded residuals.

Training rows belong to the cell of their nearest centre and are kept as one byte per number of what is left.
A query reads the cells nearest to it, as many as hold the wanted share of all rows, compares codes there, and
only the best candidates are measured exactly on the vectors. Cells are packed into blocks of bounded size and large cells cut
by a hash of the row key; the queries of a block are cut likewise, so a task compares a bounded number of pairs. A query moves
once for each block that it reads, and a block returns its best candidates only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulark.config import SEED
from tabulark.functions.columns import column, hash_unit
from tabulark.session import materialize

#: Most cells, most rows per cell that centres are fitted on, and bytes of the decoded rows of a block.
MAX_CELLS, FIT_ROWS, BLOCK_BYTES = 4096, 256, 16 << 20
#: Queries of a block, codes compared at once in a row, pairs at once, pairs of a task and most tasks.
_ASKED, _WIDE, _MATRIX_CELLS, _TASK_PAIRS, _MAX_TASKS = 8192, 4096, 1 << 20, 1 << 26, 20_000


def _centres(train: DataFrame, n: int, cells: int) -> np.ndarray:
    """Centres by k-means over all rows, or over about ``FIT_ROWS`` rows a cell chosen by hash where there are more."""
    if cells < 2:
        return np.array([train.select("_v").first()["_v"]], dtype=float)
    share = FIT_ROWS * cells / max(n, 1)
    rows = train if share >= 1 else train.filter(hash_unit(["_t"], "centres", SEED) < share)
    vectors = rows.select(array_to_vector("_v").alias("features"))
    found = np.array(KMeans(k=cells, maxIter=10, seed=SEED).fit(vectors).clusterCenters())
    return np.unique(found, axis=0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _coded(train: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with their cell and the code of their residual: a scale and a byte for each number."""

    @F.pandas_udf("cell int, code binary")
    def code(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy())
        step = max(1, _MATRIX_CELLS // len(centres))
        cell = np.concatenate([_squared(x[i : i + step], centres).argmin(axis=1) for i in range(0, len(x), step)])
        rest = x - centres[cell]
        scale = (np.abs(rest).max(axis=1) / 127.0).astype("<f4")
        steps = np.rint(rest / np.where(scale > 0, scale, 1.0)[:, None]).clip(-127, 127).astype(np.int8)
        return pd.DataFrame({"cell": cell.astype("int32"), "code": [s.tobytes() + r.tobytes() for s, r in zip(scale, steps)]})

    placed = train.withColumn("_c", code("_v"))
    return placed.select("_t", F.col("_c.cell").alias("_cell"), F.col("_c.code").alias("_code"))


def _decoded(codes: list[bytes], cells: np.ndarray, centres: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    scale = raw[:, :4].copy().view("<f4")
    return (centres[cells] + raw[:, 4:].view(np.int8) * scale).astype(np.float32)


def _best_codes(asked: pa.Table, rows: pa.Table, centres: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, of rows, and squared distances: the ``needed`` nearest codes in the cells that each query reads."""
    own, codes = rows.column("_cell").to_numpy(), rows.column("_code").combine_chunks()
    values = asked.column("_v").combine_chunks()
    a = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(asked.num_rows, -1)
    names, own = np.unique(own, return_inverse=True)
    wanted = asked.column("_cells").to_pylist()
    order = np.unique(rows.column("_t").to_numpy(), return_inverse=True)[1]
    vectors = np.empty((len(own), a.shape[1]), np.float32)
    for t in range(0, len(own), _WIDE):
        vectors[t : t + _WIDE] = _decoded(codes.slice(t, _WIDE).to_pylist(), names[own[t : t + _WIDE]], centres)
    found = []
    step = _MATRIX_CELLS // _WIDE
    for begin in range(0, len(a), step):
        part = a[begin : begin + step]
        read = np.zeros((len(part), len(names)), bool)
        for i, cells in enumerate(wanted[begin : begin + step]):
            read[i] = np.isin(names, cells)
        q, t, d = np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
        kth = np.full(len(part), np.inf, np.float32)
        for to in range(0, len(vectors), _WIDE):
            near = _squared(part, vectors[to : to + _WIDE])
            near[~read[:, own[to : to + _WIDE]]] = np.inf
            if needed < near.shape[1] and np.isinf(kth).any():
                kth = np.fmin(kth, np.partition(near, needed - 1, axis=1)[:, needed - 1])
            i, j = np.nonzero((near <= kth[:, None]) & np.isfinite(near))
            q, t, d = np.concatenate([q, i]), np.concatenate([t, j + to]), np.concatenate([d, near[i, j]])
            sort = np.lexsort((order[t], d, q))
            q, t, d = q[sort], t[sort], d[sort]
            place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            last = place == needed - 1
            kth[q[last]] = d[last]
            q, t, d = q[place < needed], t[place < needed], d[place < needed]
        found.append((q + begin, t, d))
    return tuple(np.concatenate(x) for x in zip(*found))


def _visited(queries: DataFrame, centres: np.ndarray, sizes: np.ndarray, group: np.ndarray, wanted: int) -> DataFrame:
    """Queries with the cells they read, nearest first until those hold ``wanted`` rows, and the blocks these lie in."""

    @F.pandas_udf("cells array<int>, groups array<int>")
    def visit(vectors: pd.Series) -> pd.DataFrame:
        x, cells = np.stack(vectors.to_numpy()), []
        step = max(1, _MATRIX_CELLS // len(centres))
        for i in range(0, len(x), step):
            order = np.argsort(_squared(x[i : i + step], centres), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) < wanted).sum(axis=1) + 1
            cells += [row[:count].astype("int32") for row, count in zip(order, enough)]
        return pd.DataFrame({"cells": cells, "groups": [np.unique(group[c]).astype("int32") for c in cells]})

    return queries.withColumn("_to", visit("_v"))


def approximate_knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    query_key: str,
    train_key: str,
    query_vector: str,
    train_vector: str,
    share: float = 0.1,
    candidates: int | None = None,
    cells: int | None = None,
    exclude_self: bool = False,
    carry: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """About the k nearest training rows per query by Euclidean distance, as ``knn_join`` returns them.

    A query reads cells that hold ``share`` of all rows; ``candidates`` (8 k by default) of them are measured exactly. Vectors without structure need
    a large share: distances to centres say little there. Distances are exact; ties go to the smaller training key.
    """
    extra = [column(carry).alias("carry")] if carry else []
    train = train.select(column(train_key).alias("_t"), column(train_vector).cast("array<double>").alias("_v"), *extra)
    queries = queries.select(column(query_key).alias("_q"), column(query_vector).cast("array<double>").alias("_v"))
    n = train.count()
    width = n and train.agg(F.max(F.size("_v"))).first()[0]
    out = T.StructType([
        T.StructField("query_key", queries.schema["_q"].dataType),
        T.StructField("neighbour_key", train.schema["_t"].dataType),
        T.StructField("near", T.DoubleType()),
    ])
    needed = candidates or 8 * k
    if not n:
        empty = queries.select(F.col("_q").alias("query_key"), F.lit(None).cast(out["neighbour_key"].dataType).alias("neighbour_key"))
        return _measured(empty.limit(0), queries, train, k, exclude_self, carry)
    centres = _centres(train, n, min(cells or max(int(n**0.5), 1), MAX_CELLS, n))
    coded = materialize(_coded(train, centres))
    counts = {r["_cell"]: r["count"] for r in coded.groupBy("_cell").count().collect()}  # at most MAX_CELLS rows
    sizes = np.array([counts.get(c, 0) for c in range(len(centres))])
    block = block_rows or max(64, BLOCK_BYTES // (4 * width))
    upto = np.cumsum(sizes)
    group = np.maximum(upto - 1, 0) // block  # neighbouring cells share a block until it is full
    parts = np.maximum(np.ceil(np.bincount(group, sizes) / block), 1).astype(int)

    def by(keys, values) -> Column:
        return F.create_map(*[F.lit(int(x)) for pair in zip(keys, values) for x in pair])

    groups = range(len(parts))
    low, high = np.searchsorted(group, groups), np.searchsorted(group, groups, side="right") - 1
    placed = coded.withColumn("_group", by(range(len(centres)), group)[F.col("_cell")])
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("_t"), by(groups, parts)[F.col("_group")]).cast("int"))
    visits = _visited(queries, centres, sizes, group, min(max(int(share * n), needed), n))
    visits = materialize(visits).select("_q", "_v", F.col("_to.cells").alias("_cells"), F.explode("_to.groups").alias("_group"))
    asked = {r["_group"]: r["count"] for r in visits.groupBy("_group").count().collect()}  # at most MAX_CELLS rows
    if not asked:
        empty = queries.select(F.col("_q").alias("query_key"), F.lit(None).cast(out["neighbour_key"].dataType).alias("neighbour_key"))
        return _measured(empty.limit(0), queries, train, k, exclude_self, carry)
    asks = np.array([-(-asked.get(g, 0) // _ASKED) for g in groups])
    group_rows = np.bincount(group, sizes, minlength=len(parts))
    work = sum(asked.get(g, 0) * int(group_rows[g]) for g in groups)
    tasks = int(min(max(work // _TASK_PAIRS, 1), 4 * max(int((asks * parts).sum()), 1), _MAX_TASKS))
    inside = F.filter("_cells", lambda c: (c >= by(groups, low)[F.col("_group")]) & (c <= by(groups, high)[F.col("_group")]))
    visits = visits.withColumn("_cells", inside)
    visits = visits.withColumn("_ask", F.pmod(F.xxhash64("_q"), by(groups, asks)[F.col("_group")]).cast("int"))
    visits = visits.withColumn("_part", F.explode(F.sequence(F.lit(0), by(groups, parts)[F.col("_group")] - 1)))
    placed = placed.filter(by(groups, asks)[F.col("_group")] > 0)
    placed = placed.withColumn("_ask", F.explode(F.sequence(F.lit(0), by(groups, asks)[F.col("_group")] - 1)))
    schema = to_arrow_schema(out)

    def nearest(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return schema.empty_table()
        q, t, near = _best_codes(asked, rows, centres, needed)
        columns = [asked.column("_q").take(pa.array(q)), rows.column("_t").take(pa.array(t)), pa.array(near.astype(float))]
        return pa.table(columns, names=schema.names).cast(schema)

    joint = ["_group", "_part", "_ask"]
    sides = [side.repartition(tasks, *joint).groupBy(*joint) for side in (visits, placed)]
    near = sides[0].cogroup(sides[1]).applyInArrow(nearest, out)
    first = Window.partitionBy("query_key").orderBy("near", "neighbour_key")
    best = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= needed)
    return _measured(best.select("query_key", "neighbour_key"), queries, train, k, exclude_self, carry)


def _measured(pairs: DataFrame, queries: DataFrame, train: DataFrame, k: int, exclude_self: bool, carry: str | None) -> DataFrame:
    """The k nearest of the candidates of each query by their vectors."""
    if exclude_self:
        pairs = pairs.filter("query_key <> neighbour_key")
    both = pairs.join(queries.select(F.col("_q").alias("query_key"), F.col("_v").alias("_a")), "query_key")
    both = both.join(train.withColumnRenamed("_t", "neighbour_key"), "neighbour_key")
    squares = F.zip_with("_a", "_v", lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    window = Window.partitionBy("query_key").orderBy("distance", "neighbour_key")
    kept = [F.col("carry")] if carry else []
    ranked = both.select("query_key", "neighbour_key", distance.alias("distance"), *kept)
    ranked = ranked.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("carry", carry) if carry else ranked


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found; an equal distance counts as found."""
    kth = exact.groupBy("query_key").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n"))
    hits = found.join(kth, "query_key", "right").groupBy("query_key").agg(
        F.first("n").alias("n"), F.count(F.when(F.col("distance") <= F.col("kth") * (1 + 1e-12), 1)).alias("hits")
    )
    row = hits.agg(F.sum(F.least("hits", "n")).alias("hits"), F.sum("n").alias("n")).first()
    return (row["hits"] or 0) / max(row["n"] or 0, 1)
