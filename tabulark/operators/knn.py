"""Exact k nearest neighbours as an equi-join on cells of the vector space.

Training rows belong to the cell of their nearest pivot. A query visits only the cells
that can hold one of its k nearest rows by the triangle inequality. Cells are packed into
groups of the size of a task and larger ones cut by a hash of the row key, so copies of one
vector spread over many tasks; the queries of a group are cut likewise. A task measures
tiles of bounded size and returns the k best per query, never all pairs.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulark.config import SEED
from tabulark.functions.columns import column, hash_int
from tabulark.operators.lookup import join_lookup, settle
from tabulark.session import materialize

_BLOCK_BYTES = 16 << 20
_MATRIX_CELLS, _TILE_CELLS, _TILE_ROWS = 1 << 20, 1 << 16, 4096  # pairs by product, pairs by differences, rows at once
#: Queries of a block and pairs of a task: differences take longer than products, powers longer still.
_ASKED = {"euclidean": 32768, "manhattan": 8192, "minkowski": 1024}
_TASK_PAIRS, _MAX_TASKS = {"euclidean": 1 << 26, "manhattan": 1 << 23, "minkowski": 1 << 20}, 20_000
_MAX_PIVOTS = 512
_CELLS_SENT = 100_000  # cells of all classes, of three numbers each
_SLACK = 1e-9  # widens pruning bounds against rounding


def _distances(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """All distances between the rows of a and of b, one dimension at a time."""
    total, difference = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for j in range(len(a)):
        np.abs(np.subtract.outer(a[j], b[j], out=difference), out=difference)
        total += difference if metric == "manhattan" else difference**p
    return total if metric == "manhattan" else total ** (1.0 / p)


def _first_k(rows, cols, distance, order, k):
    sort = np.lexsort((order[cols], distance, rows))
    rows, cols, distance = rows[sort], cols[sort], distance[sort]
    starts = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - starts < k
    return rows[keep], cols[keep], distance[keep]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    values = table.column(name).combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(values), -1)


def _visitors(cells: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The cells that the queries of a task read, in order, and beside each the query."""
    lists = cells.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    read = lists.flatten().to_numpy(zero_copy_only=False)
    query = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    sort = np.argsort(read, kind="stable")
    return read[sort], query[sort]


class _Nearest:
    """The k best rows of b so far for each row of a, brought up to date tile by tile."""

    def __init__(self, a: np.ndarray, b: np.ndarray, order: np.ndarray, k: int, metric: str, p: float):
        self.a, self.b, self.order, self.k, self.metric, self.p = a, b, order, k, metric, p
        self.distance = np.full((len(a), k), np.inf)
        self.row = np.full((len(a), k), -1)
        if metric == "euclidean":
            self.norms_a, self.norms_b = (a * a).sum(1), (b * b).sum(1)
            self.error = 1e-12 * a.shape[1] * (self.norms_a + (self.norms_b.max() if len(b) else 0.0)) + 1e-300

    def _candidates(self, at: np.ndarray, to: np.ndarray, skip: np.ndarray | None):
        """Pairs of a tile that may be among the k best, with their distances.

        For Euclidean distances a matrix product ranks the pairs; those within its rounding error of the k-th best are
        measured again by differences.
        """
        kth = self.distance[at, -1]
        if self.metric == "euclidean":
            near = self.norms_a[at, None] + self.norms_b[None, to] - 2.0 * (self.a[at] @ self.b[to].T)
            kth = kth * kth
        else:
            near = _distances(self.a[at], self.b[to], self.metric, self.p)
        if skip is not None:
            near[skip] = np.inf
        new = np.flatnonzero(np.isinf(kth))
        if len(new) and self.k < len(to):
            kth[new] = np.fmin(np.inf, np.partition(near[new], self.k - 1, axis=1)[:, self.k - 1])
        if self.metric == "euclidean":
            kth = kth + self.error[at]
        rows, cols = np.nonzero((near <= kth[:, None]) & np.isfinite(near))
        if self.metric != "euclidean":
            return at[rows], to[cols], near[rows, cols]
        rows, cols = at[rows], to[cols]
        exact = np.empty(len(rows))
        step = max(1, _MATRIX_CELLS // max(self.a.shape[1], 1))
        for s in range(0, len(rows), step):
            part = slice(s, s + step)
            difference = self.a[rows[part]] - self.b[cols[part]]
            exact[part] = np.sqrt((difference * difference).sum(1))
        return rows, cols, exact

    def update(self, at: np.ndarray, to: np.ndarray, skip: np.ndarray | None) -> None:
        rows, cols, distance = self._candidates(at, to, skip)
        if not len(rows):
            return
        known = np.unique(rows)
        held = self.row[known]
        rows = np.concatenate([rows, np.repeat(known, (held >= 0).sum(1))])
        cols = np.concatenate([cols, held[held >= 0]])
        distance = np.concatenate([distance, self.distance[known][held >= 0]])
        rows, cols, distance = _first_k(rows, cols, distance, self.order, self.k)
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        self.distance[rows, place], self.row[rows, place] = distance, cols


def _block_join(
    k: int, metric: str, p: float, exclude_self: bool, carry: list[str], schema: pa.Schema, at_once: int
):
    """The k best of the rows of a block for each query, by tiles of at most ``at_once`` rows and a bounded number of pairs."""
    pairs = _MATRIX_CELLS if metric == "euclidean" else _TILE_CELLS

    def best(queries: pa.Table, train: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or train.num_rows == 0:
            return schema.empty_table()
        a, b = _matrix(queries, "_v"), _matrix(train, "_v")
        query_keys = queries.column("_q").to_numpy()
        train_keys = train.column("_t").to_numpy()
        order = np.unique(train_keys, return_inverse=True)[1]
        found = _Nearest(a, b, order, k, metric, p)
        read, readers = _visitors(queries.column("_visit"))
        own = train.column("_cell").to_numpy()
        by_cell = np.argsort(own, kind="stable")
        own = own[by_cell]
        for cell in np.unique(own):
            asked = readers[np.searchsorted(read, cell) : np.searchsorted(read, cell, side="right")]
            rows = by_cell[np.searchsorted(own, cell) : np.searchsorted(own, cell, side="right")]
            wide = min(len(rows), at_once, _TILE_ROWS)
            high = max(1, pairs // wide)
            for s in range(0, len(asked), high):
                at = asked[s : s + high]
                for t in range(0, len(rows), wide):
                    to = rows[t : t + wide]
                    found.update(at, to, query_keys[at, None] == train_keys[None, to] if exclude_self else None)
        rows, place = np.nonzero(found.row >= 0)
        cols = found.row[rows, place]
        columns = [queries.column("_q").take(pa.array(rows)), train.column("_t").take(pa.array(cols)), pa.array(found.distance[rows, place])]
        columns += [train.column(c).take(pa.array(cols)) for c in carry]
        return pa.table(columns, names=schema.names).cast(schema)

    return best


def _numbers(df: DataFrame, name: str) -> Column:
    """The vector as it is moved: single numbers stay single, they are measured as doubles."""
    kind = df.select(column(name).alias("_v")).schema["_v"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return column(name) if single else column(name).cast("array<double>")


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    query_key: str,
    train_key: str,
    query_vector: str,
    train_vector: str,
    metric: str = "euclidean",
    p: float = 2.0,
    within: str | None = None,
    exclude_self: bool = False,
    carry: str | None = None,
    block_rows: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """The k nearest training rows per query as (query_key, neighbour_key, distance, rank[, carry]).

    Keys are unique columns, vectors are arrays of equal length. Ties go to the smaller
    training key. `within` limits neighbours to rows with the same value of that column;
    `exclude_self` leaves out the training row with the query's key. `block_rows` is the most
    training rows that are measured at once.
    """
    if metric == "minkowski" and p == 2.0:
        metric = "euclidean"
    if metric not in ("euclidean", "manhattan", "minkowski"):
        raise ValueError(f"unknown metric '{metric}'")

    def same(df: DataFrame) -> Column:
        return column(within).cast("string") if within else F.lit("")

    extra = [column(carry).alias("carry")] if carry else []
    train = train.select(
        column(train_key).alias("_t"), _numbers(train, train_vector).alias("_v"), same(train).alias("_w"), *extra
    )
    queries = queries.select(
        column(query_key).alias("_q"), _numbers(queries, query_vector).alias("_v"), same(queries).alias("_w")
    )
    shape = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    width = max(shape["d"] or 1, 1)
    block = block_rows or max(64, _BLOCK_BYTES // (8 * width))
    count = pivots or int(min(max(shape["n"] // block, 1), _MAX_PIVOTS))
    # A few rows in hash order, whatever the size of the table.
    chosen = train.orderBy(hash_int(["_t"], "pivot", SEED), "_t").select("_v").limit(count).collect()
    centres = np.array([r["_v"] for r in chosen], dtype=float).reshape(len(chosen), -1)
    p = 1.0 if metric == "manhattan" else p

    if len(centres) <= 1:
        train = train.withColumn("_cell", F.lit(0))
        visited = queries.withColumn("_visit", F.array(F.lit(0)))
    else:
        # Written once: the statistics, the counts and the join below all read them.
        train = materialize(_assign_cells(train, centres, metric, p))
        visited = materialize(_visited_cells(queries, train, centres, metric, p, k + int(exclude_self)))

    # Neighbouring cells of a class share a group until it holds as many rows as a task takes; a query moves once for each part
    # of a group that it reads, not once for each cell and block.
    held = max(block, _BLOCK_BYTES // (8 * width))
    upto = F.sum("_n").over(Window.partitionBy("_w").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = train.groupBy("_w", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells, _ = settle(cells.withColumn("_group", F.floor((upto - 1) / held).cast("int")), _CELLS_SENT)
    groups = cells.groupBy("_w", "_group").agg(
        F.min("_cell").alias("_low"), F.max("_cell").alias("_high"), F.ceil(F.sum("_n") / held).cast("int").alias("_parts"), F.sum("_n").alias("_n")
    )
    spans = groups.groupBy("_w").agg(F.sort_array(F.collect_list(F.struct("_group", "_low", "_high", "_parts"))).alias("_groups"))

    def inside(g: Column) -> Column:
        return F.filter("_visit", lambda c: (c >= g["_low"]) & (c <= g["_high"]))

    read = F.filter("_groups", lambda g: F.exists("_visit", lambda c: (c >= g["_low"]) & (c <= g["_high"])))
    visits = join_lookup(visited, spans, ["_w"], "inner").select("_q", "_v", "_w", "_visit", F.explode(read).alias("_g"))
    visits = visits.select("_q", "_v", "_w", inside(F.col("_g")).alias("_visit"), "_g._group", "_g._parts")
    asked = visits.groupBy("_w", "_group").agg(F.count(F.lit(1)).alias("_asked"))
    asked = asked.withColumn("_asks", F.ceil(F.col("_asked") / _ASKED[metric]).cast("int"))
    plan, _ = settle(groups.join(asked, ["_w", "_group"]), _CELLS_SENT)  # at most one row per cell
    work = plan.agg(F.sum(F.col("_n") * F.col("_asked")).alias("pairs"), F.sum(F.col("_parts") * F.col("_asks")).alias("blocks")).first()
    # Tasks are counted by the pairs they measure, not by the bytes they read.
    tasks = int(min(max((work["pairs"] or 0) // _TASK_PAIRS[metric], 1), 4 * (work["blocks"] or 1), _MAX_TASKS))
    of_cell = cells.drop("_n").join(plan.select("_w", "_group", "_parts", "_asks"), ["_w", "_group"])
    train = join_lookup(train, of_cell, ["_w", "_cell"], "inner").select(
        "_t", "_v", "_w", "_cell", "_group", *[c for c in ["carry"] if carry],
        F.pmod(F.xxhash64("_t"), F.col("_parts")).cast("int").alias("_part"),
        F.explode(F.sequence(F.lit(0), F.col("_asks") - 1)).alias("_ask"),
    )
    visits = join_lookup(visits, plan.select("_w", "_group", "_asks"), ["_w", "_group"], "inner").select(
        "_q", "_v", "_w", "_visit", "_group",
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
        F.pmod(F.xxhash64("_q"), F.col("_asks")).cast("int").alias("_ask"),
    )
    fields = [
        T.StructField("query_key", visits.schema["_q"].dataType),
        T.StructField("neighbour_key", train.schema["_t"].dataType),
        T.StructField("distance", T.DoubleType()),
    ]
    if carry:
        fields.append(T.StructField("carry", train.schema["carry"].dataType))
    schema = T.StructType(fields)
    joint = ["_w", "_group", "_part", "_ask"]
    best = _block_join(k, metric, p, exclude_self, ["carry"] if carry else [], to_arrow_schema(schema), block)
    sides = [side.repartition(tasks, *joint).groupBy(*joint) for side in (visits, train)]
    found = sides[0].cogroup(sides[1]).applyInArrow(best, schema)
    window = Window.partitionBy("query_key").orderBy("distance", "neighbour_key")
    ranked = found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("carry", carry) if carry else ranked


def _assign_cells(train: DataFrame, centres: np.ndarray, metric: str, p: float) -> DataFrame:
    @F.pandas_udf("cell int, reach double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        x, cell, reach = np.stack(vectors.to_numpy()).astype(float), np.empty(len(vectors), "int32"), np.empty(len(vectors))
        for step in range(0, len(x), 2000):
            d = _distances(x[step : step + 2000], centres, metric, p)
            cell[step : step + 2000], reach[step : step + 2000] = d.argmin(1), d.min(1)
        return pd.DataFrame({"cell": cell, "reach": reach})

    placed = train.withColumn("_near", nearest("_v"))
    return placed.select(
        *train.columns, F.col("_near.cell").alias("_cell"), F.col("_near.reach").alias("_reach")
    )


def _cells_to_visit(
    distance: np.ndarray, cells: np.ndarray, n: np.ndarray, reach: np.ndarray, between: np.ndarray | None, needed: int
) -> list[np.ndarray]:
    """For each query (a row of distances to all pivots) the cells of its class that may hold one of its `needed` nearest rows."""
    near, row = distance[:, cells], np.arange(len(distance))
    far = near + reach
    order = np.argsort(far, axis=1)
    upto = np.cumsum(n[order], axis=1)
    first = (upto >= needed).argmax(axis=1)
    bound = np.where(upto[:, -1] >= needed, far[row, order[row, first]], np.inf)
    least = near - reach
    if between is not None:
        own = distance.argmin(axis=1)
        gap = between[own][:, cells]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (near**2 - distance[row, own][:, None] ** 2) / (2 * gap), 0.0)
        least = np.maximum(least, plane)
    chosen = least <= (bound * (1 + _SLACK) + _SLACK)[:, None]
    return [cells[mask].astype("int32") for mask in chosen]


def _visited_cells(
    queries: DataFrame, train: DataFrame, centres: np.ndarray, metric: str, p: float, needed: int
) -> DataFrame:
    """Queries with the cells that may hold one of their `needed` nearest rows.

    Sizes and reaches of the cells go to the tasks once, as one broadcast, if there are at most `_CELLS_SENT` of them;
    with more classes than that they are joined to the queries.
    """
    rows = train.groupBy("_w", "_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_reach").alias("r"))
    rows, _ = settle(rows, _CELLS_SENT)
    between = _distances(centres, centres, metric, p) if metric == "euclidean" else None

    def distances(vectors: pd.Series) -> np.ndarray:
        return _distances(np.stack(vectors.to_numpy()).astype(float), centres, metric, p)

    if rows.count() <= _CELLS_SENT:
        table = {w: part for w, part in rows.toPandas().groupby("_w")}
        known = {w: tuple(part[c].to_numpy() for c in ("_cell", "n", "r")) for w, part in table.items()}
        sent = queries.sparkSession.sparkContext.broadcast(known)

        @F.pandas_udf("array<int>")
        def visit_sent(vectors: pd.Series, classes: pd.Series) -> pd.Series:
            out = np.empty(len(vectors), object)
            for w, at in classes.groupby(classes).indices.items():
                for step in range(0, len(at), 2000):
                    part = at[step : step + 2000]
                    found = _cells_to_visit(distances(vectors.iloc[part]), *sent.value[w], between, needed) if w in sent.value else None
                    for i, place in enumerate(part):
                        out[place] = found[i] if found else None
            return pd.Series(out)

        return queries.withColumn("_visit", visit_sent("_v", "_w")).filter("_visit IS NOT NULL")

    # One array per class, at most one entry per pivot.
    per_class = rows.groupBy("_w").agg(F.sort_array(F.collect_list(F.struct("_cell", "n", "r"))).alias("_cells"))

    @F.pandas_udf("array<int>")
    def visit_joined(vectors: pd.Series, cells: pd.Series, counts: pd.Series, reaches: pd.Series) -> pd.Series:
        found = [
            _cells_to_visit(d[None, :], np.asarray(c, int), np.asarray(n), np.asarray(r), between, needed)[0]
            for d, c, n, r in zip(distances(vectors), cells, counts, reaches)
        ]
        return pd.Series(found)

    spread = join_lookup(queries, per_class, ["_w"], "inner")
    return spread.select(*queries.columns, visit_joined("_v", "_cells._cell", "_cells.n", "_cells.r").alias("_visit"))


def knn_classify(
    neighbours: DataFrame, label: str, classes: int, weights: str = "uniform"
) -> DataFrame:
    """Vote of the neighbours: (query_key, prediction, scores); ties go to the smallest label."""
    exact_hits = F.sum(F.when(F.col("distance") == 0, 1.0).otherwise(0.0))

    def share(c):
        mine = F.col(label) == c
        if weights == "uniform":
            return F.sum(F.when(mine, 1.0).otherwise(0.0))
        near = F.sum(F.when(mine & (F.col("distance") == 0), 1.0).otherwise(0.0))
        far = F.sum(F.when(mine & (F.col("distance") > 0), 1.0 / F.col("distance")).otherwise(0.0))
        return F.when(exact_hits > 0, near).otherwise(far)

    votes = neighbours.groupBy("query_key").agg(F.array(*[share(c) for c in range(classes)]).alias("votes"))
    total = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v)
    best = F.array_position("votes", F.array_max("votes")) - 1
    return votes.select(
        "query_key", best.cast("double").alias("prediction"), F.transform("votes", lambda v: v / total).alias("scores")
    )


def knn_regress(neighbours: DataFrame, label: str, weights: str = "uniform") -> DataFrame:
    """Mean of the neighbours' values, weighted by 1/distance if asked."""
    if weights == "uniform":
        value = F.avg(label)
    else:
        hit = F.col("distance") == 0
        exact = F.avg(F.when(hit, F.col(label)))
        weight = F.when(~hit, 1.0 / F.col("distance"))
        value = F.coalesce(exact, F.try_divide(F.sum(weight * F.col(label)), F.sum(weight)))
    return neighbours.groupBy("query_key").agg(value.alias("prediction"))
