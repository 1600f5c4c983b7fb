"""Boosted trees over binned features, with penalties on the leaves and one tree per class and round.

Rows are binned once and written, and read as blocks of arrays. A level of all trees of a round is one pass: every task adds up gradients, curvatures and
counts per (node, feature, bin), the sums are merged, and only the best split of each node reaches the driver. The first pass of
a round adds the trees of the round before to the margins and keeps them, so a tree is walked once. Every few rounds the margins
derive from the written table in one step, so a lost executor costs a task of few steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.config import SEED
from tabulark.session import scratch_path

MAX_BINS = 255  # of values; a byte also has room for missing values, bin 0
_BLOCK = 32  # features whose sums travel in one row
_PASS_BYTES = 64 << 20  # sums that a task holds at once; more nodes than fit are taken in several passes
_ROWS, _BYTES = 1 << 16, 4 << 20  # rows of a block, and bytes of its bins
_GATHER_BYTES = 64 << 20  # partial sums that may go to the driver unmerged
_LEAF = 1 << 30


@dataclass(frozen=True)
class Rule:
    """How trees grow. With ``by_count`` splits lower the squared error of the gradients, without penalties."""

    loss: str  # squared, logistic or softmax
    rounds: int = 100
    rate: float = 0.3
    depth: int = 6
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    min_leaf: int = 1
    min_split: int = 2
    subsample: float = 1.0
    colsample: float = 1.0
    bins: int = MAX_BINS
    seed: int = SEED
    by_count: bool = False
    prior: bool = False  # classes start at the logarithms of their shares, not at 0

    def softened(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.reg_alpha, 0.0)

    def quality(self, g, h, n):
        """What a node takes off the loss, times two."""
        top, bottom = (g * g, n) if self.by_count else (self.softened(g) ** 2, h + self.reg_lambda)
        return np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)

    def leaf(self, g: float, h: float, classes: int) -> float:
        bottom = h + self.reg_lambda
        value = -float(self.softened(g)) / bottom if bottom > 1e-150 else 0.0
        if self.by_count and self.loss == "softmax":
            value *= (classes - 1) / classes
        return self.rate * value


class Tree:
    """Nodes in arrays; a leaf points to itself, so that a walk of ``depth`` steps ends there."""

    def __init__(self, value: float = 0.0) -> None:
        self.depth = 0
        self.feature, self.cut, self.threshold = [0], [_LEAF], [math.inf]
        self.missing_left, self.left, self.value = [True], [0], [value]

    def split(self, node: int, depth: int, feature: int, cut: int, threshold: float, missing_left: bool, values: tuple[float, float]) -> int:
        first = len(self.left)
        for i, value in enumerate(values):
            for column, x in zip(
                (self.feature, self.cut, self.threshold, self.missing_left, self.left, self.value),
                (0, _LEAF, math.inf, True, first + i, value),
            ):
                column.append(x)
        self.feature[node], self.cut[node], self.threshold[node] = feature, cut, threshold
        self.missing_left[node], self.left[node], self.depth = missing_left, first, depth
        return first

    def walk(self, cells: np.ndarray, binned: bool) -> np.ndarray:
        """The node where each row ends."""
        feature, left, missing = np.array(self.feature), np.array(self.left), np.array(self.missing_left)
        border = np.array(self.cut) if binned else np.array(self.threshold)
        node, rows = np.zeros(len(cells), np.int64), np.arange(len(cells))
        for _ in range(self.depth):
            x = cells[rows, feature[node]]
            absent = (x == 0) if binned else np.isnan(x)
            node = left[node] + ~np.where(absent, missing[node], x <= border[node])
        return node


def _margins(trees: list[list[Tree]], cells: np.ndarray, start: np.ndarray, binned: bool) -> np.ndarray:
    found = np.array(start, float, copy=True)
    for each in trees:
        for k, tree in enumerate(each):
            found[:, k] += np.array(tree.value)[tree.walk(cells, binned)]
    return found


def _softmax(margins: np.ndarray) -> np.ndarray:
    odds = np.exp(margins - margins.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def gradients(rule: Rule, label: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margins, one column per tree of a round."""
    if rule.loss == "squared":
        return margins - label[:, None], np.ones_like(margins)
    if rule.loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-margins))
        return p - label[:, None], np.maximum(p * (1.0 - p), 1e-16)
    p = _softmax(margins)
    g = p.copy()
    g[np.arange(len(label)), label.astype(int)] -= 1.0
    curve = p * (1.0 - p)
    return g, curve if rule.by_count else np.maximum(2.0 * curve, 1e-16)


def bin_edges(train: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Per feature the values that end a bin: its smallest value and quantiles, without the largest."""
    cells = train.select(F.posexplode(vector_to_array("features")).alias("feature", "x")).filter("not isnan(x)")
    shares = [i / bins for i in range(1, bins)]
    found = cells.groupBy("feature").agg(
        F.percentile_approx("x", shares, 10_000).alias("inner"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    edges = [np.zeros(0)] * width
    for r in found.toLocalIterator():
        points = np.unique([r["low"], *r["inner"]])
        edges[r["feature"]] = points[points < r["high"]][: bins - 1]
    return edges


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column of equal length as a matrix."""
    size = np.dtype(kind).itemsize * width
    if not len(column):
        return np.zeros((0, width), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * size, offsets[0]).view(kind).reshape(len(column), width)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def _binned(train: DataFrame, edges: list[np.ndarray], key: str | None) -> DataFrame:
    """``draw`` (a number of the row), ``label``, ``bins`` (a byte per feature), written once."""
    spark, width = train.sparkSession, len(edges)
    draw = F.xxhash64(F.col(key)) if key else F.monotonically_increasing_id()
    plain = train.select(draw.alias("draw"), F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    shared = spark.sparkContext.broadcast(edges)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            bins = np.empty(x.shape, np.uint8)
            for f, points in enumerate(shared.value):
                bins[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(points, x[:, f], "left"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(bins)], ["draw", "label", "bins"])

    schema = "draw long, label double, bins binary"
    path = scratch_path(spark, "binned")
    plain.mapInArrow(emit, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _packed(binned: DataFrame, width: int) -> RDD:
    """Blocks of rows as arrays: draws, labels, and bins with a row per feature. A pass over them plans no query and reads no rows one by one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, min(_ROWS, _BYTES // max(width, 1)))
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            draw, label, bins = (np.concatenate(x) for x in zip(*held))
            held.clear()
            cells = [pa.array([x.tobytes()], pa.binary()) for x in (draw, label, np.ascontiguousarray(bins.T))]
            return pa.RecordBatch.from_arrays(cells, ["draw", "label", "bins"])

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                some = batch.slice(start, most)
                if held and sum(len(x[0]) for x in held) + some.num_rows > most:
                    yield block()
                held.append((some.column(0).to_numpy(), some.column(1).to_numpy(), _matrix(some.column(2), np.uint8, width)))
        if held:
            yield block()

    def arrays(row) -> tuple[np.ndarray, ...]:
        draw, label = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.float64)
        return draw, label, np.frombuffer(row[2], np.uint8).reshape(width, len(draw))

    return binned.mapInArrow(emit, "draw binary, label binary, bins binary").rdd.map(arrays)


@dataclass(frozen=True)
class _Settle:
    """Gives a block its margins after these trees, from the margins it has, or from ``base`` if it has none."""

    trees: list[list[Tree]]
    base: np.ndarray

    def __call__(self, block: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        draw, label, bins, *had = block
        start = had[0] if had else np.broadcast_to(self.base, (len(draw), len(self.base)))
        return draw, label, bins, _margins(self.trees, bins.T, start, True)


def _settled(blocks: RDD, trees: list[list[Tree]], base: np.ndarray) -> RDD:
    return blocks.map(_Settle(trees, base)).persist(StorageLevel.MEMORY_AND_DISK)


def _drawn(rows: np.ndarray, number: int, rule: Rule) -> np.ndarray:
    """Which rows a round learns from: by their own number, so the same wherever they lie."""
    if rule.subsample >= 1.0:
        return np.ones(len(rows), bool)
    x = rows.view(np.uint64) ^ np.uint64((rule.seed * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 < rule.subsample


@dataclass(frozen=True)
class _Level:
    """What a pass needs: the open nodes of a round's trees."""

    rule: Rule
    number: int
    growing: list[Tree]
    columns: list[np.ndarray]  # features of each growing tree
    open: list[tuple[int, int]]  # tree of the round, node
    width: int
    bins: int


@dataclass(frozen=True)
class _Sums:
    """Partial sums of a task: slot, block of features, part and sums for each open node and block. Pickled by name, as it goes out with each pass."""

    level: _Level

    def __call__(self, part: int, blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
        level = self.level
        trees, size = len(level.growing), level.bins
        # With the squared loss each row has the curvature 1, so these sums are the counts.
        flat = level.rule.loss == "squared"
        slots: list[dict[int, int]] = [{} for _ in range(trees)]
        for k, node in level.open:
            slots[k][node] = len(slots[k])
        sums = [np.zeros((3, len(c), max(len(s), 1), size)) for c, s in zip(level.columns, slots)]
        for draw, label, bins, margins in blocks:
            if level.rule.subsample < 1.0:
                use = _drawn(draw, level.number, level.rule)
                label, bins, margins = label[use], bins[:, use], margins[use]
            g, h = gradients(level.rule, label, margins)
            for k, tree in enumerate(level.growing):
                if not slots[k]:
                    continue
                place = np.full(len(tree.left), -1)
                place[list(slots[k])] = list(slots[k].values())
                at = place[tree.walk(bins.T, True)]
                own, gk, hk = bins, g[:, k], h[:, k]
                if (at < 0).any():
                    here = at >= 0
                    at, own, gk, hk = at[here], bins[:, here], gk[here], hk[here]
                at, cells = at * size, len(slots[k]) * size
                for i, f in enumerate(level.columns[k]):
                    cell = at + own[f]
                    sums[k][0, i] += np.bincount(cell, gk, cells).reshape(-1, size)
                    sums[k][2, i] += np.bincount(cell, None, cells).reshape(-1, size)
                    if not flat:
                        sums[k][1, i] += np.bincount(cell, hk, cells).reshape(-1, size)
        for k in range(trees):
            if flat:
                sums[k][1] = sums[k][2]
        for slot, (k, node) in enumerate(level.open):
            for block in range(0, len(level.columns[k]), _BLOCK):
                yield slot, block, part, np.ascontiguousarray(sums[k][:, block : block + _BLOCK, slots[k][node]])


def _merged(parts: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """The sum of partial sums, in the order of their parts."""
    total = None
    for _, own in sorted(parts, key=lambda x: x[0]):
        total = own.copy() if total is None else total + own
    return total


def best_split(rule: Rule, sums: np.ndarray) -> tuple:
    """The best cut of a node in a block of features, from sums of shape (3, features, bins).

    Returns gain, feature of the block, last bin on the left, whether missing values go left, the sums on the left and
    those of the node; among equals the first feature, the smallest cut and missing values on the left.
    """
    whole = sums[:, 0].sum(axis=1)
    upto = np.cumsum(sums[:, :, 1:], axis=2)[:, :, :-1]
    with_missing = upto + sums[:, :, :1]
    left = np.stack([with_missing, upto], axis=3)
    right = whole[:, None, None, None] - left
    gain = (rule.quality(*left) + rule.quality(*right) - rule.quality(*whole[:, None])) / 2.0
    allowed = (left[2] >= max(rule.min_leaf, 1)) & (right[2] >= max(rule.min_leaf, 1))
    if not rule.by_count:
        allowed &= (left[1] >= rule.min_child_weight) & (right[1] >= rule.min_child_weight)
    gain = np.where(allowed, gain, -np.inf)
    if not gain.size:
        return -math.inf, 0, 0, True, *np.zeros(3).tolist(), *whole.tolist()
    # Sums in another order differ in their last digits; a gain within those is no better.
    top = gain.max()
    close = gain >= top - 1e-12 * abs(top) if np.isfinite(top) else gain == top
    f, cut, side = np.unravel_index(np.argmax(close), gain.shape)
    return float(gain[f, cut, side]), int(f), int(cut) + 1, side == 0, *left[:, f, cut, side].tolist(), *whole.tolist()


def _splits(settled: RDD, level: _Level, parts: int) -> list[tuple]:
    """The best split of each open node."""
    sums = settled.mapPartitionsWithIndex(_Sums(level))
    rule = level.rule
    if parts * sum(24 * level.bins * len(level.columns[k]) for k, _ in level.open) <= _GATHER_BYTES:
        own: dict[tuple[int, int], list] = {}
        for slot, block, part, found in sums.collect():
            own.setdefault((slot, block), []).append((part, found))
        found = [(*key, *best_split(rule, _merged(some))) for key, some in own.items()]
    else:
        fewer = math.isqrt(parts) + 1
        some = sums.map(lambda r: ((*r[:2], r[2] // fewer), r[2:])).groupByKey(parts).mapValues(_merged)
        whole = some.map(lambda r: (r[0][:2], (r[0][2], r[1]))).groupByKey(parts)
        found = whole.map(lambda r: (*r[0], *best_split(rule, _merged(r[1])))).collect()
    best: list[tuple] = [()] * len(level.open)
    for slot, block, gain, feature, *rest in sorted(found, key=lambda r: r[:2]):
        if not best[slot] or gain > best[slot][0] + 1e-12 * abs(gain):
            k = level.open[slot][0]
            best[slot] = (gain, int(level.columns[k][min(block + feature, len(level.columns[k]) - 1)]), *rest)
    return best


@dataclass(frozen=True)
class Boosted:
    """A fitted model: start margins and the trees of each round."""

    loss: str
    base: np.ndarray
    trees: list[list[Tree]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for classes, ``scores`` (one probability per class)."""
        shared = df.sparkSession.sparkContext.broadcast((self.loss, self.base, self.trees))

        @F.pandas_udf("array<double>")
        def scored(vectors: pd.Series) -> pd.Series:
            loss, base, trees = shared.value
            cells = np.stack(vectors.to_numpy())
            margins = _margins(trees, cells, np.broadcast_to(base, (len(cells), len(base))), False)
            if loss == "logistic":
                p = 1.0 / (1.0 + np.exp(-margins[:, 0]))
                margins = np.column_stack([1.0 - p, p])
            elif loss == "softmax":
                margins = _softmax(margins)
            return pd.Series(list(margins))

        found = df.withColumn("scores", scored(vector_to_array("features")))
        if self.loss == "squared":
            return found.withColumn("prediction", F.col("scores")[0]).drop("scores")
        return found.withColumn("prediction", (F.array_position("scores", F.array_max("scores")) - 1).cast("double"))


def _start(train: DataFrame, rule: Rule, classes: int) -> tuple[int, np.ndarray]:
    """Number of rows, and the margins before the first tree."""
    if rule.loss == "squared":
        row = train.agg(F.count("label").alias("n"), F.avg(F.col("label").cast("double")).alias("mean")).first()
        return row["n"], np.array([row["mean"] or 0.0])
    counts = np.zeros(classes)
    for r in train.groupBy(F.col("label").cast("int").alias("label")).count().collect():
        counts[r["label"]] = r["count"]
    n = int(counts.sum())
    if not rule.prior or not n:
        return n, np.zeros(1 if rule.loss == "logistic" else classes)
    shares = np.maximum(counts / n, 1e-12)
    return n, np.log(shares[1:] / shares[:1]) if rule.loss == "logistic" else np.log(shares)


def fit(train: DataFrame, rule: Rule, classes: int = 2, key: str | None = None) -> Boosted:
    """Fit on ``label`` and the vectors ``features``; missing numbers (NaN) go where they help more.

    ``key`` names the unique column that decides which rows a round draws; without one their order in ``train`` does.
    The driver holds the edges of the bins (``width`` times ``rule.bins`` numbers) and the trees. A table without rows
    gives a model without trees.
    """
    if not 2 <= rule.bins <= MAX_BINS:
        raise ValueError(f"bins are 2 to {MAX_BINS}")
    n, base = _start(train, rule, classes)
    if not n:
        return Boosted(rule.loss, base, [])
    width = len(train.select("features").first()[0])
    edges = bin_edges(train, width, rule.bins)
    bins = max((len(e) for e in edges), default=0) + 2
    binned = _packed(_binned(train, edges, key), width)
    parts = max(binned.getNumPartitions(), 1)
    every = math.isqrt(rule.rounds) + 1
    trees: list[list[Tree]] = []
    settled = _settled(binned, [], base)
    kept = [settled]  # margins that those of this round derive from
    try:
        for number in range(rule.rounds):
            if number and number % every == 0:
                settled, old = _settled(binned, trees, base), kept
                kept = [settled]
                for rows in old:
                    rows.unpersist()
            elif number:
                settled = _settled(settled, trees[-1:], base)
                kept.append(settled)
            trees.append(_round(settled, rule, number, edges, bins, len(base), classes, parts))
            if len(kept) > 2:
                kept.pop(-2).unpersist()
    finally:
        for rows in kept:
            rows.unpersist()
    return Boosted(rule.loss, base, trees)


def _round(settled, rule: Rule, number: int, edges, bins: int, count: int, classes: int, parts: int) -> list[Tree]:
    width = len(edges)
    growing, columns = [Tree() for _ in range(count)], []
    for k in range(count):
        random = np.random.default_rng([rule.seed, number, k])
        chosen = max(1, round(rule.colsample * width))
        columns.append(np.sort(random.choice(width, chosen, replace=False)) if chosen < width else np.arange(width))
    open_nodes = [(k, 0) for k in range(count)] if width else []
    for depth in range(1, rule.depth + 1):
        following = []
        # All open nodes in one pass, unless their sums would not fit a task.
        at_once = max(1, _PASS_BYTES // (24 * bins * max(len(c) for c in columns))) if open_nodes else 1
        for first in range(0, len(open_nodes), at_once):
            some = open_nodes[first : first + at_once]
            # The trees as they were when the level began: nodes are split only after all sums of the level.
            level = _Level(rule, number, growing, columns, some, width, bins)
            following += list(zip(some, _splits(settled, level, parts)))
        open_nodes = []
        for (k, node), (gain, feature, cut, missing_left, lg, lh, ln, g, h, n) in following:
            if depth == 1:
                growing[k].value[node] = rule.leaf(g, h, classes)
            if n < rule.min_split or not gain > rule.gamma + 1e-12 * float(rule.quality(np.array([g]), np.array([h]), np.array([n]))[0]):
                continue
            points = edges[feature]
            threshold = float(points[cut - 1]) if cut <= len(points) else math.inf
            values = (rule.leaf(lg, lh, classes), rule.leaf(g - lg, h - lh, classes))
            child = growing[k].split(node, depth, feature, cut, threshold, bool(missing_left), values)
            open_nodes += [(k, child), (k, child + 1)]
        if not open_nodes:
            break
    return growing
