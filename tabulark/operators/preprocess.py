"""Feature preparation: fit on one frame, apply as Column expressions to any other.

Fitted parameters are one small row (or a dictionary per categorical column); applying them is a
projection, so a whole plan of steps costs one pass over the data beyond the fits.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import PCA, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.config import HOT_GROUP_BYTES, HOT_GROUP_ROWS
from tabulark.functions.columns import (
    categorical_columns,
    column,
    is_missing,
    number,
    numeric_columns,
    ratio,
)
from tabulark.operators.lookup import join_lookup, settle
from tabulark.operators.ordered import numbered
from tabulark.operators.quantiles import exact_quantiles
from tabulark.operators.scalars import collect_scalars
from tabulark.session import materialize

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Fitted:
    """A fitted step: apply it to any frame with the same columns."""

    apply: Transform
    params: dict = field(default_factory=dict)


def _fitted_values(df: DataFrame, columns: Sequence[str], **aggregates: Callable[[Column], Column]) -> dict:
    found = collect_scalars(df, {(n, c): fn(number(df, c)) for c in columns for n, fn in aggregates.items()})
    return {n: {c: found[n, c] for c in columns} for n in aggregates}


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else column(c) for c in df.columns])


# Imputation


def fit_impute_numeric(df: DataFrame, columns: Sequence[str], method: str) -> Fitted:
    """Fill with the mean, or with the exact median for any other method."""
    columns = list(columns)
    if not columns:
        return Fitted(lambda d: d)
    if method == "mean":
        fill = _fitted_values(df, columns, mean=F.avg)["mean"]
    else:
        fill = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}

    def apply(d: DataFrame) -> DataFrame:
        return _replace(d, {c: F.coalesce(number(d, c), F.lit(v).cast("double")) for c, v in fill.items()})

    return Fitted(apply, {"fill": fill})


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """The most frequent value per column, the smallest one on ties, as text.

    Values are counted as (column, value) rows, so a column with many values spreads over
    the cluster instead of filling one buffer.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("k"), column(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(cells)).filter("v IS NOT NULL").groupBy("k", "v").count()
    best = counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v")).collect()
    found = {columns[r["k"]]: r["v"] for r in best}
    return {c: found.get(c) for c in columns}


def fit_impute_mode(df: DataFrame, columns: Sequence[str]) -> Fitted:
    """Fill with the most frequent value, `unknown` where a column has none."""
    columns = list(columns)
    if not columns:
        return Fitted(lambda d: d)
    fill = most_frequent(df, columns)

    def apply(d: DataFrame) -> DataFrame:
        new = {}
        for c, value in fill.items():
            if isinstance(d.schema[c].dataType, T.BooleanType) and value is not None:
                new[c] = F.coalesce(column(c), F.lit(value == "true"))
            else:
                new[c] = F.coalesce(column(c).cast("string"), F.lit("unknown" if value is None else value))
        return _replace(d, new)

    return Fitted(apply, {"fill": fill})


# Scaling


def fit_scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> Fitted:
    """`minmax` to [0, 1], `robust` by median and quartiles, anything else `standard` with
    the population deviation. A column without spread is only centred."""
    columns = list(columns)
    if not columns:
        return Fitted(lambda d: d)
    if method == "minmax":
        found = _fitted_values(df, columns, low=F.min, high=F.max)
        centre = found["low"]
        spread = {c: None if found["low"][c] is None else found["high"][c] - found["low"][c] for c in columns}
    elif method == "robust":
        quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        centre = {c: q[1] for c, q in quartiles.items()}
        spread = {c: None if q[0] is None else q[2] - q[0] for c, q in quartiles.items()}
    else:
        found = _fitted_values(df, columns, mean=F.avg, std=F.stddev_pop)
        centre, spread = found["mean"], found["std"]
    divisor = {c: s or 1.0 for c, s in spread.items()}

    def apply(d: DataFrame) -> DataFrame:
        return _replace(
            d,
            {c: (number(d, c) - F.lit(centre[c]).cast("double")) / F.lit(divisor[c]) for c in columns},
        )

    return Fitted(apply, {"centre": centre, "divisor": divisor})


# Encoding


def category_dictionary(df: DataFrame, name: str, missing: str | None, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """(value, code) of the sorted distinct values of a column, codes from 0; numbers sort as numbers, all else as text."""
    value = column(name)
    if not isinstance(df.schema[name].dataType, T.NumericType):
        value = value.cast("string")
        if missing is not None:
            value = F.coalesce(value, F.lit(missing))
    values = df.filter(~is_missing(df, name)) if missing is None else df
    values = values.select(value.alias("value")).distinct()
    return _numbered_values(values, [], hot_rows).select("value", (F.col("no") - 1).alias("code"))


def _numbered_values(values: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame:
    """`no` in the order of `value`; few values that are long are too much for one task as well."""
    width = F.sum(F.octet_length(F.col("value").cast("string"))).alias("bytes")
    bytes_ = values.groupBy(*by).agg(width).agg(F.max("bytes")).first()[0] or 0
    return numbered(values, by, [F.col("value")], "no", hot_rows if bytes_ <= HOT_GROUP_BYTES else 0)


def category_dictionaries(df: DataFrame, columns: Sequence[str], missing: str | None, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """(k, value, code) of the sorted distinct texts of all columns, k the place of the column: one pass, computed once."""
    cells = [F.struct(F.lit(i).alias("k"), column(c).cast("string").alias("value")) for i, c in enumerate(columns)]
    values = df.select(F.inline(F.array(*cells)))
    values = values.filter("value IS NOT NULL") if missing is None else values.withColumn("value", F.coalesce("value", F.lit(missing)))
    codes = _numbered_values(values.distinct(), ["k"], hot_rows)
    return settle(codes.select("k", "value", (F.col("no") - 1).alias("code")))[0]


def _coded(d: DataFrame, name: str, dictionary: DataFrame, missing: str | None, output: str) -> DataFrame:
    """The column's code as `output`, NULL for a value that is not in the dictionary. No column of `d` is lost."""
    value, code = fresh(d, "value", output), fresh(d, "code", output)
    text = column(name).cast("string")
    d = d.withColumn(value, text if missing is None else F.coalesce(text, F.lit(missing)))
    renamed = dictionary.select(F.col("value").alias(value), F.col("code").alias(code))
    return join_lookup(d, renamed, [value]).withColumn(output, column(code)).drop(value, code)


def fit_encode_label(df: DataFrame, columns: Sequence[str], hot_rows: int = HOT_GROUP_ROWS) -> Fitted:
    """Text values to their position in sorted order; missing counts as the text `None`.

    A value that was not there when fitting gets a code of its own, the number of known values.
    """
    columns = list(columns)
    if not columns:
        return Fitted(lambda d: d)
    dictionaries = category_dictionaries(df, columns, "None", hot_rows)
    known = {r["k"]: r["n"] for r in dictionaries.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}

    def apply(d: DataFrame) -> DataFrame:
        for i, c in enumerate(columns):
            d = _coded(d, c, dictionaries.filter(F.col("k") == i), "None", c)
            d = d.withColumn(c, F.coalesce(column(c), F.lit(known.get(i, 0))))
        return d

    return Fitted(apply, {"columns": columns, "known": known})


def encode_target(df: DataFrame, target: str, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """A target that is no number becomes 0..k-1 in sorted order."""
    if isinstance(df.schema[target].dataType, T.NumericType):
        return df
    return _coded(df, target, category_dictionary(df, target, None, hot_rows), None, target)


def class_codes(df: DataFrame, target: str, output: str, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Any target as classes 0..k-1 in sorted order (numbers as numbers), as a double; rows without a target are left out."""
    df = df.filter(~is_missing(df, target))
    dictionary = category_dictionary(df, target, None, hot_rows)
    code, value = fresh(df, "code", output), fresh(df, "value", output)
    renamed = dictionary.select(F.col("value").alias(value), F.col("code").cast("double").alias(code))
    kind = renamed.schema[value].dataType
    coded = join_lookup(df.withColumn(value, column(target).cast(kind)), renamed, [value])
    return coded.withColumn(output, column(code)).drop(code, value)


def fit_encode_onehot(df: DataFrame, columns: Sequence[str], expand: bool = True, hot_rows: int = HOT_GROUP_ROWS) -> Fitted:
    """One slot `col_value` per sorted value but the first; a missing or unknown value is 0 in all.

    With `expand` the slots are 0/1 columns after all other columns, however many there are. Without, each
    column becomes one sparse vector of its name; `slots` in the parameters has the slot names either way.
    """
    columns = list(columns)
    if not columns:
        return Fitted(lambda d: d, {"slots": {}})
    dictionaries = category_dictionaries(df, columns, None, hot_rows)
    values: dict[str, list] = {c: [] for c in columns}
    for r in dictionaries.orderBy("k", "code").collect():  # the slots are features: their names belong to the driver
        values[columns[r["k"]]].append(r["value"])
    slots = {c: [f"{c}_{_shown(df, c, v)}" for v in values[c][1:]] for c in columns}

    def apply(d: DataFrame) -> DataFrame:
        return _expanded(d, values) if expand else _vectors_of(d, values, dictionaries, columns)

    return Fitted(apply, {"values": values, "slots": slots})


def _shown(df: DataFrame, name: str, value: str):
    return value == "true" if isinstance(df.schema[name].dataType, T.BooleanType) else value


def _expanded(d: DataFrame, values: dict[str, list]) -> DataFrame:
    flags = [
        F.coalesce(column(c).cast("string") == F.lit(v), F.lit(False)).cast("double").alias(f"{c}_{_shown(d, c, v)}")
        for c in values
        for v in values[c][1:]
    ]
    return d.select(*[column(c) for c in d.columns if c not in values], *flags)


def _vectors_of(d: DataFrame, values: dict[str, list], dictionaries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column as a sparse vector: the encoder leaves out its last slot, where the first, missing and unknown values go."""
    rest = [c for c in d.columns if c not in values]
    for i, c in enumerate(columns):
        last = max(len(values[c]) - 1, 0)
        code = fresh(d, "code")
        d = _coded(d, c, dictionaries.filter(F.col("k") == i), None, code)
        slot = F.when(F.coalesce(column(code), F.lit(0)) == 0, F.lit(last)).otherwise(column(code) - 1).cast("double")
        if not last:
            d = d.drop(code, c)
            continue
        sizes = d.sparkSession.createDataFrame([(float(last),)], f"`{code}` double")
        encoder = OneHotEncoder(inputCols=[code], outputCols=[f"{code}_v"], dropLast=True).fit(sizes)
        d = encoder.transform(d.withColumn(code, slot).drop(c)).withColumnRenamed(f"{code}_v", c).drop(code)
    return d.select(*[column(c) for c in rest], *[column(c) for c in columns if c in d.columns])


def fill_remaining(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Zero for everything still missing, `0` in text columns."""
    new = {}
    for name in df.columns if columns is None else columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.NumericType):
            new[name] = F.when(is_missing(df, name), F.lit(0).cast(kind)).otherwise(column(name))
        elif isinstance(kind, T.StringType):
            new[name] = F.coalesce(column(name), F.lit("0"))
        elif isinstance(kind, T.BooleanType):
            new[name] = F.coalesce(column(name), F.lit(False))
    return _replace(df, new)


# Selection and projection


def _f_value(explained: Column, left: Column) -> Column:
    """Infinite where nothing is left to explain, NULL where there was nothing to begin with."""
    return F.when((left <= 0) & (explained > 0), F.lit(float("inf"))).otherwise(ratio(explained, left))


def _slots_of(features: Sequence[str], slots: dict[str, list[str]] | None) -> list[tuple[str, int | None, str]]:
    """(column, place in its vector, name) of every feature in order."""
    out: list[tuple[str, int | None, str]] = []
    for f in features:
        out += [(f, i, name) for i, name in enumerate(slots[f])] if slots and f in slots else [(f, None, f)]
    return out


def _one_vector(df: DataFrame, features: Sequence[str], centre: dict[str, float | None], keep: Sequence[Column]) -> DataFrame:
    """All features as one vector `_v`: numbers less their mean (missing counts as the mean), vectors as they are."""
    parts = [
        column(f).alias(f"_x{i}") if _is_vector(df, f) else F.coalesce(number(df, f) - F.lit(centre.get(f) or 0.0), F.lit(0.0)).alias(f"_x{i}")
        for i, f in enumerate(features)
    ]
    inputs = [f"_x{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=inputs, outputCol="_v").transform(df.select(*keep, *parts)).drop(*inputs)


def _means(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    numbers = [f for f in features if not _is_vector(df, f)]
    return _fitted_values(df, numbers, mean=F.avg)["mean"] if numbers else {}


def _scores(df: DataFrame, names: list[str], scores: list[float | None]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(zip(range(len(names)), names, scores)), "position int, feature string, score double")


def f_classif(df: DataFrame, features: Sequence[str], label: str, slots: dict[str, list[str]] | None = None) -> DataFrame:
    """One-way analysis of variance per feature as (position, feature, score), in one grouped pass.

    Values are shifted by the feature's overall mean, so the sums of squares keep their digits. Vector columns
    count slot by slot, with the names in `slots`. Sums are kept as vectors, so any number of features is one plan.
    """
    names = [name for _, _, name in _slots_of(features, slots)]
    shifted = _one_vector(df, features, _means(df, features), [column(label).alias("_label")])
    sums = Summarizer.metrics("sum", "normL2").summary(F.col("_v"))
    per_class = shifted.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), sums.alias("s"))
    cells = F.arrays_zip(vector_to_array("s.sum").alias("s"), vector_to_array("s.normL2").alias("q"))
    rows = per_class.select("n", F.posexplode(cells).alias("position", "c")).groupBy("position").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum("c.s").alias("s"),
        F.sum(F.col("c.q") * F.col("c.q")).alias("q"),
        F.sum(F.col("c.s") * F.col("c.s") / F.col("n")).alias("b"),
    )
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    score = _f_value(ratio(between, F.col("k") - 1), ratio(within, F.col("n") - F.col("k")))
    found = {r["position"]: r["score"] for r in rows.select("position", score.alias("score")).collect()}
    return _scores(df, names, [found.get(i) for i in range(len(names))])


def f_regression(df: DataFrame, features: Sequence[str], label: str, slots: dict[str, list[str]] | None = None) -> DataFrame:
    """F of the simple regression on each feature as (position, feature, score); vector columns slot by slot.

    Sums of products with the label are weighted sums of the features; weights are shifted to be positive.
    """
    names = [name for _, _, name in _slots_of(features, slots)]
    y = number(df, label)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy"), F.min(y).alias("low")).first()
    n = row["n"]
    if not n or row["my"] is None:
        return _scores(df, names, [None] * len(names))
    weight = (F.coalesce(y, F.lit(row["my"])) - F.lit(row["low"])).alias("_w")
    shifted = _one_vector(df, features, _means(df, features), [weight])
    plain = Summarizer.metrics("sum", "normL2").summary(F.col("_v"))
    both = shifted.agg(plain.alias("p"), Summarizer.metrics("sum").summary(F.col("_v"), F.col("_w")).alias("w")).first()
    s, q, w = both["p"]["sum"].toArray(), both["p"]["normL2"].toArray() ** 2, both["w"]["sum"].toArray()
    covariance = (w - (row["my"] - row["low"]) * s) / n
    deviation = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0.0))
    scores: list[float | None] = []
    for c, d in zip(covariance, deviation):
        if not d or not row["sy"] or n < 3:
            scores.append(None)
            continue
        r2 = min((c / (d * row["sy"])) ** 2, 1.0)
        scores.append(float("inf") if r2 >= 1.0 else float(r2 / (1 - r2) * (n - 2)))
    return _scores(df, names, scores)


def select_k_best(
    df: DataFrame, features: Sequence[str], label: str, k: int | None = None, classification: bool = True,
    slots: dict[str, list[str]] | None = None,
) -> list[str]:
    """The k features (or slots of vector columns) with the largest scores in their original order; ties keep the later one."""
    scores = (f_classif if classification else f_regression)(df, list(features), label, slots).collect()
    k = min(k or min(20, len(scores)), len(scores))
    best = sorted(scores, key=lambda r: (r["score"] is not None, r["score"] or 0.0, r["position"]), reverse=True)[:k]
    return [r["feature"] for r in sorted(best, key=lambda r: r["position"])]


def slot_scores(df: DataFrame, columns: Sequence[str], label: str, classification: bool = True) -> DataFrame:
    """The score of every one-hot slot of text columns as (k, value, score), k the place of the column, from counts alone.

    A slot is 0 or 1, so counts and label sums of the rows that have its value give all sums and squares; the zeros enter in
    closed form. There is one row for each slot, and none of them reaches the driver: the number of values has no bound.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("k"), column(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    if classification:
        counts = df.select(column(label).alias("y"), F.inline(cells)).filter("value IS NOT NULL").groupBy("k", "value", "y").agg(F.count(F.lit(1)).alias("m"))
        sizes = df.groupBy(column(label).alias("y")).agg(F.count(F.lit(1)).alias("size"))
        total = sizes.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("classes")).first()
        n, classes = total["n"] or 0, total["classes"]
        placed = join_lookup(counts, sizes, ["y"])
        rows = placed.groupBy("k", "value").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m") / F.col("size")).alias("b"))
        between, within = F.col("b") - F.col("m") * F.col("m") / F.lit(n), F.col("m") - F.col("b")
        score = _f_value(ratio(between, F.lit(classes - 1)), ratio(within, F.lit(n - classes)))
    else:
        y = number(df, label)
        total = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy")).first()
        n, mean, spread = total["n"], total["my"] or 0.0, total["sy"] or 0.0
        off = F.coalesce(y - F.lit(mean), F.lit(0.0)).alias("off")
        rows = df.select(off, F.inline(cells)).filter("value IS NOT NULL").groupBy("k", "value").agg(F.count(F.lit(1)).alias("m"), F.sum("off").alias("off"))
        p = F.col("m") / F.lit(max(n, 1))
        r2 = F.least(F.pow(F.col("off") / F.lit(max(n, 1)), 2) / (p * (1 - p) * F.lit(spread * spread)), F.lit(1.0))
        score = F.when((p < 1) & F.lit(spread > 0 and n > 2), F.when(r2 >= 1, F.lit(float("inf"))).otherwise(r2 / (1 - r2) * F.lit(n - 2)))
    firsts = rows.groupBy("k").agg(F.min("value").alias("first"))
    return join_lookup(rows, firsts, ["k"]).filter("value <> first").select("k", "value", score.alias("score"))


def select_with_slots(
    df: DataFrame, numbers: Sequence[str], texts: Sequence[str], label: str, k: int | None = None, classification: bool = True
) -> list[tuple[str, str | None]]:
    """As ``select_k_best`` over numbers and the one-hot slots of text columns: (column, value) in order, no value for numbers.

    Only the chosen slots reach the driver.
    """
    k = k or 20
    scored = (f_classif if classification else f_regression)(df, list(numbers), label).collect() if numbers else []
    best = [(r["score"] is not None, r["score"] or 0.0, (-1, r["position"], "")) for r in scored]
    order = [F.desc_nulls_last("score"), F.desc("k"), F.desc("value")]
    for r in slot_scores(df, texts, label, classification).orderBy(*order).limit(k).collect():
        best.append((r["score"] is not None, r["score"] or 0.0, (r["k"], 0, r["value"])))
    chosen = sorted((at for *_, at in sorted(best, reverse=True)[:k]))
    return [(numbers[place], None) if i < 0 else (texts[i], value) for i, place, value in chosen]


def take_slots(df: DataFrame, chosen: Sequence[tuple[str, str | None]], keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The kept columns and the chosen numbers and 0/1 slots, and the names of the latter."""
    names = [c if value is None else f"{c}_{_shown(df, c, value)}" for c, value in chosen]
    flags = [
        column(c) if value is None else F.coalesce(column(c).cast("string") == F.lit(value), F.lit(False)).cast("double") for c, value in chosen
    ]
    return df.select(*[column(c) for c in keep], *[f.alias(n) for f, n in zip(flags, names)]), names


def take_features(df: DataFrame, features: Sequence[str], chosen: Sequence[str], slots: dict[str, list[str]] | None, keep: Sequence[str]) -> DataFrame:
    """The kept columns and the chosen features, slots of vectors as columns of their own."""
    wanted, columns = set(chosen), [column(c) for c in keep]
    arrays = {}
    for f, place, name in _slots_of(features, slots):
        if name in wanted:
            value = column(f) if place is None else arrays.setdefault(f, vector_to_array(column(f)))[place]
            columns.append(value.alias(name))
    return df.select(*columns)


def fit_pca(
    df: DataFrame, features: Sequence[str], n: int | None = None, keep: Sequence[str] = (), slots: dict[str, list[str]] | None = None
) -> Fitted:
    """Project on the top n components as columns `0` … `n-1`; vector columns enter slot by slot.

    Scores are centred. The sign of a component makes its largest loading positive.
    """
    features = list(features)
    width = len(_slots_of(features, slots))
    n = min(n or min(20, width), width)
    centre = _means(df, features)
    vectors = _one_vector(df, features, centre, [])
    model = PCA(k=n, inputCol="_v", outputCol="_p").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(n)]
    offset = [0.0] * n
    if any(_is_vector(df, f) for f in features):
        mean = vectors.agg(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
        offset = [float(x) for x in mean @ loadings]

    def apply(d: DataFrame) -> DataFrame:
        kept = [c for c in d.columns if c not in features]
        projected = model.transform(_one_vector(d, features, centre, [column(c) for c in kept])).withColumn("_p", vector_to_array("_p"))
        return projected.select(
            *[column(c) for c in kept], *[((F.col("_p")[j] - offset[j]) * signs[j]).alias(str(j)) for j in range(n)]
        )

    return Fitted(apply, {"variance": list(model.explainedVariance), "features": [str(j) for j in range(n)]})


# User transforms


def interaction_feature(df: DataFrame) -> DataFrame:
    """Product of the first two numeric columns as `custom_interaction`."""
    numeric = numeric_columns(df)
    if len(numeric) < 2:
        return df
    return df.withColumn("custom_interaction", column(numeric[0]) * column(numeric[1]))


def fresh(df: DataFrame, name: str, *others: str) -> str:
    """A column name that neither the frame nor `others` have."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def run_transform(df: DataFrame, transform: Transform | None) -> DataFrame:
    if not callable(transform):
        raise ValueError("Function 'transform_data' not found: pass a function of one DataFrame")
    result = transform(df)
    if not isinstance(result, DataFrame):
        raise TypeError("transform_data must return a DataFrame")
    return result


def custom_transform(
    df: DataFrame, transform: Transform | None, probe: bool = True, hidden: Sequence[str] = ()
) -> tuple[DataFrame, str | None]:
    """The transformed frame, or the untouched one and the traceback.

    Spark is lazy, so an error may show when the function builds its plan or only when the plan runs;
    with `probe` the result is therefore computed here, once, and kept in shared storage. Columns in
    `hidden` (label, keys) are no features: the function gets them as one struct, which it must pass on,
    and so cannot take them for numbers or texts.
    """
    try:
        given, aside = df, None
        if hidden:
            aside = fresh(df, "aside")
            packed = F.struct(*[column(c) for c in hidden]).alias(aside)
            given = df.select(*[column(c) for c in df.columns if c not in hidden], packed)
        result = run_transform(given, transform)
        if aside is not None:
            if aside not in result.columns:
                raise ValueError(f"transform_data must keep the column {aside}")
            columns = [c for c in result.columns if c != aside and c not in hidden]
            result = result.select(*[column(aside)[c].alias(c) for c in hidden], *[column(c) for c in columns])
        return (materialize(result) if probe else result), None
    except Exception:
        return df, traceback.format_exc()


# The whole plan


@dataclass
class Prepared:
    """Prepared frames share `features`; `error` holds a failed user transform.

    A one-hot feature is one sparse vector column; `slots` has the names of its places.
    """

    train: DataFrame
    others: list[DataFrame]
    features: list[str]
    error: str | None = None
    notes: list[str] = field(default_factory=list)
    slots: dict[str, list[str]] = field(default_factory=dict)


def fit_steps(
    df: DataFrame, steps: Sequence[dict], numeric: Sequence[str], categorical: Sequence[str], late_slots: bool = False
) -> tuple[DataFrame, list[Fitted], list[str]]:
    """Fit the steps of a plan in order. Unknown steps are left out, with a note.

    With `late_slots` one-hot columns stay texts, named under `late` in the parameters, as a selection of slots follows.
    """
    fitted, notes = [], []
    numeric, categorical = list(numeric), list(categorical)
    for step in steps:
        kind, method, scope = step.get("step", ""), step.get("method") or "", step.get("columns")
        if kind == "imputation" and (scope == "numeric" or method in ("mean", "median")):
            if method not in ("mean", "median"):
                notes.append(f"imputation '{method}' taken as median")
            one = fit_impute_numeric(df, numeric, method)
        elif kind == "imputation" and (scope == "categorical" or method == "most_frequent"):
            one = fit_impute_mode(df, categorical)
        elif kind == "scaling":
            if method not in ("standard", "minmax", "robust"):
                notes.append(f"scaling '{method}' taken as standard")
            one = fit_scale(df, numeric, method)
        elif kind == "encoding" and method == "onehot":
            one = Fitted(lambda d: d, {"late": categorical}) if late_slots else fit_encode_onehot(df, categorical, expand=False)
            categorical = []
        elif kind == "encoding":
            if method != "label":
                notes.append(f"encoding '{method}' taken as label")
            one = fit_encode_label(df, categorical)
        else:
            notes.append(f"step '{kind}' with method '{method}' left out")
            continue
        df = one.apply(df)
        fitted.append(one)
    return df, fitted, notes


def preprocess(
    train: DataFrame,
    label: str,
    plan: dict,
    classification: bool,
    keep: Sequence[str] = (),
    others: Sequence[DataFrame] = (),
) -> Prepared:
    """User transform, steps, zero fill and selection of a feature plan.

    Everything is fitted on `train` and applied to `train` and `others`. Columns in `keep`
    (row keys, split) pass through. A user transform works on the whole table, so it cannot come with `others`. Timestamps are no features and are left out. Oversampling
    follows in `tabulark.operators.sampling`.
    """
    aside = [label, *keep]
    error, notes = None, []
    frames = [train, *others]
    transform = plan.get("custom_transform")
    if transform is not None:
        if others:
            raise ValueError("a user transform sees the whole table once: apply it before the split")
        changed, error = custom_transform(train, transform, hidden=aside)
        frames = [changed]
    numeric = [c for c in numeric_columns(frames[0]) if c not in aside]
    categorical = [c for c in categorical_columns(frames[0]) if c not in aside]
    dropped = [c for c in frames[0].columns if c not in {*numeric, *categorical, *aside}]
    if dropped:
        notes.append(f"columns left out as neither numeric nor categorical: {', '.join(dropped)}")
    frames = [f.select(*[column(c) for c in [*aside, *numeric, *categorical]]) for f in frames]

    selection = plan.get("feature_selection") or {}
    method, wanted = selection.get("method") or "select_k_best", selection.get("n_features")
    by_score = bool(selection.get("apply")) and method in ("select_k_best", "SelectKBest")
    fitted_frame, fitted, step_notes = fit_steps(frames[0], plan.get("preprocessing_steps", []), numeric, categorical, by_score)
    notes += step_notes
    late = [c for one in fitted for c in one.params.get("late", [])]
    slots = {c: names for one in fitted for c, names in one.params.get("slots", {}).items() if names}
    frames = [fitted_frame] + [_apply_all(f, fitted) for f in frames[1:]]
    frames = [fill_remaining(f, [c for c in f.columns if c not in aside and c not in late]) for f in frames]
    features = [c for c in frames[0].columns if c not in aside]
    text = [c for c in features if c not in late and isinstance(frames[0].schema[c].dataType, T.StringType)]
    if text:
        raise ValueError(f"text columns need an encoding step before training: {', '.join(text)}")

    if late:
        numbers = [c for c in features if c not in late]
        picked = select_with_slots(frames[0], numbers, late, label, wanted, classification)
        taken = [take_slots(f, picked, aside) for f in frames]
        frames, features = [f for f, _ in taken], taken[0][1]
    elif by_score:
        chosen = select_k_best(frames[0], features, label, wanted, classification, slots)
        frames = [take_features(f, features, chosen, slots, aside) for f in frames]
        features, slots = chosen, {}
    elif selection.get("apply") and method in ("pca", "PCA"):
        projection = fit_pca(frames[0], features, wanted, slots=slots)
        frames = [projection.apply(f) for f in frames]
        features, slots = projection.params["features"], {}
    elif selection.get("apply"):
        notes.append(f"selection '{method}' left out")
    frames = [f.select(*[column(c) for c in aside], *[_as_double(f, c) for c in features]) for f in frames]
    return Prepared(frames[0], frames[1:], features, error, notes, slots)


def _apply_all(df: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    for one in fitted:
        df = one.apply(df)
    return df


def _as_double(df: DataFrame, name: str) -> Column:
    return column(name).cast("double").alias(name) if not _is_vector(df, name) else column(name)


def _is_vector(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "vectorudt"


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """The feature columns as one vector column."""
    renamed = [f"_f{i}" for i in range(len(features))]
    inputs = df.select(
        *[column(c) for c in df.columns if c not in features],
        *[column(c).alias(r) for c, r in zip(features, renamed)],
    )
    return VectorAssembler(inputCols=renamed, outputCol=output).transform(inputs).drop(*renamed)
