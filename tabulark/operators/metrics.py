"""Exact metrics over distributed predictions. Only counts and sums are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.config import HOT_GROUP_ROWS
from tabulark.functions.columns import column, ratio
from tabulark.operators.ordered import running_sums

CLASSIFICATION = ("accuracy", "precision", "recall", "f1")
# Long names of regression metrics and what they are reported as.
REGRESSION_NAMES = {
    "mse": "mse",
    "mean_squared_error": "mse",
    "rmse": "rmse",
    "root_mean_squared_error": "rmse",
    "mae": "mae",
    "mean_absolute_error": "mae",
    "r2": "r2",
}


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(
        column(label).cast("double").alias("label"), column(prediction).cast("double").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(
    df: DataFrame,
    label: str,
    prediction: str,
    metrics: Sequence[str] = CLASSIFICATION,
    average: str = "auto",
) -> DataFrame:
    """One row with the requested ones of accuracy, precision, recall and f1.

    With `average="auto"` two label values mean the scores of class 1, any other number the
    scores of all classes weighted by their rows; `"weighted"` always weights. 0 where a class is never predicted.
    """
    table = confusion(df, label, prediction)
    nothing = F.lit(0).cast("bigint")
    hits = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(nothing)

    def side(name, support, predicted, hits):
        return F.struct(
            F.col(name).alias("class"),
            support.alias("support"),
            predicted.alias("predicted"),
            hits.alias("hits"),
        )

    sides = F.array(side("label", F.col("n"), nothing, hits), side("prediction", nothing, F.col("n"), nothing))
    per_class = table.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    precision = F.coalesce(ratio(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")), F.lit(0.0))
    scored = per_class.select("class", "support", "hits", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))

    def averaged(name: str) -> Column:
        weighted = ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))
        if average == "weighted":
            return weighted
        binary = F.coalesce(F.max(F.when(F.col("class") == 1, F.col(name))), F.lit(0.0))
        return F.when(F.count_if(F.col("support") > 0) == 2, binary).otherwise(weighted)

    columns = {
        "accuracy": ratio(F.sum("hits"), F.sum("support")),
        **{name: averaged(name) for name in ("precision", "recall", "f1")},
    }
    return scored.agg(*[columns[m].alias(m) for m in metrics if m in columns])


def _areas(counts: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame:
    """Area per group from (score, pos, neg) rows: positives above negatives, ties count half."""
    running = running_sums(counts, by, [F.col("score")], {"below": F.col("neg")}, hot_rows)
    won = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return running.groupBy(*[column(c) for c in by]).agg(ratio(won, pairs).alias("roc_auc"), F.sum("pos").alias("pos"))


def roc_auc(df: DataFrame, label: str, score: str | Column, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Area under the ROC curve of a score for label 1; NULL with one class only.

    Rows with equal scores become one row before anything is ordered.
    """
    score = column(score) if isinstance(score, str) else score
    counts = df.groupBy(score.cast("double").alias("score")).agg(
        F.count_if(column(label) == 1).alias("pos"), F.count_if(column(label) != 1).alias("neg")
    )
    return _areas(counts, [], hot_rows).select("roc_auc")


def roc_auc_ovr(df: DataFrame, label: str, scores: str, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """One-vs-rest areas weighted by the rows of each class; `scores[c]` belongs to class c."""
    long = df.select(column(label).cast("int").alias("label"), F.posexplode(column(scores)).alias("class", "score"))
    counts = long.groupBy("class", F.col("score").cast("double").alias("score")).agg(
        F.count_if(F.col("label") == F.col("class")).alias("pos"),
        F.count_if(F.col("label") != F.col("class")).alias("neg"),
    )
    areas = _areas(counts, ["class"], hot_rows)
    return areas.agg(ratio(F.sum(F.col("roc_auc") * F.col("pos")), F.sum("pos")).alias("roc_auc"))


def regression_metrics(
    df: DataFrame, label: str, prediction: str, metrics: Sequence[str] = ("mse", "rmse", "mae", "r2")
) -> DataFrame:
    """One row with the requested error measures; unknown names are skipped."""
    y, error = column(label).cast("double"), column(label).cast("double") - column(prediction).cast("double")
    squared = F.avg(error * error)
    spread = F.var_pop(y)
    columns = {
        "mse": squared,
        "rmse": F.sqrt(squared),
        "mae": F.avg(F.abs(error)),
        "r2": F.when(spread == 0, F.when(squared == 0, 1.0).otherwise(0.0)).otherwise(1 - ratio(squared, spread)),
    }
    names = dict.fromkeys(REGRESSION_NAMES[m] for m in metrics if m in REGRESSION_NAMES)
    return df.agg(*[columns[n].alias(n) for n in names])


def score_predictions(
    predictions: DataFrame,
    problem_type: str,
    metrics: Sequence[str],
    label: str = "label",
    prediction: str = "prediction",
    scores: str = "scores",
    average: str = "auto",
) -> tuple[dict[str, float | None], str | None]:
    """The requested metrics as a dictionary, and the message of those that failed.

    A metric that cannot be computed is None, never 0. Predictions are kept while they are
    scored, because several jobs read them.
    """
    columns = [c for c in (label, prediction, scores) if c in predictions.columns]
    kept = predictions.select(*[column(c) for c in columns]).persist()
    try:
        if problem_type == "classification":
            values = _class_scores(kept, metrics, label, prediction, scores, average)
        else:
            wanted = [m for m in metrics if m in REGRESSION_NAMES]
            values = regression_metrics(kept, label, prediction, wanted).first().asDict() if wanted else {}
    finally:
        kept.unpersist()
    failed = [m for m, v in values.items() if v is None]
    return values, f"not defined for these predictions: {', '.join(failed)}" if failed else None


def _class_scores(kept, metrics, label, prediction, scores, average) -> dict[str, float | None]:
    values: dict[str, float | None] = {}
    plain = [m for m in metrics if m in CLASSIFICATION]
    if plain:
        values.update(classification_metrics(kept, label, prediction, plain, average).first().asDict())
    if "roc_auc" in metrics:
        values["roc_auc"] = None
        if scores in kept.columns:
            width = kept.select(F.size(column(scores)).alias("n")).first()
            if width is not None and width["n"] > 2:
                values["roc_auc"] = roc_auc_ovr(kept, label, scores).first()[0]
            else:
                values["roc_auc"] = roc_auc(kept, label, column(scores)[1]).first()[0]
    return {m: values[m] for m in metrics if m in values}
