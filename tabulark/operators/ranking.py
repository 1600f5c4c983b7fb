"""Ranking, best runs and convergence over a table of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulark.config import CONVERGENCE_THRESHOLD, HOT_GROUP_ROWS, MAX_ITERATIONS
from tabulark.operators.ordered import numbered

# Metrics for which less is better.
LOWER_IS_BETTER = ("mse", "rmse", "mae")


def lower_is_better(metric: str) -> bool:
    return metric in LOWER_IS_BETTER


def metric_value(metric: str) -> Column:
    """The metric of a run; NULL if absent or NaN."""
    return F.nanvl(F.try_element_at(F.col("metrics"), F.lit(metric)), F.lit(None).cast("double"))


def loss(metric: str, value: Column) -> Column:
    """The metric turned so that less is better."""
    return value if lower_is_better(metric) else -value


def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs without an error that have metrics."""
    return runs.filter(F.col("error").isNull() & (F.size("metrics") > 0))


def _order(metric: str) -> list[Column]:
    """Best first, runs without the metric last, ties in run order."""
    return [loss(metric, metric_value(metric)).asc_nulls_last(), F.col("seq").asc()]


def rank_runs(runs: DataFrame, metric: str, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Valid runs with rank 1, 2, 3, … per experiment and the metric's value."""
    return numbered(valid_runs(runs), ["experiment_id"], _order(metric), "rank", hot_rows).withColumn(
        "primary_metric_value", metric_value(metric)
    )


def top_rankings(runs: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """The first n rankings per experiment.

    Spark cuts each partition to its own first n per experiment before the shuffle, so a
    hot experiment sends few rows.
    """
    window = Window.partitionBy("experiment_id").orderBy(*_order(metric))
    return (
        valid_runs(runs)
        .withColumn("rank", F.row_number().over(window).cast("bigint"))
        .filter(F.col("rank") <= n)
        .withColumn("primary_metric_value", metric_value(metric))
    )


def _best(runs: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    row = F.struct(*[F.col(c) for c in runs.columns])
    return (
        runs.groupBy(*by).agg(F.min_by(row, order).alias("best")).select("best.*")
    )


def _best_order(metric: str) -> Column:
    value = loss(metric, metric_value(metric))
    return F.struct(value.isNull().alias("absent"), value.alias("value"), F.col("seq"))


def best_run(runs: DataFrame, metric: str) -> DataFrame:
    """The rank 1 run of every experiment with all its fields, by partial aggregation."""
    return _best(valid_runs(runs), ["experiment_id"], _best_order(metric))


def best_run_by(runs: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """The run with the largest (or smallest) value of any one metric per experiment."""
    value = metric_value(metric)
    value = value if ascending else -value
    order = F.struct(value.isNull().alias("absent"), value.alias("value"), F.col("seq"))
    return _best(runs, ["experiment_id"], order)


def hpo_candidate(runs: DataFrame, metric: str) -> DataFrame:
    """The best error-free run of every iteration, the one worth tuning."""
    return _best(runs.filter(F.col("error").isNull()), ["experiment_id", "iteration"], _best_order(metric))


def convergence(
    runs: DataFrame,
    metric: str,
    threshold: float = CONVERGENCE_THRESHOLD,
    max_iterations: int = MAX_ITERATIONS,
) -> DataFrame:
    """Per experiment and iteration: best so far, best before, and whether to stop.

    The window runs over one row per iteration, and iterations are few by their budget.
    """
    sign = F.lit(1.0 if lower_is_better(metric) else -1.0)
    value = F.when(F.col("error").isNull(), loss(metric, metric_value(metric)))
    ordered = Window.partitionBy("experiment_id").orderBy("iteration")
    best = runs.groupBy("experiment_id", "iteration").agg(F.min(value).alias("_best"))
    so_far = F.min("_best").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    before = F.min("_best").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    compared = best.select(
        "experiment_id",
        "iteration",
        (so_far * sign).alias("best_value"),
        (before * sign).alias("previous_best"),
    ).withColumn("improvement", F.abs(F.col("best_value") - F.col("previous_best")))
    converged = (F.col("iteration") > 0) & (F.col("improvement") < threshold)
    out_of_budget = F.col("iteration") >= max_iterations
    return compared.withColumn("converged", F.coalesce(converged, F.lit(False)) & ~out_of_budget).withColumn(
        "should_stop", F.col("converged") | out_of_budget
    )


def run_progress(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """The furthest step of every experiment from its status and the stages of its runs."""
    seen = runs.groupBy("experiment_id").agg(
        F.bool_or(F.col("stage") == "hpo").alias("tuned"),
        F.bool_or((F.col("stage") == "replan") | (F.col("iteration") > 0)).alias("replanned"),
    )
    running = (
        F.when(F.col("tuned").isNull() & F.col("replanned").isNull(), "planner")
        .when(F.col("tuned"), "hpo")
        .when(F.col("replanned"), "replan")
        .otherwise("eval")
    )
    step = (
        F.when(F.col("status") == "pending", "planner")
        .when(F.col("status") == "completed", "report")
        .when(F.col("status") == "failed", "runner")
        .when(F.col("status") == "running", running)
    )
    return experiments.join(seen, "experiment_id", "left").select("experiment_id", "status", step.alias("step"))
