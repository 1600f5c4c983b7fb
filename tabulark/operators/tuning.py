"""Training candidates, cross-validation and random search."""

from __future__ import annotations

import logging
import math
import random
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.config import CV_FOLDS, SEED, TUNING_TRIALS
from tabulark.operators.metrics import score_predictions
from tabulark.operators.models import fits_at_once, make_model
from tabulark.operators.ranking import lower_is_better
from tabulark.operators.split import kfold
from tabulark.sources.runlog import RUNS, complete_runs, run_id

logger = logging.getLogger(__name__)

# Search ranges. ("log"|"float"|"int", low, high), a tuple of choices, or a constant.
SEARCH_SPACES: dict[str, dict[str, object]] = {
    "logistic_regression": {"C": ("log", 0.001, 100.0), "max_iter": 1000},
    "random_forest": {
        "n_estimators": ("int", 50, 500),
        "max_depth": ("int", 3, 20),
        "min_samples_split": ("int", 2, 20),
        "min_samples_leaf": ("int", 1, 10),
        "max_features": ("choice", "sqrt", "log2"),
    },
    "gradient_boosting": {
        "n_estimators": ("int", 50, 500),
        "learning_rate": ("log", 0.01, 0.3),
        "max_depth": ("int", 3, 10),
        "subsample": ("float", 0.6, 1.0),
        "min_samples_split": ("int", 2, 20),
    },
    "xgboost": {
        "n_estimators": ("int", 50, 500),
        "learning_rate": ("log", 0.01, 0.3),
        "max_depth": ("int", 3, 10),
        "subsample": ("float", 0.6, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
        "reg_alpha": ("log", 1e-8, 10.0),
        "reg_lambda": ("log", 1e-8, 10.0),
    },
    "svm": {
        "C": ("log", 0.01, 100.0),
        "kernel": ("choice", "rbf", "poly"),
        "gamma": ("choice", "scale", "auto"),
    },
    "knn": {
        "n_neighbors": ("int", 3, 30),
        "weights": ("choice", "uniform", "distance"),
        "metric": ("choice", "euclidean", "manhattan", "minkowski"),
    },
}

# Metrics that cross-validation knows; others fall back to accuracy.
_SCORED = ("f1", "roc_auc", "accuracy", "precision", "recall", "r2", "mse", "rmse", "mae")


def search_space(name: str, n_trials: int, seed: int = SEED) -> list[dict]:
    """Parameter sets drawn from the ranges of a model, the same for the same seed."""
    generator = random.Random(f"{name}:{seed}")

    def draw(spec):
        if not isinstance(spec, tuple):
            return spec
        kind, *bounds = spec
        if kind == "choice":
            return generator.choice(bounds)
        low, high = bounds
        if kind == "int":
            return generator.randint(low, high)
        if kind == "log":
            return math.exp(generator.uniform(math.log(low), math.log(high)))
        return generator.uniform(low, high)

    ranges = SEARCH_SPACES.get(name, {})
    return [{p: draw(s) for p, s in ranges.items()} for _ in range(n_trials)]


def scoring_metric(metric: str, problem_type: str) -> str:
    if metric == "roc_auc" and problem_type != "classification":
        return "r2"
    return metric if metric in _SCORED else "accuracy"


def cross_val_score(
    train: DataFrame,
    name: str,
    problem_type: str,
    params: dict | None,
    metric: str,
    key: str,
    folds: int = CV_FOLDS,
    fold_column: str | None = None,
    parallelism: int = 1,
) -> float:
    """Mean metric over the folds, ``parallelism`` of them at once; class scores are weighted by rows per class.

    Raises what a model raises, so that the caller decides what a failed trial is worth.
    """
    own = fold_column is None
    if own:
        stratify = "label" if problem_type == "classification" else None
        # Every fold reads the frame twice, so the folded one is kept.
        fold_column, train = "fold", kfold(train, [key], folds, stratify=stratify).persist()
    try:
        classes = int(train.agg(F.max("label")).first()[0]) + 1 if problem_type == "classification" else None
        model, metric = make_model(name, problem_type, params), scoring_metric(metric, problem_type)

        def score(fold: int) -> float:
            predict = model.fit(train.filter(F.col(fold_column) != fold), classes, key)
            held_out = predict(train.filter(F.col(fold_column) == fold))
            found, _ = score_predictions(held_out, problem_type, [metric], average="weighted")
            if found.get(metric) is None:
                raise ValueError(f"{metric} is not defined in fold {fold}")
            return found[metric]

        if parallelism > 1:
            with ThreadPool(min(parallelism, folds)) as pool:
                values = pool.map(score, range(folds), chunksize=1)
        else:
            values = [score(fold) for fold in range(folds)]
        return sum(values) / len(values)
    finally:
        if own:
            train.unpersist()


def _record(name, params, metrics, iteration, stage, seq, error=None) -> dict:
    return {
        "model_name": name,
        "parameters": {k: str(v) for k, v in params.items() if isinstance(v, (str, int, float, bool, type(None)))},
        "metrics": {k: float(v) for k, v in metrics.items() if v is not None},
        "iteration": iteration,
        "stage": stage,
        "seq": seq,
        "error": error,
    }


def runs_frame(spark: SparkSession, records: Sequence[dict], experiment_id: str) -> DataFrame:
    """Run records as a table with their ids."""
    fields = [f for f in RUNS if f.name in ("model_name", "stage", "iteration", "seq", "parameters", "metrics", "error")]
    rows = [tuple(r.get(f.name) for f in fields) for r in records]
    frame = spark.createDataFrame(rows, T.StructType(fields)).withColumn("experiment_id", F.lit(experiment_id))
    identity = run_id(F.col("experiment_id"), F.col("model_name"), F.col("stage"), F.col("iteration"))
    return complete_runs(frame.withColumn("run_id", identity).withColumn("created_at", F.current_timestamp()))


def train_candidates(
    train: DataFrame,
    test: DataFrame,
    models: Sequence[str],
    problem_type: str,
    metrics: Sequence[str],
    key: str,
    iteration: int = 0,
    params: dict[str, dict] | None = None,
    first_seq: int = 0,
    classes: int | None = None,
) -> list[dict]:
    """One record per candidate. A model that fails is recorded with its error and the
    others go on."""
    stage = "initial" if iteration == 0 else "replan"
    records = []
    for offset, name in enumerate(models):
        chosen = (params or {}).get(name, {})
        try:
            model = make_model(name, problem_type, chosen)
            predict = model.fit(train, classes, key)
            found, note = score_predictions(predict(test), problem_type, metrics)
            if note:
                logger.warning("%s: %s", name, note)
            records.append(_record(name, model.settings, found, iteration, stage, first_seq + offset))
        except Exception as problem:  # noqa: BLE001 - the record carries it
            logger.error("training %s failed: %s", name, problem)
            records.append(_record(name, {}, {}, iteration, stage, first_seq + offset, str(problem)))
    return records


def tune(
    train: DataFrame,
    test: DataFrame,
    name: str,
    problem_type: str,
    primary_metric: str,
    metrics: Sequence[str],
    key: str,
    iteration: int = 0,
    n_trials: int = TUNING_TRIALS,
    folds: int = CV_FOLDS,
    seed: int = SEED,
    seq: int = 0,
    parallelism: int = 2,
    limits: dict | None = None,
    classes: int | None = None,
) -> dict:
    """Random search by cross-validation, refit on all training rows, scored on the test rows.

    `limits` overrides drawn parameters. A failed trial counts as the worst. Raises if
    every trial failed. Folds of a trial run side by side where a linear fit on a small table leaves cores free.
    """
    scoring = scoring_metric(primary_metric, problem_type)
    lower = lower_is_better(scoring)
    worst = math.inf if lower else -math.inf
    stratify = "label" if problem_type == "classification" else None
    folded = kfold(train, [key], folds, stratify=stratify).persist()
    trials = [{**p, **(limits or {})} for p in search_space(name, n_trials, seed)]
    at_once = fits_at_once(train, name) // max(1, min(parallelism, n_trials))

    def score(params: dict) -> float:
        try:
            return cross_val_score(folded, name, problem_type, params, scoring, key, folds, "fold", at_once)
        except Exception as problem:  # noqa: BLE001 - a failed trial is the worst one
            logger.info("trial %s failed: %s", params, problem)
            return worst

    try:
        pool = ThreadPool(max(1, parallelism))
        try:
            values = pool.map(score, trials)
        finally:
            pool.close()
    finally:
        folded.unpersist()
    best = (min if lower else max)(range(len(trials)), key=lambda i: values[i])
    if math.isinf(values[best]):
        raise RuntimeError(f"every tuning trial of {name} failed")
    model = make_model(name, problem_type, trials[best])
    predict = model.fit(train, classes, key)
    found, _ = score_predictions(predict(test), problem_type, metrics)
    record = _record(name, model.settings, found, iteration, "hpo", seq)
    record["parameters"].update({"n_trials": str(n_trials), "best_trial_value": str(values[best])})
    return record
