"""Candidate models by name, on Spark's own learners.

A candidate is fitted on a frame with `label` and a vector column `features`, and returns a
function that adds `prediction` and, for classes, `scores` (one number per class).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.config import SEED
from tabulark.operators import boosting
from tabulark.operators.ann import approximate_knn_join
from tabulark.operators.knn import knn_classify, knn_join, knn_regress

Predict = Callable[[DataFrame], DataFrame]

MODELS = ("logistic_regression", "random_forest", "gradient_boosting", "xgboost", "svm", "knn")

_DEPTH = 10  # where the parameter says unlimited
_MAX_DEPTH = 30  # the deepest tree Spark grows
_NORMAL_EQUATION_COLUMNS = 4096
_TASK_BYTES = 4 << 20  # of feature numbers that an iteration reads in a task


_FOREST = {"n_estimators": 100, "max_depth": _DEPTH, "min_samples_split": 2, "min_samples_leaf": 1, "random_state": SEED}
_BOOSTED = {**_FOREST, "subsample": 1.0}

# What a parameter is where nobody sets it; by model, and for the linear and forest models by problem.
_DEFAULTS = {
    "logistic_regression": {"classification": {"C": 1.0, "max_iter": 1000}, "regression": {"alpha": 1.0, "max_iter": 1000}},
    "random_forest": {"classification": {**_FOREST, "max_features": "sqrt"}, "regression": {**_FOREST, "max_features": "all"}},
    "gradient_boosting": {
        "classification": {**_BOOSTED, "max_depth": 3, "learning_rate": 0.1, "multi_class": "one_vs_rest"},
        "regression": {**_BOOSTED, "max_depth": 3, "learning_rate": 0.1},
    },
    "xgboost": {
        "n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0,
        "reg_alpha": 0.0, "reg_lambda": 1.0, "gamma": 0.0, "min_child_weight": 1.0, "max_bin": boosting.MAX_BINS, "random_state": SEED,
    },
    "svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "max_iter": 100, "random_features": 100},
    "knn": {"n_neighbors": 5, "weights": "uniform", "metric": "minkowski"},
}


@dataclass(frozen=True)
class Candidate:
    name: str
    problem_type: str
    params: dict = field(default_factory=dict)

    @property
    def settings(self) -> dict:
        """All parameters that the fit uses, defaults included; unlimited depth is the depth that stands for it."""
        defaults = _DEFAULTS[self.name]
        found = {**defaults.get(self.problem_type, defaults), **self.params}
        if found.get("max_depth", 0) is None:
            found["max_depth"] = _DEPTH
        if found.get("max_depth", 0) > _MAX_DEPTH:
            raise ValueError(f"max_depth is at most {_MAX_DEPTH}")
        return found

    def fit(self, train: DataFrame, classes: int | None = None, key: str | None = None) -> Predict:
        """Fit on `train`; `classes` is the number of label values 0..classes-1."""
        if self.problem_type == "classification":
            if classes is None:
                classes = int(train.agg(F.max("label")).first()[0]) + 1
            classes = max(classes, 2)
        return _FITS[self.name](self, train, classes, key)


def available_models(problem_type: str = "classification") -> list[str]:
    return list(MODELS)


def make_model(name: str, problem_type: str = "classification", params: dict | None = None) -> Candidate:
    if name not in MODELS:
        raise ValueError(f"Unknown model '{name}' for {problem_type}. Available: {available_models(problem_type)}")
    return Candidate(name, problem_type, dict(params or {}))


def _rows(train: DataFrame) -> int:
    return max(train.count(), 1)


def _tasks(train: DataFrame, rows: int) -> int:
    """How many tasks the feature numbers fill."""
    first = train.select("features").first()
    return max(1, -(-rows * len(first[0]) * 8 // _TASK_BYTES)) if first else 1


def _dense(train: DataFrame, rows: int) -> DataFrame:
    """The rows in no more tasks than they fill: an iteration over a small table costs its tasks, not its rows."""
    tasks = _tasks(train, rows)
    return train.coalesce(tasks) if tasks < train.rdd.getNumPartitions() else train


def fits_at_once(train: DataFrame, name: str) -> int:
    """How many fits of a model fill the cores; models that work on all cores take one."""
    if name not in ("logistic_regression", "svm"):
        return 1
    return max(1, train.sparkSession.sparkContext.defaultParallelism // _tasks(train, _rows(train)))


def _scored(raw: str) -> Predict:
    """Scores from a vector of the model, and only the columns a caller needs."""

    def shape(df: DataFrame) -> DataFrame:
        scores = vector_to_array(raw).alias("scores")
        kept = [c for c in df.columns if c not in ("rawPrediction", "probability")]
        return df.select(*kept, scores)

    return shape


def _fit_linear(model: Candidate, train: DataFrame, classes: int | None, key: str | None) -> Predict:
    p = model.settings
    if model.problem_type == "classification":
        rows = _rows(train)
        fitted = LogisticRegression(
            regParam=1.0 / (p["C"] * rows),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=int(p["max_iter"]),
        ).fit(_dense(train, rows))
        return lambda df: _scored("probability")(fitted.transform(df))
    # The penalty is applied to labels divided by their deviation, so it is scaled back here.
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("pop"), F.stddev_samp("label").alias("samp")).first()
    normal = len(train.select("features").first()[0]) <= _NORMAL_EQUATION_COLUMNS
    spread = row["pop"] if normal else row["samp"]
    fitted = LinearRegression(
        regParam=p["alpha"] * (spread or 0.0) / max(row["n"], 1),
        elasticNetParam=0.0,
        standardization=False,
        solver="normal" if normal else "l-bfgs",
        maxIter=int(p["max_iter"]),
    ).fit(train)
    return fitted.transform


def tree_params(params: dict) -> dict:
    leaf = max(int(params["min_samples_leaf"]), math.ceil(params["min_samples_split"] / 2))
    return {"maxDepth": int(params["max_depth"]), "minInstancesPerNode": leaf, "seed": int(params["random_state"])}


def _fit_forest(model: Candidate, train: DataFrame, classes: int | None, key: str | None) -> Predict:
    p = model.settings
    settings = {**tree_params(p), "numTrees": int(p["n_estimators"]), "featureSubsetStrategy": p["max_features"]}
    if model.problem_type == "classification":
        fitted = RandomForestClassifier(**settings).fit(train)
        return lambda df: _scored("probability")(fitted.transform(df))
    return RandomForestRegressor(**settings).fit(train).transform


def boosting_params(params: dict) -> dict:
    return {
        **tree_params(params),
        "maxIter": int(params["n_estimators"]),
        "stepSize": float(params["learning_rate"]),
        "subsamplingRate": float(params["subsample"]),
    }


def _fit_boosting(model: Candidate, train: DataFrame, classes: int | None, key: str | None) -> Predict:
    """Spark's boosting; with `multi_class="softmax"` more classes get a tree each per round, on the multinomial loss."""
    p = model.settings
    if model.problem_type != "classification":
        return GBTRegressor(**boosting_params(p)).fit(train).transform
    if classes == 2:
        fitted = GBTClassifier(**boosting_params(p)).fit(train)
        return lambda df: _scored("probability")(fitted.transform(df))
    if p["multi_class"] not in ("one_vs_rest", "softmax"):
        raise ValueError("multi_class is one_vs_rest or softmax")
    if p["multi_class"] == "one_vs_rest":
        fitted = OneVsRest(classifier=GBTClassifier(**boosting_params(p))).fit(train)
        return lambda df: _scored("rawPrediction")(fitted.transform(df))
    rule = boosting.Rule(
        "softmax", int(p["n_estimators"]), float(p["learning_rate"]), int(p["max_depth"]), reg_lambda=0.0,
        min_leaf=int(p["min_samples_leaf"]), min_split=int(p["min_samples_split"]),
        subsample=float(p["subsample"]), seed=int(p["random_state"]), by_count=True, prior=True,
    )
    return boosting.fit(train, rule, classes, key).transform


def _fit_xgboost(model: Candidate, train: DataFrame, classes: int | None, key: str | None) -> Predict:
    """Second-order boosting: penalties in splits and leaves, features drawn per tree; numbers start at their mean, classes at 0."""
    p = model.settings
    loss = "squared" if model.problem_type != "classification" else "logistic" if classes == 2 else "softmax"
    rule = boosting.Rule(
        loss, int(p["n_estimators"]), float(p["learning_rate"]), int(p["max_depth"]),
        reg_lambda=float(p["reg_lambda"]), reg_alpha=float(p["reg_alpha"]), gamma=float(p["gamma"]),
        min_child_weight=float(p["min_child_weight"]), subsample=float(p["subsample"]), colsample=float(p["colsample_bytree"]),
        bins=min(int(p["max_bin"]), boosting.MAX_BINS), seed=int(p["random_state"]),
    )
    return boosting.fit(train, rule, classes or 2, key).transform


def kernel_features(train: DataFrame, kernel: str, gamma: str | float, size: int = 100) -> Predict:
    """Random features whose products approximate an RBF or cubic kernel.

    RBF: cosines of random projections. Cubic: products of three random sign projections.
    The projection is width × size numbers, drawn from the fixed seed.
    """
    width = len(train.select("features").first()[0])
    if gamma == "auto":
        scale = 1.0 / width
    elif gamma == "scale":
        found = train.agg(Summarizer.metrics("mean", "normL2", "count").summary(F.col("features")).alias("s")).first()["s"]
        mean = float(found["mean"].toArray().mean()) if found["count"] else 0.0
        square = float((found["normL2"].toArray() ** 2).sum()) / max(found["count"] * width, 1)
        cells = max(square - mean * mean, 0.0)
        scale = 1.0 / (width * cells) if cells else 1.0
    else:
        scale = float(gamma)
    random = np.random.default_rng(SEED)
    if kernel == "poly":
        signs = random.choice([-1.0, 1.0], size=(3, width, size)) * math.sqrt(scale)

        def lift(matrix):
            return np.prod([matrix @ s for s in signs], axis=0) / math.sqrt(size)
    else:
        weights = random.normal(0.0, math.sqrt(2.0 * scale), size=(width, size))
        phases = random.uniform(0.0, 2.0 * math.pi, size)

        def lift(matrix):
            return np.cos(matrix @ weights + phases) * math.sqrt(2.0 / size)

    @F.pandas_udf("array<double>")
    def lifted(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(lift(np.stack(vectors.to_numpy()))))

    return lambda df: df.withColumn("features", array_to_vector(lifted(vector_to_array("features"))))


def _fit_svm(model: Candidate, train: DataFrame, classes: int | None, key: str | None) -> Predict:
    p = model.settings
    lift = kernel_features(train, p["kernel"], p["gamma"], int(p["random_features"]))
    rows = _rows(train)
    penalty = 1.0 / (p["C"] * rows)
    iterations = int(p["max_iter"])  # the robust loss needs about as many as the default
    lifted = _dense(lift(train), rows).persist()
    try:
        if model.problem_type != "classification":
            learner = LinearRegression(loss="huber", regParam=penalty, standardization=False, maxIter=iterations)
            fitted = learner.fit(lifted)
            return lambda df: fitted.transform(lift(df))
        learner = LinearSVC(regParam=penalty, standardization=False, maxIter=iterations)
        if classes == 2:
            fitted = learner.fit(lifted)
        else:
            fitted = OneVsRest(classifier=learner).fit(lifted)
        squash = lambda df: df.withColumn(
            "scores", F.transform("scores", lambda s: 1.0 / (1.0 + F.exp(-s)))
        )
        return lambda df: squash(_scored("rawPrediction")(fitted.transform(lift(df))))
    finally:
        lifted.unpersist()


def _fit_knn(model: Candidate, train: DataFrame, classes: int | None, key: str | None) -> Predict:
    if key is None:
        raise ValueError("knn needs the name of a unique key column")
    p = model.settings
    k, weights = int(p["n_neighbors"]), p["weights"]

    def vectors(df: DataFrame) -> DataFrame:
        return df.withColumn("_x", vector_to_array("features"))

    def predict(df: DataFrame) -> DataFrame:
        if p.get("search", "exact") == "approximate":
            if p["metric"] not in ("minkowski", "euclidean"):
                raise ValueError("approximate search knows Euclidean distances only")
            found = approximate_knn_join(vectors(df), vectors(train), k, key, key, "_x", "_x", p.get("share", 0.1), carry="label")
        else:
            found = knn_join(vectors(df), vectors(train), k, key, key, "_x", "_x", metric=p["metric"], carry="label")
        if model.problem_type == "classification":
            voted = knn_classify(found, "label", classes, weights)
        else:
            voted = knn_regress(found, "label", weights)
        return df.join(voted.withColumnRenamed("query_key", key), key)

    return predict


_FITS = {
    "logistic_regression": _fit_linear,
    "random_forest": _fit_forest,
    "gradient_boosting": _fit_boosting,
    "xgboost": _fit_xgboost,
    "svm": _fit_svm,
    "knn": _fit_knn,
}
