"""The experiment loop: a plain driver function over the distributed operators."""

from __future__ import annotations

import json
import logging
import time
import traceback
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.config import CV_FOLDS, MAX_ITERATIONS, SEED, TEST_FRACTION, TUNING_TRIALS
from tabulark.functions.columns import column, is_missing
from tabulark.operators.preprocess import assemble, class_codes, custom_transform, fresh, preprocess
from tabulark.operators.profile import profile, profile_text
from tabulark.operators.ranking import best_run, convergence, hpo_candidate, rank_runs
from tabulark.operators.sampling import oversample_random, oversample_smote
from tabulark.operators.split import train_test_split
from tabulark.operators.tuning import runs_frame, train_candidates, tune
from tabulark.plans.goals import (
    complete_feature_plan,
    default_feature_plan,
    default_plan,
    merge_replan,
    plan_from_goal,
    resolve_target,
    tune_once,
    validate_goals,
)
from tabulark.plans.report import report_table
from tabulark.sources.datasets import ROW_KEY, Catalog, load_dataset, with_row_key
from tabulark.session import materialize
from tabulark.sources.runlog import EXPERIMENTS, append_runs, append_traces, complete_traces

logger = logging.getLogger(__name__)


@dataclass
class Outcome:
    """What an experiment left behind. `runs` and `rankings` are small tables."""

    experiment_id: str
    status: str
    iteration: int = 0
    plan: dict = field(default_factory=dict)
    feature_plan: dict = field(default_factory=dict)
    summary: str | None = None
    best_model: dict | None = None
    report: str | None = None
    runs: DataFrame | None = None
    rankings: DataFrame | None = None
    notes: list[str] = field(default_factory=list)
    steps: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def step(self, name: str):
        """Notes how long a step took, also if it fails."""
        start = time.perf_counter()
        try:
            yield
        finally:
            self.steps.append((name, time.perf_counter() - start))


@dataclass
class PreparedData:
    train: DataFrame
    test: DataFrame
    classes: int | None
    error: str | None
    notes: list[str]

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


#: Names that the preparation works with; features of these names are renamed.
_RESERVED = ("label", ROW_KEY, "split", "draw", "features", "fold")


def _source(df: DataFrame, target: str, key: str, classification: bool) -> DataFrame:
    """Row key, label and features under safe names; rows without a target are left out.

    A class label is 0..k-1 in sorted order of the target.
    """
    features = [c for c in df.columns if c not in (target, key)]
    taken = {c.lower() for c in df.columns} | set(_RESERVED)
    renamed = {}
    for c in features:
        name = c
        while name.lower() in _RESERVED or (name != c and name.lower() in taken):
            name = f"{name}_feature"
        taken.add(name.lower())
        renamed[c] = name
    aside, goal = fresh(df, "_key"), fresh(df, "_target")
    plain = df.select(column(key).cast("string").alias(aside), column(target).alias(goal), *[column(c).alias(renamed[c]) for c in features])
    if classification:
        labelled = class_codes(plain, goal, "label")
    else:
        labelled = plain.filter(~is_missing(plain, goal)).withColumn("label", column(goal).cast("double"))
    return labelled.select(column(aside).alias(ROW_KEY), "label", *[column(c) for c in renamed.values()])


def prepare_data(
    df: DataFrame,
    target: str,
    key: str,
    feature_plan: dict,
    problem_type: str,
    fit_scope: str = "train",
    test_fraction: float = TEST_FRACTION,
    seed: int = SEED,
    keep_source: bool = True,
) -> PreparedData:
    """Split, prepared and persisted frames with `row_key`, `label` and `features`.

    A user transform sees the features of the whole table, once. Classes are split in proportion, exactly.
    With `fit_scope="train"` features are fitted and classes balanced on the training rows only;
    `"all"` does both before the split. Every fit reads the source once, so it is kept until the
    prepared frames are there; pass `keep_source=False` if it is persisted already.
    """
    classification = problem_type == "classification"
    df = _source(df, target, key, classification)
    error, transform = None, feature_plan.get("custom_transform")
    if transform is not None:
        df, error = custom_transform(df, transform, hidden=[ROW_KEY, "label"])
        feature_plan = {name: value for name, value in feature_plan.items() if name != "custom_transform"}
    kept = df.persist() if keep_source or transform is None else df
    try:
        prepared = _prepared(kept, feature_plan, classification, fit_scope, test_fraction, seed)
    finally:
        if kept is not df or keep_source:
            kept.unpersist()
    prepared.error = error
    return prepared


def _prepared(df, feature_plan, classification, fit_scope, test_fraction, seed) -> PreparedData:
    keep, by = [ROW_KEY], {"stratify": "label", "exact": True} if classification else {}
    if fit_scope == "all":
        ready = preprocess(df, "label", feature_plan, classification, keep)
        whole, notes = _balance(_vectors(ready.train, ready.features), feature_plan, classification, seed, ready.notes)
        # Synthetic rows are drawn once; both sides of the split read the same ones.
        split = train_test_split(whole, [ROW_KEY], test_fraction, seed, **by)
        train, test = (split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    else:
        split = train_test_split(df, [ROW_KEY], test_fraction, seed, **by)
        sides = [split.filter(F.col("split") == s).drop("split") for s in ("train", "test")]
        ready = preprocess(sides[0], "label", feature_plan, classification, keep, [sides[1]])
        train, notes = _balance(_vectors(ready.train, ready.features), feature_plan, classification, seed, ready.notes)
        test = _vectors(ready.others[0], ready.features)
    train, test = _spread(train).persist(), test.persist()
    try:
        top = df.agg(F.max("label")).first()[0]
        if train.count() == 0:
            raise ValueError("no training rows with a target")
        test.count()
    except Exception:
        train.unpersist()
        test.unpersist()
        raise
    classes = int(top) + 1 if classification else None
    return PreparedData(train, test, classes, ready.error, notes)


def _spread(df: DataFrame) -> DataFrame:
    """The rows over all cores. Learners read them many times, and preparation leaves a small table in one partition."""
    df = materialize(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    # Learners draw rows by their places, so these depend on the rows alone.
    return df.repartition(cores, ROW_KEY).sortWithinPartitions(ROW_KEY)


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return assemble(df, features).select(ROW_KEY, F.col("label").cast("double").alias("label"), "features")


def _balance(df, feature_plan, classification, seed, notes):
    wanted = feature_plan.get("imbalance_handling") or {}
    if not (wanted.get("apply") and classification):
        return df, notes
    method = wanted.get("method") or "smote"
    df = materialize(df)  # the sampler reads it several times
    if method == "smote":
        arrays = df.withColumn("features", vector_to_array("features"))
        grown = oversample_smote(arrays, "label", ROW_KEY, "features", seed=seed, draw="draw")
        grown = grown.withColumn("features", array_to_vector("features"))
    else:
        if method != "random":
            notes = [*notes, f"oversampling '{method}' taken as random"]
        grown = oversample_random(df, "label", [ROW_KEY], seed, copy="draw")
    key = F.when(F.col("draw") > 0, F.concat_ws(":", ROW_KEY, "draw")).otherwise(F.col(ROW_KEY))
    return grown.withColumn(ROW_KEY, key).drop("draw"), notes


def run_experiment(
    spark: SparkSession,
    goal: str,
    dataset: str,
    catalog: Catalog | None = None,
    key: str | None = None,
    plan: dict | None = None,
    feature_plan: dict | None = None,
    critic: Callable[[int, bool], str] = tune_once,
    replanner: Callable[[dict, dict], tuple[dict | None, dict | None]] | None = None,
    custom_transform: Callable[[DataFrame], DataFrame] | None = None,
    out: str | None = None,
    experiment_id: str | None = None,
    max_iterations: int = MAX_ITERATIONS,
    n_trials: int = TUNING_TRIALS,
    folds: int = CV_FOLDS,
    model_params: dict[str, dict] | None = None,
    fit_scope: str = "train",
    seed: int = SEED,
) -> Outcome:
    """Load, profile, plan, prepare, train, rank, tune and report.

    `plan` and `feature_plan` replace the plans derived from the goal and the table.
    `critic` decides after every ranking what happens next (`tune`, `replan` or `stop`), `replanner` gives new
    plans for the next iteration; without one the plans stay as they are. `model_params` sets parameters per model, in tuning too.
    A failure ends in status `failed` with its message as the report.
    """
    wanted = validate_goals(goal, dataset)
    experiment_id = experiment_id or uuid.uuid4().hex
    outcome = Outcome(experiment_id, "running")
    if out:
        _record_state(spark, outcome, wanted, out)
    try:
        _run(
            spark, wanted, catalog, key, plan, feature_plan, critic, replanner, custom_transform, out,
            max_iterations, n_trials, folds, model_params or {}, fit_scope, seed, outcome,
        )
        outcome.status = "completed"
    except Exception as problem:  # noqa: BLE001 - kept in the record
        logger.error("experiment %s failed: %s\n%s", experiment_id, problem, traceback.format_exc())
        outcome.status, outcome.report = "failed", f"Experiment failed: {problem}"
    if out:
        _record_state(spark, outcome, wanted, out)
        append_traces(step_traces(spark, outcome), f"{out}/traces")
    return outcome


def _record_state(spark: SparkSession, outcome: Outcome, wanted, out: str) -> None:
    """One more row of the experiment; `latest_experiments` reads the last of each."""
    row = experiment_row(spark, outcome, wanted.goal, wanted.dataset)
    row.write.mode("append").parquet(f"{out}/experiments")


def step_traces(spark: SparkSession, outcome: Outcome) -> DataFrame:
    """One trace for each step the loop took, with its seconds; it calls no model service, so tokens and cost are 0."""
    rows = [(outcome.experiment_id, name, seconds) for name, seconds in outcome.steps]
    frame = spark.createDataFrame(rows, "experiment_id string, agent_name string, latency double")
    return complete_traces(frame.withColumn("created_at", F.current_timestamp()))


def _run(
    spark, wanted, catalog, key, plan, feature_plan, critic, replanner, custom_transform, out,
    max_iterations, n_trials, folds, model_params, fit_scope, seed, outcome,
):
    df = load_dataset(spark, wanted.dataset, catalog)
    if key is None:
        df, key = with_row_key(df), ROW_KEY
    df = df.persist()  # read by the profile and by every fit of every iteration
    try:
        _loop(
            spark, df, wanted, key, plan, feature_plan, critic, replanner, custom_transform, out,
            max_iterations, n_trials, folds, model_params, fit_scope, seed, outcome,
        )
    finally:
        df.unpersist()


def _loop(
    spark, df, wanted, key, plan, feature_plan, critic, replanner, custom_transform, out,
    max_iterations, n_trials, folds, model_params, fit_scope, seed, outcome,
):
    plan = default_plan(plan if plan is not None else plan_from_goal(wanted.goal))
    features_of = [c for c in df.columns if c != key]
    target, guessed = resolve_target(features_of, plan["target_column"])
    if guessed:
        outcome.notes.append(f"target not found, took the last column '{target}'")
    data = df.select(*[column(c) for c in features_of])
    with outcome.step("profile"):
        outcome.summary = _summary(data, target, plan["problem_type"], out, outcome.experiment_id)
    if feature_plan is None:
        feature_plan = default_feature_plan(len(features_of))
    feature_plan = complete_feature_plan(feature_plan)
    if custom_transform is not None:
        feature_plan = {**feature_plan, "custom_transform": custom_transform}

    records: list[dict] = []
    written, iteration, tuned, prepared = 0, 0, False, None
    try:
        while True:
            if prepared is None:
                with outcome.step("prepare"):
                    prepared = prepare_data(df, target, key, feature_plan, plan["problem_type"], fit_scope, seed=seed, keep_source=False)
                outcome.notes += prepared.notes
                if prepared.error:
                    outcome.notes.append(f"custom transform left out: {prepared.error.strip().splitlines()[-1]}")
                with outcome.step("train"):
                    records += train_candidates(
                        prepared.train, prepared.test, plan["models"], plan["problem_type"], plan["metrics"],
                        ROW_KEY, iteration, model_params, len(records), prepared.classes,
                    )
            runs = runs_frame(spark, records, outcome.experiment_id)
            if out:
                append_runs(runs.filter(F.col("seq") >= written), f"{out}/runs")
                written = len(records)
            metric = plan["primary_metric"]
            state = convergence(runs, metric, max_iterations=max_iterations).filter(F.col("iteration") == iteration).first()
            action = "stop"
            if iteration < max_iterations and not (state and state["should_stop"]):
                action = critic(iteration, tuned)
            if action == "tune" and not tuned:
                tuned = True
                candidate = hpo_candidate(runs, metric).filter(F.col("iteration") == iteration).first()
                if candidate is not None:
                    name = candidate["model_name"]
                    with outcome.step("tune"):
                        tuned_run = tune(
                            prepared.train, prepared.test, name, plan["problem_type"], metric, plan["metrics"], ROW_KEY,
                            iteration, n_trials, folds, seed, len(records), limits=model_params.get(name), classes=prepared.classes,
                        )
                    records.append(tuned_run)
                    continue
            if action == "replan":
                prepared.release()
                prepared, tuned = None, False
                new = replanner(plan, feature_plan) if replanner else (None, None)
                plan, feature_plan, iteration = merge_replan(plan, feature_plan, *new, iteration)
                feature_plan = complete_feature_plan(feature_plan)
                continue
            break
    finally:
        if prepared is not None:
            prepared.release()
    outcome.iteration, outcome.plan, outcome.feature_plan = iteration, plan, feature_plan
    outcome.runs, outcome.rankings = runs, rank_runs(runs, metric)
    best = best_run(runs, metric).first()
    outcome.best_model = best.asDict(recursive=True) if best else None
    experiment = spark.createDataFrame([(outcome.experiment_id, wanted.goal)], "experiment_id string, goal string")
    outcome.report = report_table(experiment, runs, metric).first()["final_report"]


def _summary(data: DataFrame, target: str, problem_type: str, out: str | None, experiment_id: str) -> str:
    """The profile as text; the whole profile as a table below `out`."""
    # A regression target can have as many values as rows: no classes for it.
    whole = profile(data, target if problem_type == "classification" else "")
    if out:
        whole.withColumn("experiment_id", F.lit(experiment_id)).write.mode("append").parquet(f"{out}/profiles")
    return profile_text(whole, data)


def experiment_row(spark: SparkSession, outcome: Outcome, goal: str, dataset: str) -> DataFrame:
    def text(value) -> str | None:
        return None if value is None else json.dumps(value, default=str, sort_keys=True)

    shown = {k: v for k, v in outcome.feature_plan.items() if k != "custom_transform"}
    values = (
        outcome.experiment_id, goal, outcome.status, dataset, outcome.iteration, text(outcome.plan), outcome.summary,
        text(shown), text(outcome.best_model), outcome.report,
    )
    head = T.StructType(EXPERIMENTS.fields[: len(values)])
    return spark.createDataFrame([values], head).withColumns(
        {"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    )
