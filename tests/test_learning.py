"""Neighbours, oversampling, metrics, models, tuning and the experiment loop."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulark.operators.knn import knn_classify, knn_join, knn_regress
from tabulark.operators.metrics import classification_metrics, regression_metrics, roc_auc, roc_auc_ovr, score_predictions
from tabulark.operators.models import available_models, make_model
from tabulark.operators.sampling import oversample_random, oversample_smote
from tabulark.operators.tuning import (
    SEARCH_SPACES,
    cross_val_score,
    runs_frame,
    scoring_metric,
    search_space,
    train_candidates,
    tune,
)
from tabulark.plans.experiment import prepare_data, run_experiment
from tabulark.plans.goals import default_feature_plan
from tabulark.sources.runlog import EXPERIMENTS, RUNS, TRACES, latest_experiments, read_table


@pytest.fixture(scope="module")
def points(spark):
    """Clusters in the plane; a third of all rows are copies of one point."""
    generator = random.Random(5)
    rows = []
    for i in range(240):
        if i % 3 == 0:
            x = [1.0, 1.0]
        else:
            centre = generator.choice([(0.0, 0.0), (50.0, 0.0), (0.0, 80.0)])
            x = [c + generator.gauss(0, 1) for c in centre]
        rows.append((i, x, "a" if i % 5 else "b"))
    return spark.createDataFrame(rows, "id bigint, x array<double>, g string").repartition(5)


def brute(rows, k, metric, within=False):
    out = {}
    for i, x, g in rows:
        found = []
        for j, y, h in rows:
            if i == j or (within and g != h):
                continue
            d = sum(abs(a - b) for a, b in zip(x, y)) if metric == "manhattan" else math.dist(x, y)
            found.append((d, j))
        out[i] = [j for _, j in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "minkowski"])
@pytest.mark.parametrize("pivots", [1, 6])
def test_neighbours_equal_brute_force(points, metric, pivots):
    rows = [tuple(r) for r in points.collect()]
    found = knn_join(points, points, 4, "id", "id", "x", "x", metric, exclude_self=True, block_rows=25, pivots=pivots)
    lists = {}
    for r in found.orderBy("query_key", "rank").collect():
        lists.setdefault(r["query_key"], []).append(r["neighbour_key"])
    assert lists == brute(rows, 4, metric)


def test_neighbours_of_the_same_group(points):
    rows = [tuple(r) for r in points.collect()]
    found = knn_join(points, points, 3, "id", "id", "x", "x", within="g", exclude_self=True, block_rows=20, pivots=5)
    lists = {}
    for r in found.orderBy("query_key", "rank").collect():
        lists.setdefault(r["query_key"], []).append(r["neighbour_key"])
    assert lists == brute(rows, 3, "euclidean", within=True)


def test_far_cells_are_not_visited(points):
    found = knn_join(points, points, 3, "id", "id", "x", "x", exclude_self=True, block_rows=1000, pivots=6)
    plain = knn_join(points, points, 3, "id", "id", "x", "x", exclude_self=True, block_rows=1000, pivots=1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_small_blocks_do_not_multiply_what_is_moved(spark, monkeypatch):
    from tabulark.operators import knn

    rng = np.random.RandomState(3)
    points = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(600)], "id long, x array<double>")

    def counted(*args):
        return lambda queries, train: pa.table(
            {"query_key": [queries.num_rows], "neighbour_key": [train.num_rows], "distance": [float(queries.num_rows)]}
        )

    plain = knn._block_join
    monkeypatch.setattr(knn, "_block_join", counted)
    blocks = knn_join(points, points, 3, "id", "id", "x", "x", exclude_self=True, block_rows=4, pivots=5).collect()
    assert sum(r["query_key"] for r in blocks) <= 1200 and sum(r["neighbour_key"] for r in blocks) <= 1200
    monkeypatch.setattr(knn, "_block_join", plain)
    monkeypatch.setattr(knn, "_BLOCK_BYTES", 8 * 8 * 50)
    monkeypatch.setattr(knn, "_ASKED", {"euclidean": 90})
    cut = knn_join(points, points, 3, "id", "id", "x", "x", exclude_self=True, block_rows=4, pivots=5)
    whole = knn_join(points, points, 3, "id", "id", "x", "x", exclude_self=True, pivots=1)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_manhattan_tiles_are_bounded(monkeypatch):
    from tabulark.operators import knn

    sizes, plain = [], knn._distances

    def measured(a, b, metric, p):
        sizes.append(len(a) * len(b))
        return plain(a, b, metric, p)

    monkeypatch.setattr(knn, "_distances", measured)
    rng = np.random.RandomState(4)
    x = rng.standard_normal((900, 3))
    schema = pa.schema([("query_key", pa.int64()), ("neighbour_key", pa.int64()), ("distance", pa.float64())])
    keys, vectors, zero = np.arange(900), pa.array(x.tolist()), np.zeros(900, "int32")
    queries = pa.table({"_q": keys, "_v": vectors, "_visit": [[0]] * 900})
    train = pa.table({"_t": keys, "_v": vectors, "_cell": zero})
    found = knn._block_join(2, "manhattan", 1.0, True, [], schema, 1 << 20)(queries, train)
    d = np.abs(x[:, None] - x[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    assert max(sizes) <= 1 << 16
    assert found.column("neighbour_key").to_pylist() == np.argsort(d, axis=1, kind="stable")[:, :2].ravel().tolist()


def test_fewer_rows_than_neighbours(points):
    few = points.filter("id < 3")
    found = knn_join(points.filter("id = 7"), few, 5, "id", "id", "x", "x")
    assert [r["rank"] for r in found.orderBy("rank").collect()] == [1, 2, 3]


def test_votes(spark):
    rows = [(1, 0, 1.0), (1, 1, 0.5), (1, 0, 4.0), (1, 1, 9.0), (2, 1, 0.0), (2, 0, 0.1), (2, 0, 0.2)]
    found = spark.createDataFrame(rows, "query_key int, label int, distance double")
    uniform = {r["query_key"]: r["prediction"] for r in knn_classify(found, "label", 2).collect()}
    near = {r["query_key"]: (r["prediction"], r["scores"]) for r in knn_classify(found, "label", 2, "distance").collect()}
    assert uniform == {1: 0.0, 2: 0.0}
    assert near[1][0] == 1.0 and near[2] == (1.0, [0.0, 1.0])
    means = {r["query_key"]: r["prediction"] for r in knn_regress(found, "label", "distance").collect()}
    assert means[2] == 1.0 and math.isclose(means[1], (2 + 1 / 9) / (1 + 2 + 0.25 + 1 / 9))


def test_random_oversampling_levels_classes(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(50)] + [(99, None)], "id bigint, y int")
    grown = oversample_random(df.filter("y IS NOT NULL"), "y", ["id"])
    counts = {r["y"]: r["count"] for r in grown.groupBy("y").count().collect()}
    assert counts == {0: 47, 1: 47}
    copies = [r["n"] for r in grown.filter("y = 1").groupBy("id").agg(F.count("*").alias("n")).collect()]
    assert max(copies) - min(copies) <= 1


def test_one_row_repeated_very_often(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(2600)], "id bigint, y int")
    grown = oversample_random(df, "y", ["id"])
    assert grown.filter("y = 1").select("copy").distinct().count() == 2599 == grown.filter("y = 1").count()


def test_smote_rows_lie_on_segments(spark):
    generator = np.random.default_rng(1)
    rows = [(i, int(i < 8), [float(v) for v in generator.normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, y int, x array<double>")
    grown = oversample_smote(df, "y", "id", "x").collect()
    minority = {r["id"]: np.array(r["x"]) for r in grown if r["y"] == 1 and r["draw"] == 0}
    synthetic = [r for r in grown if r["draw"] > 0]
    assert len(synthetic) == 32 - 8 and all(r["y"] == 1 for r in synthetic)
    for r in synthetic:
        base, x = minority[r["id"]], np.array(r["x"])
        order = sorted((float(np.linalg.norm(base - v)), i) for i, v in minority.items() if i != r["id"])[:5]
        gaps = []
        for _, i in order:
            step = minority[i] - base
            share = float((x - base) @ step / (step @ step))
            gaps.append(float(np.linalg.norm(base + share * step - x)) if 0 <= share < 1 else math.inf)
        assert min(gaps) < 1e-9


def test_smote_needs_more_rows_than_neighbours(spark):
    df = spark.createDataFrame([(i, int(i < 5), [float(i)]) for i in range(30)], "id bigint, y int, x array<double>")
    assert oversample_smote(df, "y", "id", "x").count() == 30


def test_binary_and_weighted_scores(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)], "y int, p int")
    row = classification_metrics(df, "y", "p").first()
    assert (row["accuracy"], row["precision"], row["f1"]) == (0.8, 1.0, 0.8)
    assert math.isclose(row["recall"], 2 / 3)
    weighted = classification_metrics(df, "y", "p", ["recall"], "weighted").first()
    assert weighted.asDict() == {"recall": pytest.approx(0.8)}
    never = classification_metrics(df.withColumn("p", F.lit(0)), "y", "p").first()
    assert (never["precision"], never["recall"], never["f1"]) == (0.0, 0.0, 0.0)


def test_area_with_ties_and_by_range_sort(spark):
    generator = random.Random(2)
    rows = [(generator.randint(0, 1), generator.randint(0, 12) / 4) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for y, a in rows if y == 1 for z, b in rows if z == 0]
    for hot in (1, 1_000_000):
        assert math.isclose(roc_auc(df, "y", "s", hot).first()[0], sum(wins) / len(wins))
    assert roc_auc(df.withColumn("y", F.lit(1)), "y", "s").first()[0] is None
    scores = df.withColumn("scores", F.array(-F.col("s"), F.col("s")))
    assert math.isclose(roc_auc_ovr(scores, "y", "scores", 2).first()[0], sum(wins) / len(wins))


def test_regression_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    row = regression_metrics(df, "y", "p", ["mean_squared_error", "rmse", "mae", "r2", "what"]).first()
    assert row.asDict() == {"mse": 0.5, "rmse": pytest.approx(math.sqrt(0.5)), "mae": 0.5, "r2": 0.5}
    constant = df.withColumn("y", F.lit(3.0))
    assert regression_metrics(constant, "y", "p", ["r2"]).first()["r2"] == 0.0


@pytest.fixture(scope="module")
def ring(spark):
    """Two classes only a curved border separates, and a number that depends on the radius."""
    generator = random.Random(9)
    rows = []
    for i in range(400):
        x, y = generator.uniform(-2, 2), generator.uniform(-2, 2)
        rows.append((str(i), float(x * x + y * y < 1.6), [x, y], x * x + y * y))
    df = spark.createDataFrame(rows, "row_key string, label double, x array<double>, r double")
    return df.select("row_key", "label", array_to_vector("x").alias("features"), "r").persist()


FAST = {
    "logistic_regression": {"max_iter": 20},
    "random_forest": {"n_estimators": 10, "max_depth": 5},
    "gradient_boosting": {"n_estimators": 5},
    "xgboost": {"n_estimators": 5, "max_depth": 4},
    "svm": {"max_iter": 20},
    "knn": {"weights": "distance"},
}


@pytest.mark.parametrize("name", available_models())
def test_classifiers(ring, name):
    predict = make_model(name, "classification", FAST[name]).fit(ring, None, "row_key")
    found, note = score_predictions(predict(ring), "classification", ["accuracy", "roc_auc"])
    assert note is None
    if name != "logistic_regression":  # a straight border cannot do it
        assert found["accuracy"] > 0.85 and found["roc_auc"] > 0.9


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting", "svm", "knn", "logistic_regression"])
def test_regressors(ring, name):
    data = ring.withColumn("label", F.col("r"))
    params = {"max_iter": 100} if name == "svm" else FAST[name]
    predict = make_model(name, "regression", params).fit(data, None, "row_key")
    found, _ = score_predictions(predict(data), "regression", ["r2"])
    assert found["r2"] > (0.6 if name != "logistic_regression" else -0.1)


def test_three_classes_by_one_against_the_rest(ring):
    data = ring.withColumn("label", F.when(F.col("r") < 1, 0.0).when(F.col("r") < 3, 1.0).otherwise(2.0))
    predict = make_model("gradient_boosting", "classification", {"n_estimators": 3}).fit(data)
    found, note = score_predictions(predict(data), "classification", ["accuracy", "roc_auc"])
    assert note is None and found["accuracy"] > 0.8 and found["roc_auc"] > 0.9


def test_poly_kernel(ring):
    predict = make_model("svm", "classification", {"kernel": "poly", "gamma": "auto", "max_iter": 5}).fit(ring)
    assert set(predict(ring).columns) >= {"prediction", "scores"}


def test_logistic_coefficients_solve_the_objective(spark):
    x = [[-2.0], [-1.0], [0.5], [1.0], [3.0], [0.0]]
    y = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0]
    df = spark.createDataFrame([(a, b) for a, b in zip(x, y)], "x array<double>, label double")
    train = df.select("label", array_to_vector("x").alias("features"))
    rows = make_model("logistic_regression", "classification", {"C": 2.0}).fit(train)(train).collect()
    # At the optimum of w²/2 + C·Σ loss the gradient vanishes: w = C·Σ (y - p)·x and Σ (y - p) = 0.
    left = [(r["label"] - r["scores"][1]) for r in rows]
    log_odds = [math.log(r["scores"][1] / r["scores"][0]) for r in rows]
    w = (log_odds[1] - log_odds[0]) / (x[1][0] - x[0][0])
    assert math.isclose(sum(left), 0.0, abs_tol=1e-4)
    assert math.isclose(w, 2.0 * sum(e * v[0] for e, v in zip(left, x)), abs_tol=1e-4)


def test_unknown_model():
    with pytest.raises(ValueError, match="random_forest"):
        make_model("no_such_model")


def test_search_space_stays_in_its_ranges():
    for name, ranges in SEARCH_SPACES.items():
        trials = search_space(name, 30)
        assert trials == search_space(name, 30) and len(trials) == 30
        for trial in trials:
            for parameter, spec in ranges.items():
                if isinstance(spec, tuple) and spec[0] != "choice":
                    assert spec[1] <= trial[parameter] <= spec[2]
                elif isinstance(spec, tuple):
                    assert trial[parameter] in spec[1:]
    assert search_space("none", 2) == [{}, {}]
    assert (scoring_metric("roc_auc", "regression"), scoring_metric("?", "classification")) == ("r2", "accuracy")


def test_candidates_go_on_after_a_failure(spark, ring):
    train, test = ring.filter("row_key % 4 > 0"), ring.filter("row_key % 4 = 0")
    records = train_candidates(train, test, ["nothing", "knn"], "classification", ["f1", "roc_auc"], "row_key", 1)
    assert records[0]["error"].startswith("Unknown model") and records[0]["metrics"] == {}
    assert records[1]["error"] is None and records[1]["metrics"]["f1"] > 0.8 and records[1]["stage"] == "replan"
    assert runs_frame(spark, records, "e").columns == RUNS.fieldNames()


def test_tuning_minimises_errors(ring):
    data = ring.withColumn("label", F.col("r"))
    record = tune(
        data, data, "knn", "regression", "rmse", ["rmse", "r2"], "row_key", n_trials=2, folds=2, limits={"metric": "euclidean"}
    )
    scores = [
        cross_val_score(data, "knn", "regression", {**p, "metric": "euclidean"}, "rmse", "row_key", 2)
        for p in search_space("knn", 2)
    ]
    assert float(record["parameters"]["best_trial_value"]) == pytest.approx(min(scores))
    assert record["stage"] == "hpo" and record["parameters"]["n_trials"] == "2"


def test_imbalance_in_preparation(spark):
    rows = [(i, float(i), "x" if i % 2 else "y", "rare" if i % 10 == 0 else "common") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, v double, s string, target string")
    for method in ("smote", "random"):
        plan = {**default_feature_plan(3), "imbalance_handling": {"apply": True, "method": method}}
        data = prepare_data(df, "target", "id", plan, "classification")
        counts = [r["count"] for r in data.train.groupBy("label").count().collect()]
        assert len(counts) == 2 and counts[0] == counts[1]
        assert data.train.select("row_key").distinct().count() == data.train.count()
        assert data.test.count() + data.train.filter("NOT contains(row_key, ':')").count() == 200
        data.release()
    whole = prepare_data(df, "target", "id", plan, "classification", fit_scope="all")
    assert whole.train.count() + whole.test.count() == 360
    whole.release()


def test_experiment(spark, small, tmp_path):
    out = str(tmp_path / "out")

    def catalog_entry(session):
        documents = session.read.parquet(f"{small}/documents.parquet").drop("text", "source")
        labels = session.read.parquet(f"{small}/labels.parquet").selectExpr("doc_id", "quality AS target")
        return documents.join(labels, "doc_id")

    outcome = run_experiment(
        spark, "Predict document quality", "quality", {"quality": catalog_entry}, key="doc_id", out=out,
        plan={"models": ["logistic_regression", "nothing"]}, n_trials=1, folds=2, model_params=FAST,
    )
    assert outcome.status == "completed", outcome.report
    assert outcome.report.startswith("# ML Experiment Report") and "logistic_regression" in outcome.report
    stages = sorted((r["stage"], r["error"] is None) for r in read_table(spark, f"{out}/runs", RUNS).collect())
    assert stages == [("hpo", True), ("initial", False), ("initial", True)]
    states = read_table(spark, f"{out}/experiments", EXPERIMENTS)
    assert sorted(r["status"] for r in states.collect()) == ["completed", "running"]
    kept = latest_experiments(states).first()
    assert kept["status"] == "completed" and kept["experiment_id"] == outcome.experiment_id
    steps = read_table(spark, f"{out}/traces", TRACES).collect()
    assert sorted(r["agent_name"] for r in steps) == ["prepare", "profile", "train", "tune"] and all(r["latency"] > 0 for r in steps)
    parameters = {r["stage"]: r["parameters"] for r in read_table(spark, f"{out}/runs", RUNS).filter("error is null").collect()}
    assert {"C", "max_iter"} <= set(parameters["initial"]) and {"C", "max_iter", "n_trials"} <= set(parameters["hpo"])
    assert [r["rank"] for r in outcome.rankings.orderBy("rank").collect()] == [1, 2]


def test_failed_experiment_is_recorded(spark, tmp_path):
    out = str(tmp_path / "out")
    outcome = run_experiment(spark, "Predict nothing", str(tmp_path / "absent.csv"), out=out)
    assert outcome.status == "failed" and "not found" in outcome.report
    again = run_experiment(spark, "Predict nothing", str(tmp_path / "absent.csv"), out=out)
    found = latest_experiments(read_table(spark, f"{out}/experiments", EXPERIMENTS)).collect()
    assert {r["experiment_id"]: r["status"] for r in found} == {outcome.experiment_id: "failed", again.experiment_id: "failed"}
    assert outcome.experiment_id != again.experiment_id


def test_settings_name_every_parameter():
    model = make_model("xgboost", "classification", {"reg_alpha": 1.0, "max_depth": None})
    assert model.settings["reg_alpha"] == 1.0 and model.settings["reg_lambda"] == 1.0 and model.settings["max_depth"] == 10 and model.settings["n_estimators"] == 100
    with pytest.raises(ValueError, match="max_depth"):
        make_model("random_forest", "classification", {"max_depth": 31}).settings
    assert make_model("logistic_regression", "regression").settings == {"alpha": 1.0, "max_iter": 1000}


@pytest.mark.parametrize("target", ["number", "text"])
def test_prepared_data_is_right_for_any_names(spark, target):
    rows = [(i, float(i % 3 + 1) if i % 10 else float("nan"), "xyz"[i % 3] if i % 10 else None, i % 7, i % 5, "ab"[i % 2], float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, number double, text string, label int, split int, row_key string, value double")
    df = df.drop("text" if target == "number" else "number")
    plan = {**default_feature_plan(4), "custom_transform": lambda d: d.withColumn("mean", F.lit(d.agg(F.avg("value")).first()[0]))}
    data = prepare_data(df, target, "id", plan, "classification")
    assert data.error is None and data.classes == 3
    sides = {s: {r["label"]: r["count"] for r in d.groupBy("label").count().collect()} for s, d in (("train", data.train), ("test", data.test))}
    assert sides == {"train": {0.0: 96, 1.0: 96, 2.0: 96}, "test": {0.0: 24, 1.0: 24, 2.0: 24}}
    assert len(data.train.first()["features"]) == 5
    assert not set(r["row_key"] for r in data.train.collect()) & set(r["row_key"] for r in data.test.collect())
    data.release()


def test_replanned_experiment_numbers_its_iterations(spark, ring):
    df = ring.selectExpr("row_key", "label AS target", "r")
    critic = lambda iteration, tuned: "replan" if iteration < 2 else "stop"
    outcome = run_experiment(
        spark, "Predict the ring", "ring", {"ring": lambda _: df}, key="row_key", critic=critic,
        plan={"models": ["logistic_regression"], "metrics": ["accuracy"]}, model_params=FAST,
        replanner=lambda plan, features: ({**plan, "models": ["random_forest"]}, None),
    )
    assert outcome.status == "completed", outcome.report
    found = {(r["iteration"], r["model_name"], r["stage"]) for r in outcome.runs.collect()}
    assert found == {(0, "logistic_regression", "initial"), (1, "random_forest", "replan")} | (
        {(2, "random_forest", "replan")} if outcome.iteration == 2 else set()
    )


def test_small_linear_fits_take_few_tasks(spark, small):
    """An iteration over a few rows is one task, and the folds of a trial run side by side with the same score."""
    from tabulark.operators import models, tuning

    rows = [(str(i), float(i % 3 == 0), [float(i % 7), float(i % 5)]) for i in range(60)]
    train = spark.createDataFrame(rows, "row_key string, label double, x array<double>").repartition(8)
    train = train.select("row_key", "label", array_to_vector("x").alias("features")).persist()
    assert models._dense(train, 60).rdd.getNumPartitions() == 1
    assert models._dense(train, 10**7).rdd.getNumPartitions() == 8
    cores = spark.sparkContext.defaultParallelism
    assert models.fits_at_once(train, "logistic_regression") == cores and models.fits_at_once(train, "random_forest") == 1
    scores = [tuning.cross_val_score(train, "logistic_regression", "classification", {}, "accuracy", "row_key", 3, parallelism=p) for p in (1, 3)]
    assert scores[0] == scores[1]
    train.unpersist()
