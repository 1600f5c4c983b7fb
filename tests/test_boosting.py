"""Boosted trees against a plain greedy search, for every loss, and in every way the sums are merged."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulark.operators import boosting
from tabulark.operators.boosting import Rule, fit
from tabulark.operators.models import make_model

ROWS = 300


def table(spark, x, y):
    rows = [(str(i), float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_key string, label double, x array<double>")
    return df.select("row_key", "label", array_to_vector("x").alias("features"), F.lit("kept").alias("scores_of"))


@pytest.fixture(scope="module")
def cells():
    random = np.random.default_rng(5)
    x = np.column_stack([random.integers(0, 12, ROWS), random.normal(size=ROWS).round(1), random.integers(0, 2, ROWS)]).astype(float)
    x[random.random(ROWS) < 0.1, 1] = np.nan
    noise = random.normal(size=ROWS)
    return x, x[:, 0] * 1.5 + np.nan_to_num(x[:, 1], nan=4.0) + 3 * x[:, 2] * (x[:, 0] > 5) + noise


def derivatives(loss, y, margins, k, by_count):
    if loss == "squared":
        return margins[:, 0] - y, np.ones(len(y))
    if loss == "logistic":
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return p - y, p * (1 - p)
    odds = np.exp(margins)
    p = odds[:, k] / odds.sum(axis=1)
    return p - (y == k), p * (1 - p) * (1 if by_count else 2)


def plain(x, y, rule, base, classes):
    """Every node tries every value of every feature, and both sides for missing values."""
    margins = np.tile(base, (len(y), 1)).astype(float)
    soft = lambda s: math.copysign(max(abs(s) - rule.reg_alpha, 0.0), s)
    worth = lambda s, t, n: (s * s / n if rule.by_count else soft(s) ** 2 / (t + rule.reg_lambda)) if n else 0.0

    def grow(rows, g, h, depth, out):
        scale = (classes - 1) / classes if rule.by_count and rule.loss == "softmax" else 1.0
        out[rows] = -rule.rate * scale * soft(g[rows].sum()) / (h[rows].sum() + rule.reg_lambda)
        if depth == rule.depth:
            return
        best = (rule.gamma + 1e-9, None)
        for f in range(x.shape[1]):
            own = x[rows, f]
            for value in np.unique(own[~np.isnan(own)]):
                for lefts in (np.isnan(own) | (own <= value), own <= value):
                    left, right = rows[lefts], rows[~lefts]
                    if min(len(left), len(right)) < rule.min_leaf:
                        continue
                    if not rule.by_count and min(h[left].sum(), h[right].sum()) < rule.min_child_weight:
                        continue
                    sums = [(g[r].sum(), h[r].sum(), len(r)) for r in (left, right, rows)]
                    gain = (worth(*sums[0]) + worth(*sums[1]) - worth(*sums[2])) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1]:
            for side in best[1]:
                grow(side, g, h, depth + 1, out)

    for _ in range(rule.rounds):
        steps = np.zeros_like(margins)
        for k in range(margins.shape[1]):
            g, h = derivatives(rule.loss, y, margins, k, rule.by_count)
            grow(np.arange(len(y)), g, h, 0, steps[:, k])
        margins += steps
    return margins


def got(model, df):
    rows = {int(r["row_key"]): r for r in model.transform(df).collect()}
    return [rows[i] for i in range(len(rows))]


@pytest.mark.parametrize("penalties", [{}, {"reg_lambda": 5.0, "reg_alpha": 8.0, "gamma": 3.0, "min_child_weight": 20.0}])
def test_numbers(spark, cells, penalties):
    x, y = cells
    rule = Rule("squared", rounds=4, depth=3, **penalties)
    df = table(spark, x, y)
    rows = got(fit(df, rule, key="row_key"), df)
    want = plain(x, y, rule, [y.mean()], 1)[:, 0]
    assert np.allclose([r["prediction"] for r in rows], want, atol=1e-8)
    assert rows[0]["scores_of"] == "kept" and "scores" not in rows[0].asDict()


@pytest.mark.parametrize("alpha", [0.0, 2.0])
def test_two_classes(spark, cells, alpha):
    x, y = cells
    y = (y > 10).astype(float)
    rule = Rule("logistic", rounds=3, depth=2, reg_alpha=alpha)
    df = table(spark, x, y)
    rows = got(fit(df, rule, 2, "row_key"), df)
    want = 1 / (1 + np.exp(-plain(x, y, rule, [0.0], 2)[:, 0]))
    assert np.allclose([r["scores"][1] for r in rows], want, atol=1e-8)
    assert [r["prediction"] for r in rows] == (want > 0.5).astype(float).tolist()


@pytest.mark.parametrize("by_count", [False, True])
def test_three_classes(spark, cells, by_count):
    x, y = cells
    y = np.digitize(y, [6, 14]).astype(float)
    more = {"by_count": True, "prior": True, "reg_lambda": 0.0, "min_leaf": 5} if by_count else {}
    rule = Rule("softmax", rounds=3, depth=2, **more)
    base = np.log(np.bincount(y.astype(int)) / len(y)) if by_count else np.zeros(3)
    odds = np.exp(plain(x, y, rule, base, 3))
    df = table(spark, x, y)
    rows = got(fit(df, rule, 3, "row_key"), df)
    assert np.allclose([r["scores"] for r in rows], odds / odds.sum(axis=1, keepdims=True), atol=1e-8)


def test_every_way_of_merging_gives_the_same(spark, cells, monkeypatch):
    x, y = cells
    df = table(spark, np.column_stack([x] * 12), y).repartition(7)
    rule = Rule("squared", rounds=6, depth=3, subsample=0.7, colsample=0.5)
    want = [r["prediction"] for r in got(fit(df, rule, key="row_key"), df)]
    monkeypatch.setattr(boosting, "_GATHER_BYTES", 0)
    monkeypatch.setattr(boosting, "_PASS_BYTES", 0)
    few = Rule("squared", rounds=2, depth=2, subsample=0.7, colsample=0.5)
    shuffled = [r["prediction"] for r in got(fit(df, few, key="row_key"), df)]
    monkeypatch.undo()
    assert np.allclose(shuffled, [r["prediction"] for r in got(fit(df, few, key="row_key"), df)], atol=1e-9)
    # The rows drawn depend on the key alone.
    again = [r["prediction"] for r in got(fit(df.repartition(2, "label"), rule, key="row_key"), df)]
    assert np.allclose(again, want, atol=1e-9)


def test_features_and_rows_are_drawn(spark, cells):
    x, y = cells
    df = table(spark, x, y)
    whole = fit(df, Rule("squared", rounds=8, depth=2), key="row_key")
    part = fit(df, Rule("squared", rounds=8, depth=2, subsample=0.5, colsample=0.34), key="row_key")
    used = lambda model: [{f for f, left, i in zip(t.feature, t.left, range(99)) if left != i} for (t,) in model.trees]
    assert all(len(u) == 1 for u in used(part)) and len(set().union(*used(part))) > 1 and any(len(u) > 1 for u in used(whole))
    rows = np.arange(100_000, dtype=np.int64)
    share = [boosting._drawn(rows, i, Rule("squared", subsample=0.3)) for i in range(2)]
    assert abs(share[0].mean() - 0.3) < 0.01 and abs((share[0] & share[1]).mean() - 0.09) < 0.01


def test_odd_tables(spark):
    empty = table(spark, np.zeros((0, 2)), [])
    assert fit(empty, Rule("squared")).trees == []
    same = table(spark, np.ones((20, 2)), np.arange(20))
    assert {r["prediction"] for r in fit(same, Rule("squared", rounds=2)).transform(same).collect()} == {9.5}
    missing = table(spark, np.full((10, 1), np.nan), np.arange(10))
    assert {r["prediction"] for r in fit(missing, Rule("squared", rounds=2)).transform(missing).collect()} == {4.5}
    # A value too rare for any quantile still has its own bin.
    x = np.zeros((5000, 1))
    x[:3] = 1.0
    rare = table(spark, x, x[:, 0] * 100)
    found = fit(rare, Rule("squared", rounds=1, depth=1, rate=1.0, reg_lambda=0.0)).transform(rare)
    assert sorted({round(r["prediction"], 6) for r in found.collect()}) == [0.0, 100.0]
    with pytest.raises(ValueError, match="bins"):
        fit(same, Rule("squared", bins=256))


def test_model_passes_all_parameters_on(spark, cells):
    x, y = cells
    df = table(spark, x, y)
    params = {"n_estimators": 3, "max_depth": 2, "reg_alpha": 4.0, "reg_lambda": 2.0, "gamma": 1.0, "min_child_weight": 9.0}
    model = make_model("xgboost", "regression", params)
    assert "ignored" not in model.settings and model.settings["reg_alpha"] == 4.0
    rows = {int(r["row_key"]): r["prediction"] for r in model.fit(df, None, "row_key")(df).collect()}
    rule = Rule("squared", rounds=3, depth=2, reg_alpha=4.0, reg_lambda=2.0, gamma=1.0, min_child_weight=9.0)
    assert np.allclose([rows[i] for i in range(ROWS)], plain(x, y, rule, [y.mean()], 1)[:, 0], atol=1e-8)


def test_margins_added_round_by_round_are_those_of_all_trees(spark, cells):
    """Over several settlings: each round learns from the margins of all trees before it, to the last digit."""
    x, y = cells
    train = table(spark, x, y)
    long = fit(train, Rule("squared", rounds=9, depth=2, subsample=0.7), key="row_key")
    for rounds in (1, 4, 7):
        short = fit(train, Rule("squared", rounds=rounds, depth=2, subsample=0.7), key="row_key")
        assert [t.value for (t,) in short.trees] == [t.value for (t,) in long.trees[:rounds]]


def test_prepared_rows_lie_on_all_cores(spark, small):
    from tabulark.plans.experiment import prepare_data
    from tabulark.plans.goals import default_feature_plan

    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    data = prepare_data(orders, "o_orderstatus", "o_orderkey", default_feature_plan(3), "classification")
    rows = data.train.groupBy(F.spark_partition_id().alias("part")).count().collect()
    data.release()
    assert len(rows) == spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in rows) < 2 * sum(r["count"] for r in rows) / len(rows)


def _queries(spark, train, rule, classes=2):
    """How many SQL queries a fit plans."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    fit(train, rule, classes, "row_key")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return store.executionsCount() - before


def test_a_pass_plans_no_query(spark, cells):
    """The levels of all rounds are passes over kept blocks; more rounds plan no more queries."""
    train = table(spark, *cells)
    assert _queries(spark, train, Rule("squared", rounds=1, depth=1)) == _queries(spark, train, Rule("squared", rounds=5, depth=2))


def test_blocks_of_few_rows_and_many_give_the_same(spark, cells, monkeypatch):
    x, y = cells
    train, rule = table(spark, x, y), Rule("squared", rounds=5, depth=3, subsample=0.7)
    want = fit(train, rule, key="row_key").trees
    monkeypatch.setattr(boosting, "_ROWS", 7)
    assert all(np.allclose(a.value, b.value, atol=1e-9) and a.cut == b.cut for (a,), (b,) in zip(want, fit(train, rule, key="row_key").trees))


def test_rounds_of_three_classes_plan_no_query(spark, cells):
    x, y = cells
    train = table(spark, x, np.digitize(y, [6, 14]).astype(float))
    more = {"by_count": True, "prior": True, "reg_lambda": 0.0}
    counts = [_queries(spark, train, Rule("softmax", rounds=n, depth=2, **more), 3) for n in (1, 4)]
    assert counts[0] == counts[1]
