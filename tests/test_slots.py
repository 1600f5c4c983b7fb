"""Selection of one-hot slots from counts, against the same selection over materialised vectors."""

import random

import pytest
from pyspark.sql import functions as F

from tabulark.operators.preprocess import (
    f_classif,
    f_regression,
    fit_encode_onehot,
    preprocess,
    select_k_best,
    select_with_slots,
    slot_scores,
    take_slots,
)

PLAN = {
    "preprocessing_steps": [{"step": "imputation", "method": "median", "columns": "numeric"}, {"step": "encoding", "method": "onehot", "columns": "categorical"}],
    "feature_selection": {"apply": True, "method": "select_k_best", "n_features": 20},
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        y = rng.choice([0, 1, 1, 2])
        color = rng.choice(["red", "green", "blue", None] if y else ["red", "red", "grey"])
        data.append((i, y, color, rng.choice("abcdefgh"), rng.random() < 0.3 + y / 10, rng.gauss(y, 2), rng.gauss(0, 1)))
    return spark.createDataFrame(data, "id long, y int, c string, d string, e boolean, u double, w double").cache()


@pytest.mark.parametrize("classification", (True, False))
def test_same_scores_and_choice_as_vectors(rows, classification):
    texts, numbers = ["c", "d", "e"], ["u", "w"]
    label = "y" if classification else "u"
    numbers = numbers if classification else ["w"]
    fitted = fit_encode_onehot(rows, texts, expand=False)
    vectors, slots = fitted.apply(rows), fitted.params["slots"]
    wide = (f_classif if classification else f_regression)(vectors, [*numbers, *texts], label, slots).collect()
    want = {r["feature"]: r["score"] for r in wide}
    for r in slot_scores(rows, texts, label, classification).collect():
        name = f"{texts[r['k']]}_{r['value'] if r['k'] < 2 else r['value'] == 'true'}"
        assert want[name] == pytest.approx(r["score"], rel=1e-9)
    for k in (1, 3, 7, None):
        chosen = select_with_slots(rows, numbers, texts, label, k, classification)
        taken, names = take_slots(rows, chosen, ["id"])
        assert names == select_k_best(vectors, [*numbers, *texts], label, k, classification, slots)
        assert taken.columns == ["id", *names]


def test_default_plan_over_a_column_with_a_value_for_each_row(spark):
    wide = spark.range(200_000).select(
        "id", (F.col("id") % 2).alias("label"), F.concat(F.lit("v"), "id").alias("name"),
        F.when(F.col("id") % 2 == 1, "odd").when(F.col("id") % 50 != 0, "even").alias("kind"), (F.col("id") % 7).cast("double").alias("x"),
    )
    ready = preprocess(wide, "label", PLAN, True, keep=["id"], others=[wide.limit(10)])
    assert len(ready.features) == 20 and "kind_odd" in ready.features and ready.slots == {}
    assert ready.train.agg(F.sum("kind_odd")).first()[0] == 100_000 and ready.others[0].count() == 10
    assert ready.train.filter("kind_odd is null").count() == 0


def test_odd_tables(spark, rows):
    none = rows.select("y", F.lit(None).cast("string").alias("c"))
    assert select_with_slots(none, [], ["c"], "y") == []
    one = rows.select("y", F.lit("same").alias("c"), "u")
    assert select_with_slots(one, ["u"], ["c"], "y") == [("u", None)]
    assert slot_scores(rows.limit(0), ["c"], "y").count() == 0
