"""Profiles and feature preparation: edge cases by hand."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulark.functions.columns import categorical_columns, numeric_columns
from tabulark.operators.preprocess import (
    custom_transform,
    encode_target,
    f_classif,
    f_regression,
    fill_remaining,
    fit_encode_label,
    fit_encode_onehot,
    fit_impute_mode,
    fit_impute_numeric,
    fit_pca,
    fit_scale,
    interaction_feature,
    preprocess,
    run_transform,
    select_k_best,
    take_features,
)
from tabulark.operators.profile import (
    class_distribution,
    correlations,
    describe_numeric,
    missing_by_column,
    profile,
    profile_text,
    total_missing_pct,
)
from tabulark.sources.datasets import load_csv, load_dataset, load_named, named_table, with_row_key

NAN = float("nan")


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1.0, 10, "b", True, 5.0), (NAN, 20, None, None, 5.0), (3.0, None, "a", False, 5.0), (None, 40, "b", True, 5.0)]
    return spark.createDataFrame(rows, "x double, n int, s string, f boolean, konst double")


def values(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_missing_counts_null_and_nan(mixed):
    found = {r["column"]: (r["missing"], r["percent"]) for r in missing_by_column(mixed).collect()}
    assert found == {"x": (2, 50.0), "n": (1, 25.0), "s": (1, 25.0), "f": (1, 25.0)}
    assert total_missing_pct(mixed).first()[0] == 25.0


def test_an_empty_table_has_no_share_of_missing_cells(mixed):
    empty = mixed.limit(0)
    assert total_missing_pct(empty).first()[0] is None
    assert {r["name"]: r["value"] for r in profile(empty, "s").filter("section = 'table'").collect()} == {
        "rows": 0.0, "columns": 5.0, "missing_pct": None
    }


def test_classes_by_size_then_name(mixed):
    assert [tuple(r) for r in class_distribution(mixed, "s").orderBy(F.desc("count"), "class").collect()] == [("b", 2), ("a", 1)]
    assert class_distribution(mixed, "absent") is None


def test_statistics_skip_missing(mixed):
    row = describe_numeric(mixed, ["x"]).first()
    assert (row["count"], row["mean"], row["p50"], row["max"]) == (2, 2.0, 2.0, 3.0)
    assert math.isclose(row["std"], math.sqrt(2))


def test_correlation_of_common_rows_and_of_constants(spark):
    rows = [(1.0, 2.0, 7.0), (2.0, None, 7.0), (3.0, 1.0, 7.0), (4.0, 5.0, 7.0), (NAN, 9.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r["col_a"], r["col_b"]): r["correlation"] for r in correlations(df).collect()}
    a, b = [1, 3, 4], [2, 1, 5]
    ma, mb = sum(a) / 3, sum(b) / 3
    r = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(
        sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)
    )
    assert math.isclose(found["a", "b"], abs(r))
    assert found["a", "c"] is None and found["b", "c"] is None


def test_wide_correlations_equal_narrow_ones(spark):
    wide = spark.range(200).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(62)])
    full = {(r["col_a"], r["col_b"]): r["correlation"] for r in correlations(wide).collect()}
    part = {(r["col_a"], r["col_b"]): r["correlation"] for r in correlations(wide, ["c0", "c1", "c61"]).collect()}
    assert len(full) == 62 * 61 // 2
    assert all(math.isclose(full[p], v, abs_tol=1e-12) for p, v in part.items())


def test_profile_text(mixed):
    found = profile(mixed, "s")
    text = profile_text(found, mixed)
    assert "numeric: 2" in text or "numeric: 3" in text
    assert "s/b 2" in text and "s/a 1" in text and "more" not in text
    assert "and 1 more" in profile_text(found, mixed, {"class": 1})


def test_imputation(mixed):
    assert values(fit_impute_numeric(mixed, ["x", "n"], "mean").apply(mixed), "x") == [1.0, 2.0, 3.0, 2.0]
    assert values(fit_impute_numeric(mixed, ["n"], "median").apply(mixed), "n") == [10.0, 20.0, 20.0, 40.0]
    filled = fit_impute_mode(mixed, ["s", "f"]).apply(mixed)
    assert values(filled, "s") == ["b", "b", "a", "b"]
    assert values(filled, "f") == [True, True, False, True]


def test_most_frequent_takes_the_smallest_on_ties_and_unknown_for_none(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "s string, t string")
    filled = fit_impute_mode(df, ["s", "t"]).apply(df)
    assert values(filled, "s") == ["b", "a", "a"] and set(values(filled, "t")) == {"unknown"}


def test_constant_columns_are_only_centred(mixed):
    for method in ("standard", "minmax", "robust", "no such method"):
        assert values(fit_scale(mixed, ["konst"], method).apply(mixed), "konst") == [0.0] * 4


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert values(fit_scale(df, ["x"]).apply(df), "x") == [-1.0, 1.0]


def test_fitted_steps_apply_to_other_frames(spark):
    train = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    test = spark.createDataFrame([(20.0,)], "x double")
    assert values(fit_scale(train, ["x"], "minmax").apply(test), "x") == [2.0]


def test_onehot_drops_the_first_value_and_keeps_missing_at_zero(mixed):
    encoded = fit_encode_onehot(mixed, ["s", "f"]).apply(mixed)
    assert encoded.columns == ["x", "n", "konst", "s_b", "f_True"]
    assert values(encoded, "s_b") == [1.0, 0.0, 0.0, 1.0]
    assert values(encoded, "f_True") == [1.0, 0.0, 0.0, 1.0]


def test_onehot_vectors_have_the_same_slots(mixed):
    fitted = fit_encode_onehot(mixed, ["s", "f"], expand=False)
    assert fitted.params["slots"] == {"s": ["s_b"], "f": ["f_True"]}
    dense = fitted.apply(mixed).select(vector_to_array("s").alias("s"), vector_to_array("f").alias("f"), "konst").collect()
    assert sorted(r["s"] for r in dense) == [[0.0], [0.0], [1.0], [1.0]] and sorted(r["f"] for r in dense) == [[0.0], [0.0], [1.0], [1.0]]
    unknown = mixed.withColumn("s", F.lit("new"))
    assert {tuple(r["s"]) for r in fitted.apply(unknown).select(vector_to_array("s").alias("s")).collect()} == {(0.0,)}


@pytest.mark.parametrize("method", ["select_k_best", "pca"])
def test_selection_works_on_a_wide_text_column(spark, method):
    rows = [(i, f"name{i % 260:03d}", float(i % 7), i % 2) for i in range(780)]
    df = spark.createDataFrame(rows, "id int, name string, x double, y int")
    plan = {"preprocessing_steps": [{"step": "encoding", "method": "onehot"}], "feature_selection": {"apply": True, "method": method, "n_features": 5}}
    ready = preprocess(df, "y", plan, True, ["id"], [df.limit(3)])
    assert len(ready.features) == 5 and ready.train.count() == 780 and ready.others[0].count() == 3
    if method == "select_k_best":
        assert all(f.startswith("name_") for f in ready.features)
    else:
        dense = np.array([[x, *(1.0 if n == f"name{j:03d}" else 0.0 for j in range(1, 260))] for _, n, x, _ in rows])
        want = np.sort(np.linalg.eigvalsh(np.cov(dense.T)))[::-1][0]
        assert math.isclose(ready.train.agg(F.var_samp("`0`")).first()[0], want, rel_tol=1e-6)
        assert math.isclose(ready.train.agg(F.avg("`0`")).first()[0], 0.0, abs_tol=1e-9)


def test_vector_scores_equal_column_scores(spark):
    rows = [("abcd"[i % 4] if i % 5 else None, float(i % 7), i % 3, float(i * i % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "c string, x double, y int, z double")
    columns = fit_encode_onehot(df, ["c"]).apply(df)
    fitted = fit_encode_onehot(df, ["c"], expand=False)
    vectors, slots = fitted.apply(df), fitted.params["slots"]
    for score, label in ((f_classif, "y"), (f_regression, "z")):
        wide = {r["feature"]: r["score"] for r in score(columns, ["x", "c_b", "c_c", "c_d"], label).collect()}
        sparse = {r["feature"]: r["score"] for r in score(vectors, ["x", "c"], label, slots).collect()}
        assert wide.keys() == sparse.keys() and all(math.isclose(wide[k], sparse[k], rel_tol=1e-6, abs_tol=1e-9) for k in wide)


def test_no_column_is_lost_by_its_name(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("b", 3.0, 4)], "t string, value double, code int")
    assert sorted(map(tuple, encode_target(df, "t").select("t", "value", "code").collect())) == [(0, 1.0, 2), (1, 3.0, 4)]
    assert sorted(map(tuple, fit_encode_label(df, ["t"]).apply(df).select("t", "value", "code").collect())) == [(0, 1.0, 2), (1, 3.0, 4)]
    assert fit_encode_onehot(df, ["t"], expand=False).apply(df).columns == ["value", "code", "t"]


def test_unseen_categories_are_apart(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    test = spark.createDataFrame([("a",), ("zz",), ("yy",), (None,)], "t string")
    assert values(fit_encode_label(train, ["t"]).apply(test), "t") == [1, 3, 3, 0]


def test_user_transform_does_not_see_the_label(spark):
    df = spark.createDataFrame([("k1", 2.0, 10.0), ("k2", 3.0, 20.0)], "row_key string, only double, label double")
    changed, error = custom_transform(df, interaction_feature, hidden=["row_key", "label"])
    assert error is None and changed.columns == ["row_key", "label", "only"]
    seen = []
    custom_transform(df, lambda d: (seen.append((numeric_columns(d), categorical_columns(d))), d)[1], hidden=["row_key", "label"])
    assert seen == [(["only"], [])]
    _, error = custom_transform(df, lambda d: d.select("only"), hidden=["row_key", "label"])
    assert "must keep" in error


def test_label_codes_count_missing_as_text(mixed):
    assert values(fit_encode_label(mixed, ["s"]).apply(mixed), "s") == [2, 0, 1, 2]


def test_target_codes(spark):
    df = spark.createDataFrame([("no",), ("yes",), (None,)], "t string")
    assert values(encode_target(df, "t"), "t") == [0, 1, None]
    assert encode_target(df.withColumn("t", F.lit(3)), "t").first()[0] == 3


def test_fill_remaining(mixed):
    filled = fill_remaining(mixed)
    assert values(filled, "x") == [1.0, 0.0, 3.0, 0.0] and values(filled, "n") == [10, 20, 0, 40]
    assert values(filled, "s") == ["b", "0", "a", "b"]


def test_selection_keeps_order_and_puts_undefined_scores_last(spark):
    rows = [(float(i % 2), float(i), 1.0, float(i * i % 7), i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "same double, trend double, konst double, noise double, label int")
    features = ["konst", "noise", "trend"]
    assert "konst" not in select_k_best(df, features, "label", 2)
    assert select_k_best(df, features, "label", 99) == features
    assert select_k_best(df, ["konst", "noise", "trend"], "trend", 1, classification=False) == ["trend"]


def test_pca_centres_and_fixes_signs(spark):
    df = spark.createDataFrame([(float(i), 100.0 - 2.0 * i, i) for i in range(10)], "a double, b double, id int")
    projected = fit_pca(df, ["a", "b"], 1).apply(df)
    assert projected.columns == ["id", "0"]
    found = [r["0"] for r in projected.orderBy("id").collect()]
    assert math.isclose(sum(found), 0.0, abs_tol=1e-9)
    # b has the larger loading, so the axis follows b, which falls with id.
    assert found[0] > 0 and math.isclose(found[0], 4.5 * math.sqrt(5))


def test_user_transform_success(spark):
    df = spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "col1 bigint, col2 bigint")
    result, error = custom_transform(df, lambda d: d.withColumn("new_col", F.col("col1") + F.col("col2")))
    assert error is None and values(result, "new_col") == [5, 7, 9]


def test_user_transform_missing():
    with pytest.raises(ValueError, match="transform_data"):
        run_transform(None, None)


def test_user_transform_failure_leaves_the_baseline(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "col1 bigint, label int")

    def broken(_):
        raise ValueError("Custom error occurred!")

    ready = preprocess(df, "label", {"custom_transform": broken, "preprocessing_steps": []}, True)
    assert "ValueError: Custom error occurred!" in ready.error
    assert ready.features == ["col1"] and ready.train.count() == 3


def test_interaction_needs_two_numbers(mixed):
    assert "custom_interaction" in interaction_feature(mixed).columns
    assert interaction_feature(mixed.select("x", "s")).columns == ["x", "s"]


def test_preprocess_fits_on_train_only(spark):
    train = spark.createDataFrame([(0.0, "a", 0), (2.0, "b", 1)], "x double, s string, label int")
    test = spark.createDataFrame([(4.0, "c", 1), (None, None, 0)], "x double, s string, label int")
    plan = {
        "preprocessing_steps": [
            {"step": "imputation", "method": "median", "columns": "numeric"},
            {"step": "scaling", "method": "standard", "columns": "numeric"},
            {"step": "encoding", "method": "onehot", "columns": "categorical"},
            {"step": "no_such_step"},
        ]
    }
    ready = preprocess(train, "label", plan, True, others=[test])
    assert ready.features == ["x", "s"] and ready.slots == {"s": ["s_b"]}
    shown = take_features(ready.others[0], ready.features, ["x", "s_b"], ready.slots, [])
    assert [tuple(r) for r in shown.select("x", "s_b").collect()] == [(3.0, 0.0), (0.0, 0.0)]
    assert any("no_such_step" in n for n in ready.notes)


def test_text_without_encoding_is_refused(spark):
    df = spark.createDataFrame([("a", 0)], "s string, label int")
    with pytest.raises(ValueError, match="encoding"):
        preprocess(df, "label", {"preprocessing_steps": []}, True)


def test_loading(spark, small, tmp_path):
    path = str(tmp_path / "nation.csv")
    spark.read.parquet(f"{small}/nation.parquet").write.option("header", True).csv(path)
    assert load_csv(spark, path).count() == 25
    assert load_dataset(spark, f"{small}/region.parquet").count() == 5
    catalog = {"regions": named_table(f"{small}/region.parquet", target="r_name")}
    assert "target" in load_dataset(spark, "regions", catalog).columns
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError, match="regions"):
        load_named(spark, "absent", catalog)
    keyed = with_row_key(load_csv(spark, path))
    assert keyed.select("row_key").distinct().count() == 25


@pytest.mark.parametrize("limit,rows", [(10, 0), (10_000, 1_000_000)])
def test_long_texts_are_not_numbered_by_one_task(spark, monkeypatch, limit, rows):
    from tabulark.operators import preprocess

    texts = [f"{i % 40:03d}" * 5 if i % 7 else None for i in range(100)]
    used, plain = [], preprocess.numbered
    monkeypatch.setattr(preprocess, "HOT_GROUP_BYTES", limit)
    monkeypatch.setattr(preprocess, "numbered", lambda df, by, order, name, hot: used.append(hot) or plain(df, by, order, name, hot))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.t for r in preprocess.fit_encode_label(df, ["t"]).apply(df).collect()}
    known = sorted({t or "None" for t in texts})
    assert got == {i: known.index(t or "None") for i, t in enumerate(texts)} and used == [rows]


def test_wide_onehot_makes_no_array_of_all_names(spark, tmp_path):
    from workload import all_checks

    rows = [(i, f"n{i % 50:02d}" if i % 9 else None) for i in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    found = all_checks()["encode_onehot_wide"].run(spark, str(tmp_path))
    names = sorted({n for _, n in rows if n})
    assert {r.c_custkey: r.slot for r in found.collect()} == {i: names.index(n) - 1 if n and n > names[0] else None for i, n in rows}
    assert "array_position" not in found._jdf.queryExecution().toString()
