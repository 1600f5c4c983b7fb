"""Neighbours, metrics, training, tuning and the whole experiment."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulark.operators.ann import approximate_knn_join, recall
from tabulark.operators.knn import knn_classify, knn_join, knn_regress
from tabulark.operators.metrics import classification_metrics, regression_metrics, roc_auc, roc_auc_ovr, score_predictions
from tabulark.operators.models import make_model
from tabulark.operators.preprocess import assemble
from tabulark.operators.split import train_test_split
from tabulark.operators.tuning import cross_val_score, runs_frame, search_space, train_candidates, tune
from tabulark.plans.experiment import prepare_data, run_experiment
from tabulark.plans.goals import default_feature_plan
from workload.common import LABELLED_SQL, Checks, hash_sql, labelled, rounded, table, unit_sql

CHECKS = Checks()


@CHECKS.query(
    "knn_join",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    r AS (SELECT a.vec_id AS query_key, b.vec_id AS neighbour_key, list_distance(a.x, b.x) AS distance,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
      FROM v a JOIN v b ON a.vec_id <> b.vec_id)
    SELECT query_key, neighbour_key, round(distance, 8) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 5""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = knn_join(vectors, vectors, 5, "vec_id", "vec_id", "embedding", "embedding", exclude_self=True)
    return rounded(found, 8, "distance")


@CHECKS.query("knn_join_approximate", "SELECT count(*) AS queries, true AS recall_from_90, true AS measured_below_10 FROM embeddings")
def _(spark, sf):
    """Recall at 5 against the exact join, all rows against all rows; these vectors have no clusters, so most cells are read by code."""
    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    named = ["vec_id", "vec_id", "embedding", "embedding"]
    exact = knn_join(vectors, vectors, 5, *named, exclude_self=True)
    found = approximate_knn_join(vectors, vectors, 5, *named, share=0.8, candidates=min(40, n // 11), exclude_self=True)
    return spark.createDataFrame([(n, recall(found, exact) >= 0.9, 40 < 0.1 * n)], "queries long, recall_from_90 boolean, measured_below_10 boolean")


@CHECKS.query(
    "knn_join_cells",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
    r AS (SELECT a.vec_id AS query_key, b.vec_id AS neighbour_key, list_distance(a.x, b.x) AS distance,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
      FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT query_key, neighbour_key, round(distance, 8) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 3""",
)
def _(spark, sf):
    """The way of large tables: several pivots, cells cut into small blocks."""
    vectors = table(spark, sf, "embeddings")
    found = knn_join(
        vectors, vectors, 3, "vec_id", "vec_id", "embedding", "embedding", within="label", exclude_self=True, block_rows=64, pivots=12
    )
    return rounded(found, 8, "distance")


@CHECKS.query(
    "knn_join_manhattan",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    d AS (SELECT a.vec_id AS query_key, b.vec_id AS neighbour_key, sum(abs(a.x - b.x)) AS distance
      FROM x a JOIN x b ON a.i = b.i AND a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY distance, neighbour_key) AS rank FROM d)
    SELECT query_key, neighbour_key, round(distance, 8) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 3""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = knn_join(
        vectors, vectors, 3, "vec_id", "vec_id", "embedding", "embedding",
        metric="manhattan", within="label", exclude_self=True,
    )
    return rounded(found, 8, "distance")


_BINARY = f"""WITH {LABELLED_SQL}, p AS (SELECT target AS label, (n_chars > 500)::INTEGER AS prediction FROM labelled),
  c AS (SELECT count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
    count_if(label = 1 AND prediction = 0) AS fn, count_if(label = prediction) AS ok, count(*) AS n FROM p)"""


@CHECKS.query(
    "classification_metrics",
    f"""{_BINARY} SELECT round(ok / n, 8) AS accuracy, round(tp / (tp + fp), 8) AS "precision", round(tp / (tp + fn), 8) AS recall,
      round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c""",
)
def _(spark, sf):
    predicted = labelled(spark, sf).withColumn("prediction", (F.col("n_chars") > 500).cast("int"))
    return rounded(classification_metrics(predicted, "target", "prediction"), 8, "accuracy", "precision", "recall", "f1")


@CHECKS.query(
    "classification_metrics_weighted",
    """WITH p AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, o_custkey % 3 AS prediction FROM orders),
    c AS (SELECT k, (SELECT count(*) FROM p WHERE label = k) AS support, (SELECT count(*) FROM p WHERE prediction = k) AS predicted,
      (SELECT count(*) FROM p WHERE label = k AND prediction = k) AS hits FROM (VALUES (0), (1), (2)) t(k))
    SELECT round(sum(hits) / sum(support), 8) AS accuracy, round(sum(hits / predicted * support) / sum(support), 8) AS "precision",
      round(sum(hits / support * support) / sum(support), 8) AS recall,
      round(sum(2 * hits / (predicted + support) * support) / sum(support), 8) AS f1 FROM c""",
)
def _(spark, sf):
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    predicted = table(spark, sf, "orders").select(label.alias("label"), (F.col("o_custkey") % 3).alias("prediction"))
    return rounded(classification_metrics(predicted, "label", "prediction"), 8, "accuracy", "precision", "recall", "f1")


_AREA = """(sum(CASE WHEN label = 1 THEN r + (t - 1) / 2.0 END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0)
  / (count_if(label = 1)::DOUBLE * count_if(label = 0))"""


@CHECKS.query(
    "roc_auc",
    f"""WITH {LABELLED_SQL}, r AS (SELECT target AS label, rank() OVER (ORDER BY n_chars) AS r,
      count(*) OVER (PARTITION BY n_chars) AS t FROM labelled) SELECT round({_AREA}, 8) AS roc_auc FROM r""",
)
def _(spark, sf):
    return rounded(roc_auc(labelled(spark, sf), "target", "n_chars"), 8, "roc_auc")


@CHECKS.query(
    "roc_auc_ovr",
    f"""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1) % 10 AS class FROM embeddings),
    s AS (SELECT vec_id, label AS y, class, round(sum(x), 6) AS score FROM e GROUP BY ALL),
    r AS (SELECT class, (y = class)::INTEGER AS label, rank() OVER (PARTITION BY class ORDER BY score) AS r,
      count(*) OVER (PARTITION BY class, score) AS t FROM s),
    a AS (SELECT class, {_AREA} AS area, count_if(label = 1) AS pos FROM r GROUP BY class)
    SELECT round(sum(area * pos) / sum(pos), 8) AS roc_auc FROM a""",
)
def _(spark, sf):
    # Ten scores of a vector: the sums of its numbers by place modulo ten.
    numbers = F.transform("embedding", lambda x, i: F.struct(x.cast("double").alias("x"), (i % 10).alias("c")))
    total = lambda c: F.round(F.aggregate(F.filter(numbers, lambda s: s["c"] == c), F.lit(0.0), lambda a, s: a + s["x"]), 6)
    scored = table(spark, sf, "embeddings").select("label", F.array(*[total(c) for c in range(10)]).alias("scores"))
    return rounded(roc_auc_ovr(scored, "label", "scores"), 8, "roc_auc")


@CHECKS.query(
    "regression_metrics",
    """WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - 2000 * l_quantity AS d FROM lineitem)
    SELECT round(avg(d * d), 1) AS mse, round(sqrt(avg(d * d)), 4) AS rmse, round(avg(abs(d)), 4) AS mae,
      round(1 - avg(d * d) / var_pop(y), 8) AS r2 FROM e""",
)
def _(spark, sf):
    predicted = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p")
    )
    scores = regression_metrics(predicted, "y", "p", ["mse", "root_mean_squared_error", "mae", "r2"])
    return rounded(rounded(rounded(scores, 1, "mse"), 4, "rmse", "mae"), 8, "r2")


@CHECKS.query(
    "train_ridge",
    """SELECT round(sxy / (sxx + 1000.0), 6) AS slope, round(my - sxy / (sxx + 1000.0) * mx, 3) AS intercept FROM (
      SELECT covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx,
        avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)""",
)
def _(spark, sf):
    source = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    ready = assemble(source, ["l_quantity"])
    predict = make_model("logistic_regression", "regression", {"alpha": 1000.0}).fit(ready)
    fitted = predict(ready).withColumn("x", vector_to_array("features")[0])
    return fitted.agg(
        F.round(F.regr_slope("prediction", "x"), 6).alias("slope"),
        F.round(F.regr_intercept("prediction", "x"), 3).alias("intercept"),
    )


@CHECKS.query(
    "train_knn",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label, {unit_sql('vec_id', 'split')} < 0.2 AS test FROM embeddings),
    r AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
      FROM v a JOIN v b ON a.test AND NOT b.test),
    n AS (SELECT vec_id, label, count(*) AS votes FROM r WHERE rank <= 5 GROUP BY ALL)
    SELECT vec_id, first(label ORDER BY votes DESC, label)::DOUBLE AS prediction FROM n GROUP BY vec_id""",
)
def _(spark, sf):
    split = train_test_split(table(spark, sf, "embeddings"), ["vec_id"])
    test, train = split.filter("split = 'test'"), split.filter("split = 'train'")
    found = knn_join(test, train, 5, "vec_id", "vec_id", "embedding", "embedding", carry="label")
    return knn_classify(found, "label", 10).select(F.col("query_key").alias("vec_id"), "prediction")


_RIDGE = """covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 5.0) AS w, avg(x) AS mx, avg(y) AS my"""


@CHECKS.query(
    "train_knn_regression",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label, {unit_sql('vec_id', 'split')} < 0.2 AS test FROM embeddings),
    d AS (SELECT a.vec_id, b.vec_id AS near, b.label, list_distance(a.x, b.x) AS distance FROM v a JOIN v b ON a.test AND NOT b.test),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, near) AS rank FROM d)
    SELECT vec_id, round(sum(label / distance) / sum(1 / distance), 8) AS prediction FROM r WHERE rank <= 7 GROUP BY vec_id""",
)
def _(spark, sf):
    split = train_test_split(table(spark, sf, "embeddings"), ["vec_id"])
    test, train = split.filter("split = 'test'"), split.filter("split = 'train'")
    found = knn_join(test, train, 7, "vec_id", "vec_id", "embedding", "embedding", carry="label")
    return rounded(knn_regress(found, "label", "distance").withColumnRenamed("query_key", "vec_id"), 8, "prediction")


def _words(spark, sf):
    """Length of a document from its number of words."""
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("row_key"),
        F.size(F.split("text", " ")).alias("n_words"),
        F.col("n_chars").cast("double").alias("label"),
    )
    return assemble(documents, ["n_words"])


_WORDS_SQL = "SELECT doc_id::VARCHAR AS row_key, len(string_split(text, ' '))::DOUBLE AS x, n_chars::DOUBLE AS y FROM documents"


@CHECKS.query(
    "predict_ridge",
    f"""WITH d AS ({_WORDS_SQL}), s AS (SELECT *, {unit_sql('row_key', 'split')} < 0.2 AS test FROM d),
    f AS (SELECT {_RIDGE} FROM s WHERE NOT test)
    SELECT row_key, y AS label, round(my + w * (x - mx), 4) AS prediction FROM s, f WHERE test""",
)
def _(spark, sf):
    split = train_test_split(_words(spark, sf), ["row_key"])
    predict = make_model("logistic_regression", "regression", {"alpha": 5.0}).fit(split.filter("split = 'train'"))
    predicted = predict(split.filter("split = 'test'"))
    return rounded(predicted.select("row_key", "label", "prediction"), 4, "prediction")


@CHECKS.query(
    "cross_val_score_ridge",
    f"""WITH d AS ({_WORDS_SQL}), k AS (SELECT *, (row_number() OVER (ORDER BY {hash_sql('row_key', 'fold')}, row_key) - 1) % 5 AS fold FROM d),
    f AS (SELECT t.fold, {_RIDGE} FROM (SELECT DISTINCT fold FROM k) t JOIN k ON k.fold <> t.fold GROUP BY t.fold),
    e AS (SELECT k.fold, sqrt(avg(pow(y - my - w * (x - mx), 2))) AS rmse FROM k JOIN f ON k.fold = f.fold GROUP BY k.fold)
    SELECT round(avg(rmse), 4) AS rmse FROM e""",
)
def _(spark, sf):
    data = _words(spark, sf).persist()
    score = cross_val_score(data, "logistic_regression", "regression", {"alpha": 5.0}, "rmse", "row_key", 5)
    data.unpersist()
    # The score is a number of the driver, as the operator returns it.
    return spark.createDataFrame([(score,)], "rmse double").select(F.round("rmse", 4).alias("rmse"))


def _quality(spark, sf):
    """Prepared quality data: a binary target with two classes of unequal size."""
    df = labelled(spark, sf)
    return prepare_data(df, "target", "doc_id", default_feature_plan(len(df.columns)), "classification")


def _statuses(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey", "o_orderpriority")
    return prepare_data(df, "o_orderstatus", "o_orderkey", default_feature_plan(4), "classification")


def _prices(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("key"),
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice",
    )
    return prepare_data(df, "l_extendedprice", "key", default_feature_plan(6), "regression")


_CLASS_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def _scores(spark, data, name, problem_type, metrics, params):
    """Train on the training rows, score the test rows: one row of metrics."""
    predict = make_model(name, problem_type, params).fit(data.train, data.classes, "row_key")
    found, _ = score_predictions(predict(data.test), problem_type, metrics)
    data.release()
    return spark.createDataFrame([(name, *found.values())], "model string, " + ", ".join(f"{m} double" for m in found))


@CHECKS.query("train_logistic_regression")
def _(spark, sf):
    return _scores(spark, _quality(spark, sf), "logistic_regression", "classification", _CLASS_METRICS, {})


@CHECKS.query("train_random_forest")
def _(spark, sf):
    return _scores(spark, _statuses(spark, sf), "random_forest", "classification", _CLASS_METRICS, {})


@CHECKS.query("train_random_forest_regression")
def _(spark, sf):
    return _scores(spark, _prices(spark, sf), "random_forest", "regression", ["rmse", "mae", "r2"], {})


@CHECKS.query("train_gradient_boosting")
def _(spark, sf):
    return _scores(spark, _statuses(spark, sf), "gradient_boosting", "classification", _CLASS_METRICS, {})


@CHECKS.query("train_gradient_boosting_softmax")
def _(spark, sf):
    return _scores(spark, _statuses(spark, sf), "gradient_boosting", "classification", _CLASS_METRICS, {"multi_class": "softmax"})


@CHECKS.query("train_xgboost")
def _(spark, sf):
    params = {"subsample": 0.8, "colsample_bytree": 0.8}
    return _scores(spark, _prices(spark, sf), "xgboost", "regression", ["rmse", "mae", "r2"], params)


@CHECKS.query("train_svm")
def _(spark, sf):
    return _scores(spark, _quality(spark, sf), "svm", "classification", _CLASS_METRICS, {})


@CHECKS.query("train_svm_regression")
def _(spark, sf):
    df = labelled(spark, sf).select("doc_id", "lang", "n_words", "n_lines", F.col("n_chars").alias("target"))
    data = prepare_data(df, "target", "doc_id", default_feature_plan(4), "regression")
    return _scores(spark, data, "svm", "regression", ["rmse", "mae", "r2"], {})


_GROUPED = """WITH g AS (SELECT (o_totalprice > 150000)::INTEGER AS x, (o_orderstatus = 'F')::INTEGER AS y, o_totalprice AS v FROM orders)"""


def _binary(spark, sf):
    """Orders with one feature of two values."""
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("row_key"), F.expr("cast(o_totalprice > 150000 as double)").alias("x"),
        F.expr("cast(o_orderstatus = 'F' as double)").alias("label"), "o_totalprice",
    )
    return assemble(df, ["x"]).withColumn("x", vector_to_array("features")[0].cast("int"))


def _by_value(predicted, value, digits):
    return rounded(predicted.groupBy("x").agg(F.max(value).alias("value"), F.count("*").alias("n")), digits, "value")


@CHECKS.query("train_logistic_one_feature", f"{_GROUPED} SELECT x, round(avg(y), 3) AS value, count(*) AS n FROM g GROUP BY x")
def _(spark, sf):
    """Without a penalty and with one feature of two values, the model gives each value its own share of ones."""
    df = _binary(spark, sf)
    predict = make_model("logistic_regression", "classification", {"C": 1e9}).fit(df, 2)
    return _by_value(predict(df), F.col("scores")[1], 3)


@CHECKS.query(
    "train_boosting_classes_one_round",
    f"{_GROUPED} SELECT x, round(1 / (1 + exp(-2 * avg(2 * y - 1))), 6) AS value, count(*) AS n FROM g GROUP BY x",
)
def _(spark, sf):
    """One round of one split fits the mean of labels -1 and 1; the score is its logistic at twice the margin."""
    df = _binary(spark, sf)
    params = {"n_estimators": 1, "max_depth": 1}
    return _by_value(make_model("gradient_boosting", "classification", params).fit(df, 2)(df), F.col("scores")[1], 6)


@CHECKS.query("train_boosting_one_round", f"{_GROUPED} SELECT x, round(avg(v), 2) AS value, count(*) AS n FROM g GROUP BY x")
def _(spark, sf):
    df = _binary(spark, sf).withColumn("label", F.col("o_totalprice"))
    params = {"n_estimators": 1, "max_depth": 1}
    return _by_value(make_model("gradient_boosting", "regression", params).fit(df)(df), "prediction", 2)


_PENALTY = """CASE WHEN s > 2000.0 THEN s - 2000.0 WHEN s < -2000.0 THEN s + 2000.0 ELSE 0 END"""


@CHECKS.query(
    "train_xgboost_one_round",
    f"""WITH g AS (SELECT l_quantity AS x, sum(l_extendedprice - m) AS s, count(*) AS n
      FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem) GROUP BY l_quantity),
    c AS (SELECT x, sum(s) OVER (ORDER BY x) AS ls, sum(n) OVER (ORDER BY x) AS ln, sum(s) OVER () AS ts, sum(n) OVER () AS tn FROM g),
    sides AS (SELECT x, ln, tn - ln AS rn, unnest([ls, ts - ls]) AS s, unnest([ln, tn - ln]) AS n, unnest(['left', 'right']) AS side FROM c WHERE ln < tn),
    soft AS (SELECT x, side, n, {_PENALTY} AS t FROM sides),
    best AS (SELECT x AS cut FROM soft GROUP BY x ORDER BY sum(t * t / (n + 50.0)) DESC, x LIMIT 1)
    SELECT cut::DOUBLE AS cut, side, n::BIGINT AS n,
      round((SELECT avg(l_extendedprice) FROM lineitem) + 0.3 * t / (n + 50.0), 4) AS prediction FROM soft, best WHERE x = cut""",
)
def _(spark, sf):
    """One round of one split: the cut that gains most under both penalties, and the leaves they shrink."""
    source = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    ready = assemble(source, ["l_quantity"])
    params = {"n_estimators": 1, "max_depth": 1, "reg_lambda": 50.0, "reg_alpha": 2000.0}
    predict = make_model("xgboost", "regression", params).fit(ready)
    leaves = predict(ready).withColumn("x", vector_to_array("features")[0]).groupBy("prediction").agg(F.max("x").alias("high"), F.count("*").alias("n"))
    found = leaves.withColumn("cut", F.expr("min(high) OVER ()")).withColumn("side", F.when(F.col("high") == F.col("cut"), "left").otherwise("right"))
    return rounded(found.select("cut", "side", "n", "prediction"), 4, "prediction")


@CHECKS.query(
    "train_xgboost_classes_one_round",
    f"""{_GROUPED}, s AS (SELECT x, sum(0.5 - y) AS g, 0.25 * count(*) AS h, count(*) AS n FROM g GROUP BY x),
    w AS (SELECT sum(g) AS g, sum(h) AS h FROM s),
    t AS (SELECT x, n, s.h + 2.0 AS h, sign(s.g) * greatest(abs(s.g) - 0.5, 0) AS t, w.h + 2.0 AS wh, sign(w.g) * greatest(abs(w.g) - 0.5, 0) AS wt FROM s, w),
    c AS (SELECT *, sum(t * t / h) OVER () > wt * wt / wh AS split FROM t)
    SELECT x, round(1 / (1 + exp(0.3 * CASE WHEN split THEN t / h ELSE wt / wh END)), 8) AS value, n FROM c""",
)
def _(spark, sf):
    """From equal odds: one split if it gains more than its penalties cost, else the step of the whole."""
    df = _binary(spark, sf)
    params = {"n_estimators": 1, "max_depth": 1, "reg_lambda": 2.0, "reg_alpha": 0.5}
    return _by_value(make_model("xgboost", "classification", params).fit(df, 2)(df), F.col("scores")[1], 8)


@CHECKS.query(
    "train_boosting_three_classes_one_round",
    """WITH d AS (SELECT (o_totalprice > 150000)::INTEGER AS x, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders),
    p AS (SELECT k, (SELECT avg((y = k)::INTEGER) FROM d) AS p FROM (VALUES (0), (1), (2)) t(k)),
    m AS (SELECT x, k, exp(ln(p) + 0.1 * 2 / 3 * sum((y = k)::INTEGER - p) / sum(p * (1 - p))) AS odds, count(*) AS n FROM d, p GROUP BY x, k, p)
    SELECT x, k AS class, round(odds / sum(odds) OVER (PARTITION BY x), 8) AS score, n FROM m""",
)
def _(spark, sf):
    """Each class has a tree of one split; a leaf is a Newton step of the multinomial loss from the classes' shares."""
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 0.0D WHEN 'O' THEN 1.0D ELSE 2.0D END")
    source = table(spark, sf, "orders").select(status.alias("label"), F.expr("cast(o_totalprice > 150000 as double)").alias("x"))
    df = assemble(source, ["x"]).withColumn("x", vector_to_array("features")[0].cast("int"))
    params = {"n_estimators": 1, "max_depth": 1, "multi_class": "softmax"}
    predicted = make_model("gradient_boosting", "classification", params).fit(df, 3)(df)
    scored = predicted.select("x", F.posexplode("scores").alias("class", "score"))
    return rounded(scored.groupBy("x", "class").agg(F.max("score").alias("score"), F.count("*").alias("n")), 8, "score")


@CHECKS.query(
    "prepare_data_stratified",
    """WITH n AS (SELECT dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS label, count(*) AS n FROM orders GROUP BY o_orderstatus)
    SELECT 'test' AS side, label::DOUBLE AS label, round(n * 0.2)::BIGINT AS n FROM n
    UNION ALL SELECT 'train', label::DOUBLE, n - round(n * 0.2)::BIGINT FROM n""",
)
def _(spark, sf):
    data = _statuses(spark, sf)
    sides = data.train.withColumn("side", F.lit("train")).unionByName(data.test.withColumn("side", F.lit("test")))
    return sides.groupBy("side", "label").agg(F.count("*").alias("n"))


@CHECKS.query(
    "prepare_data_clashing_names",
    """SELECT count(*) AS n, count(CASE WHEN event_id % 11 <> 0 THEN value END) AS labelled, 5 AS n_features FROM events""",
)
def _(spark, sf):
    """Features named like the columns that the preparation works with, and a target with NULL and NaN."""
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.expr("CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END").alias("target"),
        F.col("value").alias("value"), F.expr("user_id % 7").alias("code"), F.expr("user_id % 5").alias("label"),
        F.expr("user_id % 3").alias("split"), F.expr("cast(user_id % 2 as double)").alias("row_key"),
    )
    plan = {"preprocessing_steps": [{"step": "scaling", "method": "standard", "columns": "numeric"}]}
    data = prepare_data(events, "target", "id", plan, "regression")
    whole = data.train.unionByName(data.test)
    width = F.max(F.size(vector_to_array("features"))).alias("n_features")
    return whole.agg(F.count("*").alias("labelled"), width).withColumn("n", F.lit(events.count()).cast("long"))


@CHECKS.query("predict")
def _(spark, sf):
    data = _statuses(spark, sf)
    predict = make_model("logistic_regression", "classification").fit(data.train, data.classes)
    return predict(data.test).select("row_key", "label", "prediction", "scores")


def _run_rows(runs):
    return runs.select(
        "experiment_id", "run_id", "model_name", "stage", "iteration", "seq",
        F.to_json("metrics").alias("metrics"), F.to_json("parameters").alias("parameters"), "error",
    )


@CHECKS.query("train_candidates")
def _(spark, sf):
    data = _quality(spark, sf)
    # The unknown model shows that a failing candidate is recorded and the others go on.
    models = ["logistic_regression", "random_forest", "no_such_model"]
    records = train_candidates(
        data.train, data.test, models, "classification", ["f1", "roc_auc", "accuracy"], "row_key", classes=2
    )
    data.release()
    return _run_rows(runs_frame(spark, records, "quality"))


@CHECKS.query("cross_val_score")
def _(spark, sf):
    data = _quality(spark, sf)
    rows = [
        (i, float(p["C"]), cross_val_score(data.train, "logistic_regression", "classification", p, "f1", "row_key"))
        for i, p in enumerate(search_space("logistic_regression", 2))
    ]
    data.release()
    return spark.createDataFrame(rows, "trial int, C double, score double")


@CHECKS.query("tune")
def _(spark, sf):
    data = _quality(spark, sf)
    record = tune(
        data.train, data.test, "logistic_regression", "classification", "f1", ["f1", "roc_auc", "accuracy"],
        "row_key", n_trials=5, classes=data.classes,
    )
    data.release()
    return _run_rows(runs_frame(spark, [record], "quality"))


@CHECKS.query("run_experiment")
def _(spark, sf):
    """Rankings of the whole loop on document quality: baselines, tuning of the best, report."""
    outcome = run_experiment(
        spark,
        "Predict whether a document is of good quality",
        "quality",
        {"quality": lambda session: labelled(session, sf)},
        key="doc_id",
        plan={"models": ["logistic_regression", "svm"]},
        n_trials=2,
    )
    if outcome.status != "completed":
        raise RuntimeError(outcome.report)
    ranked = _run_rows(outcome.rankings).join(outcome.rankings.select("run_id", "rank"), "run_id")
    return ranked.withColumn("report", F.lit(outcome.report))
