"""Feature preparation, splits and oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.functions.columns import numeric_columns
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
    select_k_best,
    slot_scores,
    take_features,
)
from tabulark.operators.sampling import oversample_random, oversample_smote
from tabulark.operators.split import kfold, train_test_split
from workload.common import Checks, hash_sql, rounded, table, unit_sql
from workload.profiling import events_with_gaps

CHECKS = Checks()

_GAP_VALUE = "CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN value END"


@CHECKS.query(
    "encode_target",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END::BIGINT AS o_orderstatus
    FROM orders""",
)
def _(spark, sf):
    return encode_target(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@CHECKS.query(
    "custom_transform",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_extendedprice / l_quantity AS unit_price FROM lineitem",
)
def _(spark, sf):
    source = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    result, error = custom_transform(
        source, lambda df: df.withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity"))
    )
    if error:
        raise RuntimeError(error)
    return result


@CHECKS.query(
    "custom_transform_error",
    "SELECT p_partkey, p_name, p_size, p_retailprice, true AS failed FROM part",
)
def _(spark, sf):
    source = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    # The plan is valid; it fails on the first row it reads.
    result, error = custom_transform(
        source, lambda df: df.withColumn("bad", F.raise_error(F.concat(F.lit("no rule for "), F.col("p_name"))))
    )
    return result.withColumn("failed", F.lit(error is not None and "no rule for" in error))


@CHECKS.query(
    "interaction_feature",
    "SELECT p_partkey, p_size, p_retailprice, (p_partkey * p_size)::BIGINT AS custom_interaction FROM part",
)
def _(spark, sf):
    return interaction_feature(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"))


for _method, _aggregate in (("mean", "avg(v)"), ("median", "quantile_cont(v, 0.5)")):

    def _impute(spark, sf, method=_method):
        events = events_with_gaps(spark, sf).select("event_id", "value")
        return rounded(fit_impute_numeric(events, ["value"], method).apply(events), 6, "value")

    CHECKS.query(
        f"impute_{_method}",
        f"""WITH e AS (SELECT event_id, {_GAP_VALUE} AS v FROM events)
        SELECT event_id, round(coalesce(v, (SELECT {_aggregate} FROM e)), 6) AS value FROM e""",
    )(_impute)


@CHECKS.query(
    "impute_mode",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p FROM orders),
    m AS (SELECT p FROM o WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
    SELECT o_orderkey, coalesce(p, (SELECT p FROM m)) AS o_orderpriority, 'unknown' AS nothing FROM o""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END").alias("o_orderpriority"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return fit_impute_mode(orders, ["o_orderpriority", "nothing"]).apply(orders)


_LINE_KEYS = ("l_orderkey", "l_partkey", "l_linenumber")


@CHECKS.query(
    "scale_standard",
    """SELECT l_orderkey, l_partkey, l_linenumber, round((l_quantity - aq) / sq, 6) AS l_quantity,
      round((l_extendedprice - ap) / sp, 6) AS l_extendedprice, 0.0::DOUBLE AS konst
    FROM lineitem, (SELECT avg(l_quantity) AS aq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS ap,
      stddev_pop(l_extendedprice) AS sp FROM lineitem)""",
)
def _(spark, sf):
    source = table(spark, sf, "lineitem").select(*_LINE_KEYS, "l_quantity", "l_extendedprice", F.lit(1.0).alias("konst"))
    columns = ["l_quantity", "l_extendedprice", "konst"]
    return rounded(fit_scale(source, columns, "standard").apply(source), 6, *columns)


@CHECKS.query(
    "scale_minmax",
    """SELECT p_partkey, round((p_size - ls)::DOUBLE / (hs - ls), 8) AS p_size,
      round((p_retailprice - lp) / (hp - lp), 8) AS p_retailprice, 0.0::DOUBLE AS konst
    FROM part, (SELECT min(p_size) AS ls, max(p_size) AS hs, min(p_retailprice) AS lp, max(p_retailprice) AS hp FROM part)""",
)
def _(spark, sf):
    source = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(7.0).alias("konst"))
    columns = ["p_size", "p_retailprice", "konst"]
    return rounded(fit_scale(source, columns, "minmax").apply(source), 8, *columns)


@CHECKS.query(
    "scale_robust",
    """SELECT o_orderkey, round((o_totalprice - m) / (h - l), 6) AS o_totalprice, 0.0::DOUBLE AS konst
    FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS l, quantile_cont(o_totalprice, 0.5) AS m,
      quantile_cont(o_totalprice, 0.75) AS h FROM orders)""",
)
def _(spark, sf):
    source = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(7.0).alias("konst"))
    return rounded(fit_scale(source, ["o_totalprice", "konst"], "robust").apply(source), 6, "o_totalprice", "konst")


_PRIORITIES = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@CHECKS.query(
    "encode_onehot",
    "SELECT o_orderkey, "
    + ", ".join(f"(o_orderstatus = '{v}')::INTEGER::DOUBLE AS \"o_orderstatus_{v}\"" for v in ("O", "P"))
    + ", "
    + ", ".join(
        f"coalesce(o_orderkey % 5 <> 0 AND o_orderpriority = '{v}', false)::INTEGER::DOUBLE AS \"o_orderpriority_{v}\""
        for v in _PRIORITIES
    )
    + " FROM orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END").alias("o_orderpriority"),
    )
    return fit_encode_onehot(orders, ["o_orderstatus", "o_orderpriority"]).apply(orders)


@CHECKS.query(
    "encode_label",
    """WITH c AS (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, 'None') AS v FROM customer)
    SELECT c_custkey, dense_rank() OVER (ORDER BY v) - 1 AS c_mktsegment FROM c""",
)
def _(spark, sf):
    customer = table(spark, sf, "customer").select(
        "c_custkey", F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END").alias("c_mktsegment")
    )
    return fit_encode_label(customer, ["c_mktsegment"]).apply(customer)


@CHECKS.query(
    "fill_remaining",
    f"""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type ELSE '0' END AS event_type,
      coalesce({_GAP_VALUE}, 0) AS value FROM events""",
)
def _(spark, sf):
    return fill_remaining(events_with_gaps(spark, sf).drop("ts"))


_CANDIDATES = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _selection(scores, chosen):
    return rounded(scores.select("feature", "score"), 6, "score").withColumn("selected", F.col("feature").isin(chosen))


def _selection_sql(rows: str) -> str:
    return f"""WITH scores AS ({rows})
    SELECT feature, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, position DESC) <= 3 AS selected FROM scores"""


@CHECKS.query(
    "select_k_best_f_classif",
    _selection_sql(
        " UNION ALL ".join(
            f"""SELECT {i} AS position, '{f}' AS feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1))
              / (sum(v * n) / (sum(n) - count(*))) AS score
            FROM (SELECT count(*) AS n, avg({f}) AS m, var_pop({f}) AS v, any_value(g) AS g
              FROM lineitem, (SELECT avg({f}) AS g FROM lineitem) GROUP BY l_returnflag)"""
            for i, f in enumerate(_CANDIDATES)
        )
    ),
)
def _(spark, sf):
    source = table(spark, sf, "lineitem").select(*_CANDIDATES, "l_returnflag")
    chosen = select_k_best(source, _CANDIDATES, "l_returnflag", 3)
    return _selection(f_classif(source, _CANDIDATES, "l_returnflag"), chosen)


_PREDICTORS = ("l_linenumber", "l_quantity", "l_discount", "l_tax")


@CHECKS.query(
    "select_k_best_f_regression",
    _selection_sql(
        " UNION ALL ".join(
            f"""SELECT {i} AS position, '{f}' AS feature,
              pow(corr({f}, l_extendedprice), 2) / (1 - pow(corr({f}, l_extendedprice), 2)) * (count(*) - 2) AS score FROM lineitem"""
            for i, f in enumerate(_PREDICTORS)
        )
    ),
)
def _(spark, sf):
    source = table(spark, sf, "lineitem").select(*_PREDICTORS, "l_extendedprice")
    chosen = select_k_best(source, _PREDICTORS, "l_extendedprice", 3, classification=False)
    return _selection(f_regression(source, _PREDICTORS, "l_extendedprice"), chosen)


@CHECKS.query(
    "pca",
    """WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS a, l_discount * 100 AS b FROM lineitem),
    m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS saa, var_samp(b) AS sbb, covar_samp(a, b) AS sab FROM x),
    e AS (SELECT *, (saa + sbb + sqrt(pow(saa - sbb, 2) + 4 * sab * sab)) / 2 AS l1 FROM m),
    -- first axis (l1 - sbb, sab), second axis at a right angle; the largest loading is positive
    d AS (SELECT *, sqrt(pow(l1 - sbb, 2) + sab * sab) AS len, l1 - sbb AS u, sab AS w FROM e)
    SELECT l_orderkey, l_partkey, l_linenumber,
      round(((a - ma) * u + (b - mb) * w) / len * CASE WHEN abs(u) >= abs(w) THEN sign(u) ELSE sign(w) END, 6) AS "0",
      round(((b - mb) * u - (a - ma) * w) / len * CASE WHEN abs(u) >= abs(w) THEN sign(u) ELSE -sign(w) END, 6) AS "1"
    FROM x, d""",
)
def _(spark, sf):
    source = table(spark, sf, "lineitem").select(
        *_LINE_KEYS, F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b")
    )
    return rounded(fit_pca(source, ["a", "b"], 2).apply(source), 6, "0", "1")


@CHECKS.query("pca_embeddings")
def _(spark, sf):
    embeddings = table(spark, sf, "embeddings")
    wide = embeddings.select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    return fit_pca(wide, [f"e{i}" for i in range(64)], 8).apply(wide)


@CHECKS.query(
    "train_test_split",
    f"""SELECT c_custkey, c_mktsegment,
      CASE WHEN {unit_sql('c_custkey', 'split')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM customer""",
)
def _(spark, sf):
    return train_test_split(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])


@CHECKS.query(
    "train_test_split_exact",
    f"""WITH r AS (SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n,
      row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hash_sql('c_custkey', 'split')}, c_custkey) AS rn FROM customer)
    SELECT c_custkey, c_mktsegment, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def _(spark, sf):
    source = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return train_test_split(source, ["c_custkey"], stratify="c_mktsegment", exact=True)


@CHECKS.query(
    "kfold",
    f"""SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment
      ORDER BY {hash_sql('c_custkey', 'fold')}, c_custkey) - 1) % 5)::INTEGER AS fold FROM customer""",
)
def _(spark, sf):
    source = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return kfold(source, ["c_custkey"], 5, stratify="c_mktsegment")


@CHECKS.query(
    "oversample_random",
    f"""WITH r AS (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n,
      row_number() OVER (PARTITION BY quality ORDER BY {hash_sql('doc_id', 'oversample')}, doc_id) AS rn FROM labels),
    d AS (SELECT *, (SELECT max(n) FROM r) - n AS need FROM r)
    SELECT doc_id, quality, unnest(range(0, need // n + (rn <= need % n)::INTEGER + 1)) AS copy FROM d""",
)
def _(spark, sf):
    return oversample_random(table(spark, sf, "labels").select("doc_id", "quality"), "quality", ["doc_id"])


@CHECKS.query(
    "oversample_smote",
    f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, count(*) OVER (PARTITION BY label) AS n,
        row_number() OVER (PARTITION BY label ORDER BY {hash_sql('vec_id', 'smote')}, vec_id) AS rn FROM embeddings),
    d AS (SELECT *, (SELECT max(n) FROM v) - n AS need FROM v),
    pairs AS (SELECT a.vec_id, b.x AS y, row_number() OVER (PARTITION BY a.vec_id
        ORDER BY list_distance(a.x, b.x), b.vec_id) AS nn FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
    draws AS (SELECT vec_id, label, x, unnest(range(1, need // n + (rn <= need % n)::INTEGER + 1)) AS draw FROM d),
    s AS (SELECT *, md5(vec_id || ':' || draw || ':smote:42') AS h FROM draws)
    SELECT vec_id, label, 0::BIGINT AS draw, unnest(range(0, 64))::INTEGER AS place, round(unnest(x), 6) AS value FROM v
    UNION ALL
    SELECT s.vec_id, label, draw, unnest(range(0, 64))::INTEGER AS place,
      round(unnest(list_transform(list_zip(x, y), lambda p: p[1] + ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0 * (p[2] - p[1]))), 6)
    FROM s JOIN pairs p ON s.vec_id = p.vec_id AND nn = ('0x' || substr(h, 1, 8))::BIGINT % 5 + 1""",
)
def _(spark, sf):
    grown = oversample_smote(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return rounded(grown.select("vec_id", "label", "draw", F.posexplode("embedding").alias("place", "value")), 6, "value")


@CHECKS.query(
    "preprocess",
    """WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, (l_linestatus = 'O')::INTEGER AS label,
        CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS q, l_extendedprice AS p, l_returnflag AS f FROM lineitem),
    y AS (SELECT *, coalesce(q, (SELECT quantile_cont(q, 0.5) FROM x)) AS filled FROM x),
    m AS (SELECT avg(filled) AS aq, stddev_pop(filled) AS sq, avg(p) AS ap, stddev_pop(p) AS sp FROM y)
    SELECT l_orderkey, l_partkey, l_linenumber, label, round((filled - aq) / sq, 6) AS l_quantity,
      round((p - ap) / sp, 6) AS l_extendedprice, (f = 'N')::INTEGER::DOUBLE AS "l_returnflag_N",
      (f = 'R')::INTEGER::DOUBLE AS "l_returnflag_R" FROM y, m""",
)
def _(spark, sf):
    source = table(spark, sf, "lineitem").select(
        *_LINE_KEYS,
        F.expr("CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END").alias("label"),
        F.expr("CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END").alias("l_quantity"),
        "l_extendedprice",
        "l_returnflag",
    )
    steps = [
        {"step": "imputation", "method": "median", "columns": "numeric"},
        {"step": "scaling", "method": "standard", "columns": "numeric"},
        {"step": "encoding", "method": "onehot", "columns": "categorical"},
    ]
    ready = preprocess(source, "label", {"preprocessing_steps": steps}, True, keep=_LINE_KEYS)
    names = [*(f for f in ready.features if f not in ready.slots), *(n for slots in ready.slots.values() for n in slots)]
    shown = take_features(ready.train, ready.features, names, ready.slots, [*_LINE_KEYS, "label"])
    return rounded(shown, 6, "l_quantity", "l_extendedprice")


@CHECKS.query(
    "encode_onehot_wide",
    """SELECT c_custkey, nullif(dense_rank() OVER (ORDER BY c_name) - 2, -1)::BIGINT AS slot FROM customer""",
)
def _(spark, sf):
    source = table(spark, sf, "customer").select("c_custkey", "c_name")
    vectors = fit_encode_onehot(source, ["c_name"], expand=False).apply(source)
    # The place of the one in the sparse vector; as an array each row would have a number for every name.
    slot = F.get(F.unwrap_udt("c_name")["indices"], F.lit(0))
    return vectors.select("c_custkey", slot.cast("long").alias("slot"))


_SLOTS = """
WITH p AS (SELECT p_size % 3 AS y, p_retailprice AS price, p_name, p_brand FROM part),
v AS (SELECT 0 AS k, p_name AS value, y, price FROM p UNION ALL SELECT 1, p_brand, y, price FROM p),
s AS (SELECT DISTINCT k, value FROM v), first AS (SELECT k, min(value) AS value FROM s GROUP BY k),
n AS (SELECT y, count(*)::DOUBLE AS n_c FROM p GROUP BY y), t AS (SELECT sum(n_c) AS n, count(*) AS c FROM n),
m AS (SELECT s.k, s.value, n.y, n_c, count(v.y) / n_c AS share FROM s CROSS JOIN n LEFT JOIN v ON v.k = s.k AND v.value = s.value AND v.y = n.y GROUP BY s.k, s.value, n.y, n_c),
f AS (
  SELECT k, value, sum(n_c * (share - p) * (share - p)) / (any_value(c) - 1) / nullif(sum(n_c * share * (1 - share)) / (any_value(n) - any_value(c)), 0) AS score
  FROM (SELECT m.*, n, c, sum(n_c * share) OVER (PARTITION BY k, value) / n AS p FROM m, t) GROUP BY k, value)
"""


@CHECKS.query(
    "onehot_slot_scores",
    _SLOTS
    + """SELECT CASE f.k WHEN 0 THEN 'p_name' ELSE 'p_brand' END AS feature, f.value, round(score, 6) AS score
    FROM f JOIN first ON f.k = first.k AND f.value <> first.value""",
)
def _(spark, sf):
    """Scores of all slots of two text columns, one of them with a value for nearly every row, without a name on the driver."""
    source = table(spark, sf, "part").withColumn("y", F.col("p_size") % 3)
    scores = slot_scores(source, ["p_name", "p_brand"], "y")
    feature = F.when(F.col("k") == 0, "p_name").otherwise("p_brand")
    return rounded(scores.select(feature.alias("feature"), "value", "score"), 6, "score")


@CHECKS.query(
    "onehot_slot_scores_regression",
    """WITH v AS (SELECT p_name AS value, p_retailprice AS y FROM part), a AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, stddev_pop(y) AS sy FROM v),
    s AS (SELECT value, count(*) / any_value(n) AS p, (avg(y) - any_value(my)) AS off, any_value(n) AS n, any_value(sy) AS sy FROM v, a GROUP BY value),
    r AS (SELECT value, n, p * p * off * off / (p * (1 - p) * sy * sy) AS r2 FROM s)
    SELECT value, round(r2 / (1 - r2) * (n - 2), 6) AS score FROM r WHERE value <> (SELECT min(value) FROM v)""",
)
def _(spark, sf):
    scores = slot_scores(table(spark, sf, "part"), ["p_name"], "p_retailprice", classification=False)
    return rounded(scores.select("value", "score"), 6, "score")


@CHECKS.query(
    "select_k_best_wide",
    """WITH c AS (SELECT c_name, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS m, count(*) OVER () AS n,
        row_number() OVER (ORDER BY c_name) AS no FROM customer),
    k AS (SELECT count(DISTINCT c_mktsegment) AS k FROM customer)
    -- one row has the slot, so the sums of squares are 1 / m between and 1 - 1 / m within
    SELECT 'c_name_' || c_name AS feature, round(((1.0 / m - 1.0 / n) / (k - 1)) / ((1 - 1.0 / m) / (n - k)), 6) AS score
    FROM c, k WHERE no > 1""",
)
def _(spark, sf):
    source = table(spark, sf, "customer").select("c_name", "c_mktsegment")
    fitted = fit_encode_onehot(source, ["c_name"], expand=False)
    scores = f_classif(fitted.apply(source), ["c_name"], "c_mktsegment", fitted.params["slots"])
    return rounded(scores.select("feature", "score"), 6, "score")


@CHECKS.query(
    "encode_label_clashing_names",
    """SELECT event_id, value, (user_id % 7)::INTEGER AS code, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type FROM events""",
)
def _(spark, sf):
    source = table(spark, sf, "events").select("event_id", "value", F.expr("cast(user_id % 7 as int)").alias("code"), "event_type")
    return fit_encode_label(source, ["event_type"]).apply(source).select("event_id", "value", "code", "event_type")


@CHECKS.query(
    "encode_label_unseen",
    """WITH seen AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events WHERE user_id % 2 = 0 AND event_type < 'p'
        GROUP BY event_type)
    SELECT event_id, coalesce(code, (SELECT count(*) FROM seen)) AS event_type FROM events LEFT JOIN seen USING (event_type)""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    fitted = fit_encode_label(events.filter("user_id % 2 = 0 and event_type < 'p'"), ["event_type"])
    return fitted.apply(events.select("event_id", "event_type")).select("event_id", "event_type")


@CHECKS.query(
    "encode_label_texts",
    "SELECT doc_id, dense_rank() OVER (ORDER BY text) - 1 AS text FROM documents",
)
def _(spark, sf):
    source = table(spark, sf, "documents").select("doc_id", "text")
    return fit_encode_label(source, ["text"]).apply(source).select("doc_id", "text")


@CHECKS.query(
    "custom_transform_hides_the_label",
    """SELECT o_orderkey, label, o_totalprice, round(o_totalprice - avg(o_totalprice) OVER (), 4) AS centred, 1 AS n_numeric
    FROM (SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS label, o_totalprice FROM orders)""",
)
def _(spark, sf):
    source = table(spark, sf, "orders").select("o_orderkey", F.expr("cast(o_orderstatus = 'F' as int)").alias("label"), "o_totalprice")

    def transform(features):
        mean = features.agg(F.avg("o_totalprice")).first()[0]
        seen = F.lit(len(numeric_columns(features)))
        return features.withColumn("centred", F.col("o_totalprice") - mean).withColumn("n_numeric", seen)

    changed, error = custom_transform(source, transform, hidden=["o_orderkey", "label"])
    if error:
        raise RuntimeError(error)
    return rounded(changed, 4, "centred")


@CHECKS.query(
    "kfold_ranges",
    f"""SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment
      ORDER BY {hash_sql('c_custkey', 'fold')}, c_custkey) - 1) % 5)::INTEGER AS fold FROM customer""",
)
def _(spark, sf):
    """The way of large classes: cut into hash ranges that are numbered by themselves."""
    source = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return kfold(source, ["c_custkey"], 5, stratify="c_mktsegment", hot_rows=20)


@CHECKS.query(
    "pca_all_components",
    """WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    v AS (SELECT i, var_samp(x) AS v FROM x GROUP BY i)
    SELECT round(sum(v), 6) AS variance, 0.0::DOUBLE AS covariance, true AS falling FROM v""",
)
def _(spark, sf):
    """All components together have the variance of the table, have none in common, and come in falling order."""
    names = [f"e{i}" for i in range(64)]
    wide = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    projected = fit_pca(wide, names, 64).apply(wide)
    own = [F.var_samp(f"`{j}`") for j in range(64)]
    shared = [F.abs(F.covar_samp("`0`", f"`{j}`")) for j in range(1, 64)]
    row = projected.agg(F.array(*own).alias("own"), F.greatest(*shared).alias("shared"))
    total = F.round(F.aggregate("own", F.lit(0.0), lambda a, v: a + v), 6)
    falling = F.forall(F.sequence(F.lit(1), F.lit(63)), lambda j: F.get("own", j - 1) >= F.get("own", j) - 1e-9)
    return row.select(total.alias("variance"), F.round("shared", 6).alias("covariance"), falling.alias("falling"))


@CHECKS.query(
    "kfold_seven",
    f"""SELECT c_custkey, ((row_number() OVER (ORDER BY {hash_sql('c_custkey', 'fold')}, c_custkey) - 1) % 7)::INTEGER AS fold FROM customer""",
)
def _(spark, sf):
    return kfold(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 7)
