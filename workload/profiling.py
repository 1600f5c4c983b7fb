"""Profiles of whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabulark.operators.profile import (
    class_distribution,
    dataset_profile,
    describe_numeric,
    missing_by_column,
    profile,
    top_correlations,
    total_missing_pct,
)
from tabulark.operators.quantiles import exact_quantiles
from workload.common import Checks, rounded, table

CHECKS = Checks()

LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)
ORDERS_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


def describe_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25,
        round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75,
        round(max({c})::DOUBLE, 4) AS max FROM {source}"""
        for c in columns
    )


def correlation_sql(source: str, columns) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(abs(corr({a}, {b})), 8) AS correlation FROM {source}"
        for a, b in combinations(columns, 2)
    )
    return f"SELECT * FROM ({pairs}) ORDER BY correlation DESC NULLS LAST, col_a, col_b LIMIT 10"


_GAPS = """(SELECT event_id, ts, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"""


def events_with_gaps(spark, sf):
    nan = F.lit(float("nan"))
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.expr("CASE WHEN event_id % 5 <> 0 THEN event_type END").alias("event_type"),
        F.when(F.expr("event_id % 11 = 0"), nan).when(F.expr("event_id % 7 <> 0"), F.col("value")).alias("value"),
    )


@CHECKS.query(
    "missing_by_column",
    f"""WITH g AS {_GAPS}, m AS (
      SELECT count(*) AS n, count_if(event_type IS NULL) AS a, count_if(value IS NULL OR isnan(value)) AS b FROM g)
    SELECT 'event_type' AS "column", a::BIGINT AS missing, round(100.0 * a / n, 6) AS percent FROM m
    UNION ALL SELECT 'value', b::BIGINT, round(100.0 * b / n, 6) FROM m""",
)
def _(spark, sf):
    return rounded(missing_by_column(events_with_gaps(spark, sf)), 6, "percent")


@CHECKS.query(
    "total_missing_pct",
    f"""WITH g AS {_GAPS}
    SELECT round(100.0 * (count_if(event_type IS NULL) + count_if(value IS NULL OR isnan(value))) / (4 * count(*)), 6)
      AS total_missing_pct FROM g""",
)
def _(spark, sf):
    return rounded(total_missing_pct(events_with_gaps(spark, sf)), 6, "total_missing_pct")


@CHECKS.query(
    "class_distribution",
    'SELECT o_orderstatus AS "class", count(*) AS count FROM orders GROUP BY o_orderstatus',
)
def _(spark, sf):
    return class_distribution(table(spark, sf, "orders"), "o_orderstatus")


@CHECKS.query("describe_numeric", describe_sql("lineitem", LINEITEM_NUMBERS))
def _(spark, sf):
    described = describe_numeric(table(spark, sf, "lineitem"))
    return rounded(described, 4, "mean", "std", "min", "p25", "p50", "p75", "max")


@CHECKS.query(
    "quantiles_bracketed",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(quantile_cont({c}::DOUBLE, 0.05), 6) AS p05, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
        round(quantile_cont({c}::DOUBLE, 0.99), 6) AS p99 FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_partkey")
    ),
)
def _(spark, sf):
    """The way of large tables: a sketch, then exact counts inside its brackets."""
    names = ["l_quantity", "l_extendedprice", "l_partkey"]
    found = exact_quantiles(table(spark, sf, "lineitem"), names, [0.05, 0.5, 0.99], max_buffer_cells=0)
    rows = spark.createDataFrame([(c, *found[c]) for c in names], "column string, p05 double, p50 double, p99 double")
    return rounded(rows, 6, "p05", "p50", "p99")


@CHECKS.query(
    "top_correlations_gaps",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    g AS (SELECT vec_id, i, x FROM x WHERE (vec_id * 7 + i * 3) % 11 <> 0)
    SELECT 'e' || a.i AS col_a, 'e' || b.i AS col_b, round(abs(corr(a.x, b.x)), 8) AS correlation
    FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i ORDER BY correlation DESC, col_a, col_b LIMIT 10""",
)
def _(spark, sf):
    numbers = [F.expr(f"CASE WHEN (vec_id * 7 + {i} * 3) % 11 <> 0 THEN cast(embedding[{i}] as double) END").alias(f"e{i}") for i in range(64)]
    return rounded(top_correlations(table(spark, sf, "embeddings").select(*numbers)), 8, "correlation")


@CHECKS.query("top_correlations", correlation_sql("lineitem", LINEITEM_NUMBERS))
def _(spark, sf):
    return rounded(top_correlations(table(spark, sf, "lineitem")), 8, "correlation")


@CHECKS.query(
    "dataset_profile",
    """SELECT count(*) AS n_rows, 5::BIGINT AS n_cols,
      'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns,
      'c_custkey,c_nationkey,c_acctbal' AS numeric_columns, 'c_name,c_mktsegment' AS categorical_columns,
      'c_custkey=bigint,c_name=string,c_nationkey=int,c_acctbal=double,c_mktsegment=string' AS feature_types,
      100.0::DOUBLE * (5 * count(*) - count(c_custkey) - count(c_name) - count(c_nationkey) - count(c_acctbal)
        - count(c_mktsegment)) / (5 * count(*)) AS total_missing_pct,
      'c_mktsegment' AS target_column
    FROM customer""",
)
def _(spark, sf):
    header = dataset_profile(table(spark, sf, "customer"), "c_mktsegment")
    types = F.transform(F.map_entries("feature_types"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return header.withColumns(
        {
            **{c: F.array_join(c, ",") for c in ("columns", "numeric_columns", "categorical_columns")},
            "feature_types": F.array_join(types, ","),
        }
    )


def _profile_sql() -> str:
    numbers = ORDERS_NUMBERS
    statistics = describe_sql("orders", numbers)
    items = ("mean", "std", "min", "p25", "p50", "p75", "max")
    unpivoted = " UNION ALL ".join(
        [f"""SELECT 'statistics', "column", 'count', count::DOUBLE FROM d"""]
        + [f"""SELECT 'statistics', "column", '{i}', {i} FROM d""" for i in items]
    )
    return f"""WITH d AS ({statistics}), c AS ({correlation_sql('orders', numbers)})
    SELECT 'table' AS section, 'rows' AS name, NULL::VARCHAR AS item, count(*)::DOUBLE AS value FROM orders
    UNION ALL SELECT 'table', 'columns', NULL, 6.0::DOUBLE
    UNION ALL SELECT 'table', 'missing_pct', NULL, 100.0::DOUBLE * (6 * count(*) - count(o_orderkey) - count(o_custkey)
      - count(o_orderstatus) - count(o_totalprice) - count(o_orderdate) - count(o_orderpriority)) / (6 * count(*)) FROM orders
    UNION ALL SELECT 'class', 'o_orderstatus', o_orderstatus, count(*)::DOUBLE FROM orders GROUP BY o_orderstatus
    UNION ALL {unpivoted}
    UNION ALL SELECT 'correlation', col_a, col_b, round(correlation, 8) FROM c"""


@CHECKS.query("profile_job", _profile_sql())
def _(spark, sf):
    whole = profile(table(spark, sf, "orders"), "o_orderstatus")
    digits = F.when(F.col("section") == "correlation", F.round("value", 8)).otherwise(F.round("value", 4))
    return whole.withColumn("value", digits)
