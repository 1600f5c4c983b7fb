"""Registration, table access and the inputs derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.functions.text import llm_cost

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    name: str
    run: Run
    sql: str | None


class Checks(list):
    """Collects the queries of a module."""

    def query(self, name: str, sql: str | None = None):
        def register(run: Run) -> Run:
            self.append(Check(name, run, sql))
            return run

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Runs: one per event. Errors and absent metrics are spread over the experiments.
_STAGE = "CASE WHEN event_id % 5 = 4 THEN 'hpo' WHEN event_id % 3 = 0 THEN 'initial' ELSE 'replan' END"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f1 = F.when(F.expr("event_id % 17 <> 0"), F.expr("(value % 100) / 100"))
    metrics = F.map_filter(F.create_map(F.lit("f1"), f1, F.lit("rmse"), F.col("value")), lambda _, v: v.isNotNull())
    failed = F.expr("event_id % 13 = 0")
    return table(spark, sf_dir, "events").select(
        F.expr("cast(user_id % 20 as string)").alias("experiment_id"),
        F.expr("concat('run-', event_id)").alias("run_id"),
        F.col("event_type").alias("model_name"),
        F.expr(_STAGE).alias("stage"),
        F.expr("cast(event_id % 3 as int)").alias("iteration"),
        F.col("event_id").alias("seq"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("parameters"),
        F.when(failed, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
        .otherwise(metrics)
        .alias("metrics"),
        F.when(failed, F.lit("did not converge")).alias("error"),
        F.col("ts").alias("created_at"),
    )


RUNS_SQL = f"""
runs AS (
  SELECT (user_id % 20)::VARCHAR AS experiment_id,
         'run-' || event_id AS run_id,
         event_type AS model_name,
         {_STAGE} AS stage,
         (event_id % 3)::INTEGER AS iteration,
         event_id AS seq,
         regexp_extract(props, '[0-9]+') AS k,
         CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN (value % 100) / 100 END AS f1,
         CASE WHEN event_id % 13 <> 0 THEN value END AS rmse,
         CASE WHEN event_id % 13 = 0 THEN 'did not converge' END AS error,
         ts AS created_at
  FROM events
)"""


# Experiments: one per customer, the status by market segment; orders are their runs.
_STATUS = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'completed' WHEN 'BUILDING' THEN 'running'
 WHEN 'FURNITURE' THEN 'failed' WHEN 'HOUSEHOLD' THEN 'pending' ELSE 'running' END"""


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("experiment_id"),
        F.expr("concat('Predict the value of ', c_name)").alias("goal"),
        F.expr(_STATUS).alias("status"),
        F.expr("concat('# Report on ', c_name)").alias("final_report"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("created_at"),
    )


EXPERIMENTS_SQL = f"""
experiments AS (
  SELECT c_custkey::VARCHAR AS experiment_id, 'Predict the value of ' || c_name AS goal,
         {_STATUS} AS status, '# Report on ' || c_name AS final_report
  FROM customer
)"""

_ORDER_STAGE = "CASE o_orderstatus WHEN 'F' THEN 'initial' WHEN 'O' THEN 'replan' ELSE 'hpo' END"


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("experiment_id"),
        F.expr("concat('order-', o_orderkey)").alias("run_id"),
        F.col("o_orderpriority").alias("model_name"),
        F.expr(_ORDER_STAGE).alias("stage"),
        F.lit(0).alias("iteration"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("created_at"),
    )


ORDER_RUNS_SQL = f"""
order_runs AS (
  SELECT o_custkey::VARCHAR AS experiment_id, 'order-' || o_orderkey AS run_id, o_orderpriority AS model_name,
         {_ORDER_STAGE} AS stage, 0 AS iteration, o_orderkey AS seq, o_orderdate AS created_at
  FROM orders
)"""


def model_name(parity: Column) -> Column:
    return F.when(parity % 2 == 0, F.lit("model-pro")).otherwise(F.lit("model-flash"))


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("experiment_id"),
        F.col("event_type").alias("agent_name"),
        k.alias("prompt_tokens"),
        (k * 2).alias("completion_tokens"),
        (k * 3).alias("total_tokens"),
        llm_cost(k, k * 2, model_name(F.col("event_id"))).alias("cost"),
        (F.col("value") / 100).alias("latency"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("created_at"),
    )


# Cost in units of 1e-8 dollars is exact in decimals, so halves round as on paper.
COST_SQL = """round(CASE WHEN {parity} % 2 = 0 THEN {p} * 125 + {c} * 500 ELSE {p} * 7.5 + {c} * 30 END) / 1e8"""

EVENT_TRACES_SQL = f"""
traces AS (
  SELECT user_id::VARCHAR AS experiment_id, event_type AS agent_name, k AS prompt_tokens, 2 * k AS completion_tokens,
         3 * k AS total_tokens, {COST_SQL.format(parity='event_id', p='k', c='(2 * k)')} AS cost,
         value / 100 AS latency, event_id AS seq, ts AS created_at
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events)
)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document features with the quality label as `target`."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "n_chars",
        F.size(F.split("text", " ")).cast("bigint").alias("n_words"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
    )
    return documents.join(
        table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target")), "doc_id"
    )


LABELLED_SQL = """
labelled AS (
  SELECT d.doc_id, lang, n_chars, len(string_split(text, ' ')) AS n_words, len(string_split(text, chr(10))) AS n_lines,
         quality AS target
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def unit_sql(key: str, purpose: str, seed: int = 42) -> str:
    return f"({hash_sql(key, purpose, seed)} / 4294967296.0)"


def hash_sql(key: str, purpose: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5({key} || ':{purpose}:{seed}'), 1, 8))::BIGINT"
