"""Run, trace and experiment records as append-only tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
_NUMBER_MAP = T.MapType(T.StringType(), T.DoubleType())

RUNS = T.StructType(
    [
        T.StructField("experiment_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("iteration", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("parameters", _TEXT_MAP),
        T.StructField("metrics", _NUMBER_MAP),
        T.StructField("error", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
TRACES = T.StructType(
    [
        T.StructField("experiment_id", T.StringType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("latency", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
EXPERIMENTS = T.StructType(
    [
        T.StructField("experiment_id", T.StringType()),
        T.StructField("goal", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("dataset_path", T.StringType()),
        T.StructField("current_iteration", T.IntegerType()),
        T.StructField("plan", T.StringType()),
        T.StructField("dataset_summary", T.StringType()),
        T.StructField("feature_plan", T.StringType()),
        T.StructField("best_model", T.StringType()),
        T.StructField("final_report", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# What a record without the field gets.
RUN_DEFAULTS = {"model_name": "unknown", "iteration": 0, "stage": "initial"}
TRACE_DEFAULTS = {
    "agent_name": "unknown",
    "prompt_tokens": 0,
    "completion_tokens": 0,
    "total_tokens": 0,
    "cost": 0.0,
    "latency": 0.0,
}


def run_id(experiment: Column, model: Column, stage: Column, iteration: Column) -> Column:
    return F.md5(F.concat_ws(":", experiment, model, stage, iteration.cast("string")))


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object]) -> DataFrame:
    """Exactly the columns of the schema, with defaults for what is missing."""
    columns = []
    for field in schema:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def complete_runs(runs: DataFrame) -> DataFrame:
    return conform(runs, RUNS, RUN_DEFAULTS)


def complete_traces(traces: DataFrame) -> DataFrame:
    return conform(traces, TRACES, TRACE_DEFAULTS)


def _append(df: DataFrame, path: str, partition_by: str | None) -> None:
    if partition_by is None:
        df.write.mode("append").parquet(path)
    else:
        # Few files per folder, and a hot folder is still written by many tasks.
        df.hint("rebalance", partition_by).write.mode("append").partitionBy(partition_by).parquet(path)


def append_runs(runs: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append one row per run; the error text is kept.

    Partition by `experiment_id` only while experiments are few and large: every value
    becomes a folder.
    """
    _append(complete_runs(runs), path, partition_by)


def append_traces(traces: DataFrame, path: str, partition_by: str | None = None) -> None:
    _append(complete_traces(traces), path, partition_by)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def latest_experiments(experiments: DataFrame) -> DataFrame:
    """The last state of each experiment, of equal times the one that is further on; the first `created_at` stays."""
    done = F.when(F.col("status").isin("completed", "failed"), 2).when(F.col("status") == "running", 1).otherwise(0)
    rest = [c for c in EXPERIMENTS.fieldNames() if c not in ("experiment_id", "created_at")]
    last = F.max_by(F.struct(*rest), F.struct("updated_at", done))
    found = experiments.groupBy("experiment_id").agg(last.alias("last"), F.min("created_at").alias("created_at"))
    return found.select("experiment_id", "created_at", "last.*").select(*EXPERIMENTS.fieldNames())


def append_results(earlier: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier and new records together, duplicates kept."""
    return earlier.unionByName(new, allowMissingColumns=True)


def new_experiments(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The incoming names that are not registered yet, once each, with their ids."""
    return (
        incoming.filter(F.col("name").isNotNull())
        .select("name")
        .distinct()
        .join(existing.select("name"), "name", "left_anti")
        .select(F.md5("name").alias("experiment_id"), "name")
    )


def upsert_experiment(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """All experiments after create-or-get: a registered name keeps its id."""
    return existing.select("experiment_id", "name").unionByName(new_experiments(incoming, existing))


def log_params(runs: DataFrame) -> DataFrame:
    """Parameters as (run_id, key, value) text rows."""
    return runs.select("run_id", F.explode("parameters").alias("key", "value")).withColumn(
        "value", F.col("value").cast("string")
    )


def log_metrics(runs: DataFrame, step: Column | None = None) -> DataFrame:
    """Metrics as (run_id, key, value, step) rows."""
    step = F.col("iteration") if step is None else step
    return runs.select("run_id", F.explode("metrics").alias("key", "value"), step.cast("bigint").alias("step"))
