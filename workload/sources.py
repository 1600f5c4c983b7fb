"""Loading and keeping records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.session import scratch_path
from tabulark.sources.datasets import load_csv, load_dataset, load_named, named_table
from tabulark.sources.runlog import (
    RUNS,
    TRACES,
    append_results,
    append_runs,
    append_traces,
    log_metrics,
    log_params,
    read_table,
    upsert_experiment,
)
from workload.common import EVENT_TRACES_SQL, RUNS_SQL, Checks, event_traces, rounded, runs, table

CHECKS = Checks()


@CHECKS.query("load_dataset", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    return load_dataset(spark, "customers", {"customers": named_table(f"{sf}/customer.parquet")})


@CHECKS.query(
    "load_csv",
    "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def _(spark, sf):
    path = scratch_path(spark, "customers.csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return load_csv(spark, path)


@CHECKS.query(
    "load_csv_quoted",
    """SELECT doc_id::INTEGER AS doc_id, CASE WHEN text NOT IN ('', 'NA', 'N/A', 'NULL', 'null', 'nan', 'NaN', 'None', 'n/a') THEN text END AS text,
      CASE WHEN lang <> 'en' THEN lang END AS lang, source || ', "' || lang || '"' AS origin, n_chars::INTEGER AS n_chars, n_chars / 4 AS quarter,
      n_chars % 2 = 0 AS even
    FROM documents""",
)
def _(spark, sf):
    """Whole texts with quotes, commas and line feeds, through a quoted file and back."""
    path = scratch_path(spark, "documents.csv")
    documents = table(spark, sf, "documents").select(
        "doc_id", "text",
        F.when(F.col("lang") == "en", F.lit("N/A")).otherwise(F.col("lang")).alias("lang"),
        F.concat("source", F.lit(', "'), "lang", F.lit('"')).alias("origin"),
        "n_chars", (F.col("n_chars") / 4).alias("quarter"), (F.col("n_chars") % 2 == 0).alias("even"),
    )
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    documents.write.options(**plain).csv(path)
    return load_csv(spark, path)


@CHECKS.query(
    "load_named",
    "SELECT d.doc_id, text, lang, source, n_chars, toxic, quality AS target FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, sf):
    def quality(session):
        features = named_table(f"{sf}/documents.parquet")(session)
        return features.join(named_table(f"{sf}/labels.parquet", target="quality")(session), "doc_id")

    return load_named(spark, "quality", {"quality": quality})


@CHECKS.query(
    "append_runs",
    f"""WITH {RUNS_SQL}
    SELECT experiment_id, run_id, coalesce(CASE WHEN seq % 7 <> 0 THEN model_name END, 'unknown') AS model_name,
           coalesce(CASE WHEN seq % 5 <> 0 THEN stage END, 'initial') AS stage,
           coalesce(CASE WHEN seq % 11 <> 0 THEN iteration END, 0) AS iteration, seq, f1, rmse, error
    FROM runs""",
)
def _(spark, sf):
    path = scratch_path(spark, "runs")
    gaps = runs(spark, sf).withColumns(
        {
            "model_name": F.when(F.col("seq") % 7 != 0, F.col("model_name")),
            "stage": F.when(F.col("seq") % 5 != 0, F.col("stage")),
            "iteration": F.when(F.col("seq") % 11 != 0, F.col("iteration")),
        }
    )
    append_runs(gaps, path, partition_by="experiment_id")
    return read_table(spark, path, RUNS).select(
        "experiment_id", "run_id", "model_name", "stage", "iteration", "seq",
        F.try_element_at("metrics", F.lit("f1")).alias("f1"),
        F.try_element_at("metrics", F.lit("rmse")).alias("rmse"),
        "error",
    )


@CHECKS.query(
    "append_traces",
    f"""WITH {EVENT_TRACES_SQL}
    SELECT experiment_id, coalesce(CASE WHEN seq % 5 <> 0 THEN agent_name END, 'unknown') AS agent_name, prompt_tokens, completion_tokens,
      total_tokens, round(cost, 8) AS cost, round(coalesce(CASE WHEN seq % 7 <> 0 THEN latency END, 0), 6) AS latency FROM traces""",
)
def _(spark, sf):
    path = scratch_path(spark, "traces")
    gaps = event_traces(spark, sf).withColumns(
        {"agent_name": F.when(F.col("seq") % 5 != 0, F.col("agent_name")), "latency": F.when(F.col("seq") % 7 != 0, F.col("latency"))}
    )
    append_traces(gaps, path)
    return rounded(rounded(read_table(spark, path, TRACES).drop("created_at"), 8, "cost"), 6, "latency")


@CHECKS.query(
    "upsert_experiment",
    """WITH existing AS (
      SELECT DISTINCT 'exp-' || o_custkey AS experiment_id, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS name
      FROM orders WHERE o_totalprice > 400000)
    SELECT experiment_id, name FROM existing
    UNION ALL
    SELECT md5(c_name), c_name FROM customer WHERE c_name NOT IN (SELECT name FROM existing)""",
)
def _(spark, sf):
    known = table(spark, sf, "orders").filter("o_totalprice > 400000").select("o_custkey").distinct()
    existing = known.select(
        F.expr("concat('exp-', o_custkey)").alias("experiment_id"),
        F.expr("concat('Customer#', lpad(cast(o_custkey as string), 9, '0'))").alias("name"),
    )
    return upsert_experiment(table(spark, sf, "customer").select(F.col("c_name").alias("name")), existing)


@CHECKS.query("log_params", f"WITH {RUNS_SQL} SELECT run_id, 'k' AS key, k AS value FROM runs")
def _(spark, sf):
    return log_params(runs(spark, sf))


@CHECKS.query(
    "log_metrics",
    f"""WITH {RUNS_SQL}
    SELECT run_id, 'f1' AS key, f1 AS value, iteration::BIGINT AS step FROM runs WHERE f1 IS NOT NULL
    UNION ALL SELECT run_id, 'rmse', rmse, iteration::BIGINT FROM runs WHERE rmse IS NOT NULL""",
)
def _(spark, sf):
    return log_metrics(runs(spark, sf))


@CHECKS.query(
    "append_results",
    f"""WITH {RUNS_SQL}
    SELECT run_id, seq, error, NULL::VARCHAR AS note FROM runs UNION ALL SELECT run_id, seq, error, stage FROM runs""",
)
def _(spark, sf):
    earlier = runs(spark, sf).select("run_id", "seq", "error")
    new = runs(spark, sf).select("run_id", "seq", "error", F.col("stage").alias("note"))
    return append_results(earlier, new)
