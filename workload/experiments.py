"""Ranking, listing and reporting over run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.operators.ranking import (
    best_run,
    best_run_by,
    convergence,
    hpo_candidate,
    rank_runs,
    run_progress,
    top_rankings,
    valid_runs,
)
from tabulark.operators.runs import (
    completed_reports,
    experiment_detail,
    experiment_items,
    experiment_runs,
    format_results,
    list_experiments,
    pivot_metrics,
)
from tabulark.plans.report import report_lines, report_table
from workload.common import (
    EVENT_TRACES_SQL,
    EXPERIMENTS_SQL,
    ORDER_RUNS_SQL,
    RUNS_SQL,
    Checks,
    event_traces,
    experiments,
    order_runs,
    rounded,
    runs,
    table,
)

CHECKS = Checks()


@CHECKS.query(
    "valid_runs", f"WITH {RUNS_SQL} SELECT experiment_id, run_id, seq FROM runs WHERE error IS NULL"
)
def _(spark, sf):
    return valid_runs(runs(spark, sf)).select("experiment_id", "run_id", "seq")


@CHECKS.query(
    "completed_reports",
    f"""WITH {EXPERIMENTS_SQL} SELECT experiment_id, status, CASE WHEN status = 'completed' THEN final_report END AS final_report,
      CASE WHEN status <> 'completed' THEN 'Experiment is ' || status || ', not completed yet.' END AS message FROM experiments""",
)
def _(spark, sf):
    ready, refused = completed_reports(experiments(spark, sf))
    return ready.drop("goal").unionByName(refused, allowMissingColumns=True)


_RANKED = f"""WITH {RUNS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY f1 DESC NULLS LAST, seq)
  AS rank FROM runs WHERE error IS NULL)"""


@CHECKS.query("rank_runs", f"{_RANKED} SELECT experiment_id, run_id, rank, f1 AS primary_metric_value FROM ranked")
def _(spark, sf):
    return rank_runs(runs(spark, sf), "f1").select("experiment_id", "run_id", "rank", "primary_metric_value")


@CHECKS.query("rank_runs_ranges", f"{_RANKED} SELECT experiment_id, run_id, rank, f1 AS primary_metric_value FROM ranked")
def _(spark, sf):
    """The way of large experiments: sorted ranges that are numbered by themselves."""
    return rank_runs(runs(spark, sf), "f1", hot_rows=10).select("experiment_id", "run_id", "rank", "primary_metric_value")


@CHECKS.query(
    "rank_runs_lower",
    f"""WITH {RUNS_SQL} SELECT experiment_id, run_id, row_number() OVER (PARTITION BY experiment_id ORDER BY rmse, seq) AS rank,
      rmse AS primary_metric_value FROM runs WHERE error IS NULL""",
)
def _(spark, sf):
    return rank_runs(runs(spark, sf), "rmse").select("experiment_id", "run_id", "rank", "primary_metric_value")


@CHECKS.query(
    "top_rankings",
    f"{_RANKED} SELECT experiment_id, run_id, model_name, stage, rank, f1 AS primary_metric_value FROM ranked WHERE rank <= 10",
)
def _(spark, sf):
    return top_rankings(runs(spark, sf), "f1").select(
        "experiment_id", "run_id", "model_name", "stage", "rank", "primary_metric_value"
    )


def _flat(df):
    return df.select(
        "experiment_id", "run_id", "model_name", "stage", "iteration", "seq",
        F.try_element_at("metrics", F.lit("f1")).alias("f1"),
        F.try_element_at("metrics", F.lit("rmse")).alias("rmse"),
        "error",
    )


_FLAT = "experiment_id, run_id, model_name, stage, iteration, seq, f1, rmse, error"


@CHECKS.query("best_run", f"{_RANKED} SELECT {_FLAT} FROM ranked WHERE rank = 1")
def _(spark, sf):
    return _flat(best_run(runs(spark, sf), "f1"))


@CHECKS.query(
    "best_run_by",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY rmse DESC NULLS LAST, seq) AS n FROM runs)
    SELECT {_FLAT} FROM r WHERE n = 1""",
)
def _(spark, sf):
    return _flat(best_run_by(runs(spark, sf), "rmse", ascending=False))


@CHECKS.query(
    "hpo_candidate",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, iteration ORDER BY f1 DESC NULLS LAST, seq) AS n
      FROM runs WHERE error IS NULL) SELECT {_FLAT} FROM r WHERE n = 1""",
)
def _(spark, sf):
    return _flat(hpo_candidate(runs(spark, sf), "f1"))


@CHECKS.query(
    "convergence",
    f"""WITH {RUNS_SQL}, b AS (SELECT experiment_id, iteration, min(rmse) AS best FROM runs GROUP BY ALL),
    s AS (SELECT experiment_id, iteration, min(best) OVER (PARTITION BY experiment_id ORDER BY iteration) AS best_value,
      min(best) OVER (PARTITION BY experiment_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best
      FROM b),
    c AS (SELECT *, abs(best_value - previous_best) AS improvement,
      coalesce(iteration > 0 AND abs(best_value - previous_best) < 0.01, false) AND iteration < 2 AS converged FROM s)
    SELECT experiment_id, iteration, best_value, previous_best, round(improvement, 6) AS improvement, converged,
      converged OR iteration >= 2 AS should_stop FROM c""",
)
def _(spark, sf):
    return rounded(convergence(runs(spark, sf), "rmse", max_iterations=2), 6, "improvement")


@CHECKS.query(
    "run_progress",
    f"""WITH {EXPERIMENTS_SQL}, {ORDER_RUNS_SQL}, s AS (SELECT experiment_id, bool_or(stage = 'hpo') AS tuned,
      bool_or(stage = 'replan' OR iteration > 0) AS replanned FROM order_runs GROUP BY experiment_id)
    SELECT e.experiment_id, status, CASE status WHEN 'pending' THEN 'planner' WHEN 'completed' THEN 'report' WHEN 'failed' THEN 'runner'
      ELSE CASE WHEN tuned IS NULL THEN 'planner' WHEN tuned THEN 'hpo' WHEN replanned THEN 'replan' ELSE 'eval' END END AS step
    FROM experiments e LEFT JOIN s ON e.experiment_id = s.experiment_id""",
)
def _(spark, sf):
    return run_progress(experiments(spark, sf), order_runs(spark, sf))


@CHECKS.query(
    "list_experiments",
    """SELECT o_orderkey::VARCHAR AS experiment_id, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders
    ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 50 OFFSET 100""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("experiment_id"), "o_totalprice", F.col("o_orderdate").alias("created_at")
    )
    return list_experiments(orders, limit=50, offset=100).drop("created_at")


@CHECKS.query(
    "experiment_runs",
    f"""WITH {ORDER_RUNS_SQL} SELECT experiment_id, run_id, stage,
      row_number() OVER (PARTITION BY experiment_id ORDER BY created_at, seq) AS run_no FROM order_runs""",
)
def _(spark, sf):
    return experiment_runs(order_runs(spark, sf)).select("experiment_id", "run_id", "stage", "run_no")


@CHECKS.query(
    "experiment_detail",
    f"""WITH {EXPERIMENTS_SQL}, {ORDER_RUNS_SQL}, {EVENT_TRACES_SQL},
    r AS (SELECT experiment_id, count(*) AS n, first(run_id ORDER BY created_at, seq) AS a, last(run_id ORDER BY created_at, seq) AS b
      FROM order_runs GROUP BY experiment_id),
    t AS (SELECT experiment_id, count(*) AS n, first(agent_name ORDER BY created_at, seq) AS a,
      last(agent_name ORDER BY created_at, seq) AS b FROM traces GROUP BY experiment_id)
    SELECT e.experiment_id, status, coalesce(r.n, 0) AS run_count, r.a AS first_run, r.b AS last_run,
      coalesce(t.n, 0) AS trace_count, t.a AS first_trace, t.b AS last_trace
    FROM experiments e LEFT JOIN r ON e.experiment_id = r.experiment_id LEFT JOIN t ON e.experiment_id = t.experiment_id""",
)
def _(spark, sf):
    detail = experiment_detail(experiments(spark, sf), order_runs(spark, sf), event_traces(spark, sf))
    return detail.select(
        "experiment_id", "status", "run_count", "first_run", "last_run", "trace_count", "first_trace", "last_trace"
    )


@CHECKS.query(
    "experiment_items",
    f"""WITH {EXPERIMENTS_SQL}, {ORDER_RUNS_SQL}, {EVENT_TRACES_SQL}
    SELECT experiment_id, 'experiment' AS kind, status AS item, 0::BIGINT AS seq FROM experiments
    UNION ALL SELECT experiment_id, 'run', run_id, seq FROM order_runs
    UNION ALL SELECT experiment_id, 'trace', agent_name, seq FROM traces""",
)
def _(spark, sf):
    items = experiment_items(experiments(spark, sf), order_runs(spark, sf), event_traces(spark, sf))
    item = F.coalesce(*[F.get_json_object("record", f"$.{c}") for c in ("run_id", "agent_name", "status")])
    return items.select("experiment_id", "kind", item.alias("item"), "seq")


@CHECKS.query(
    "pivot_metrics",
    f"""WITH {RUNS_SQL} SELECT run_id, model_name, stage, iteration, round(f1, 4) AS f1, round(rmse, 4) AS rmse,
      CASE stage WHEN 'initial' THEN 'Baseline Stage' WHEN 'hpo' THEN 'HPO Tuning' ELSE 'Replan Improvement' END AS stage_label
    FROM runs""",
)
def _(spark, sf):
    return rounded(pivot_metrics(runs(spark, sf)), 4, "f1", "rmse")


_METRICS_TEXT = """(CASE WHEN f1 IS NULL THEN '' ELSE 'f1=' || printf('%.4f', f1) || ', ' END || 'rmse=' || printf('%.4f', rmse))"""
_LINE = f"model_name || ' (iter=' || iteration || ', stage=' || stage || '): ' || {_METRICS_TEXT}"


@CHECKS.query(
    "format_results",
    f"WITH {RUNS_SQL} SELECT experiment_id, run_id, seq, {_LINE} AS line FROM runs WHERE error IS NULL",
)
def _(spark, sf):
    return format_results(runs(spark, sf))


@CHECKS.query(
    "report_lines",
    f"""{_RANKED} SELECT experiment_id, 'results' AS section, seq AS no, {_LINE} AS line FROM runs WHERE error IS NULL
    UNION ALL SELECT experiment_id, 'rankings', rank,
      '#' || rank || ' ' || model_name || ' (' || stage || '): ' || printf('%.4f', coalesce(f1, 0)) FROM ranked""",
)
def _(spark, sf):
    return report_lines(runs(spark, sf), "f1")


@CHECKS.query(
    "report_table",
    f"""{_RANKED}, n AS (SELECT experiment_id, count(*) AS runs, count(error) AS failed FROM runs GROUP BY experiment_id),
    e AS (SELECT DISTINCT experiment_id, 'Predict the value of segment ' || experiment_id AS goal FROM runs)
    SELECT e.experiment_id, '# ML Experiment Report' || chr(10) || chr(10) || '## Executive Summary' || chr(10) || chr(10)
      || n.runs || ' runs were recorded, ' || n.failed || ' of them failed.' || chr(10) || chr(10) || '## Objective' || chr(10) || chr(10)
      || goal || chr(10) || chr(10) || '## Methodology' || chr(10) || chr(10)
      || 'The table was profiled and split, features were prepared on the training rows, candidate models were trained and ranked by f1 (higher is better).'
      || chr(10) || chr(10) || '## Best Model' || chr(10) || chr(10) || '**Model:** ' || model_name || chr(10) || chr(10)
      || '**Metrics:** `' || {_METRICS_TEXT} || '`' || chr(10) || chr(10) || '**Parameters:** `k=' || k || '`' || chr(10) || chr(10)
      || '## Notes' || chr(10) || chr(10) || '- none' AS final_report
    FROM e JOIN n ON e.experiment_id = n.experiment_id JOIN ranked r ON e.experiment_id = r.experiment_id AND rank = 1""",
)
def _(spark, sf):
    all_runs = runs(spark, sf)
    goals = all_runs.select("experiment_id").distinct().withColumn(
        "goal", F.concat(F.lit("Predict the value of segment "), F.col("experiment_id"))
    )
    return report_table(goals, all_runs, "f1")
