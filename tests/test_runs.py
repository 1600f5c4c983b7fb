"""Run tables, texts, traces and the driver-side decisions."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tabulark.functions.text import (
    estimate_tokens,
    iso_time_part,
    llm_cost,
    parse_fenced_json,
    resolve_usage,
    stage_label,
    strip_markdown_fence,
)
from tabulark.operators.ranking import best_run, best_run_by, convergence, hpo_candidate, rank_runs, run_progress, top_rankings
from tabulark.operators.runs import (
    completed_reports,
    experiment_detail,
    experiment_items,
    experiment_label,
    experiment_runs,
    format_results,
    list_experiments,
    metric_names,
    pivot_metrics,
    plot_metric,
)
from tabulark.operators.traces import build_traces, trace_display, trace_totals
from tabulark.plans.goals import (
    decision_from_feedback,
    complete_feature_plan,
    default_feature_plan,
    default_plan,
    merge_replan,
    plan_from_goal,
    resolve_target,
    tune_once,
    validate_goals,
)
from tabulark.plans.report import report_lines, report_table
from tabulark.session import clear_scratch, scratch_path, shared_dir
from tabulark.sources.runlog import (
    RUNS,
    TRACES,
    append_runs,
    append_traces,
    complete_runs,
    log_params,
    read_table,
    upsert_experiment,
)


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        ("e", "r0", "forest", "initial", 0, 0, {"k": "1"}, {"rmse": 5.0, "f1": 0.7}, None),
        ("e", "r1", "linear", "initial", 0, 1, {}, {"rmse": 3.0, "f1": 0.9}, None),
        ("e", "r2", "broken", "initial", 0, 2, {}, {}, "no memory"),
        ("e", "r3", "linear", "hpo", 1, 3, {"C": "2.0"}, {"rmse": 2.995}, None),
        ("e", "r4", "forest", "replan", 1, 4, {}, {"rmse": 9.0, "f1": 0.9}, None),
        ("d", "r5", "linear", "initial", 0, 5, {}, {"rmse": float("nan"), "f1": 0.1}, None),
    ]
    frame = spark.createDataFrame(
        rows,
        "experiment_id string, run_id string, model_name string, stage string, iteration int, seq bigint, "
        "parameters map<string,string>, metrics map<string,double>, error string",
    )
    return complete_runs(frame.withColumn("created_at", F.timestamp_seconds(F.col("seq"))))


def ranking(df):
    return [r["run_id"] for r in df.filter("experiment_id = 'e'").orderBy("rank").collect()]


def test_ranking_by_either_direction(runs):
    assert ranking(rank_runs(runs, "rmse")) == ["r3", "r1", "r0", "r4"]
    # Equal values keep their order, a run without the metric is last.
    assert ranking(rank_runs(runs, "f1")) == ["r1", "r4", "r0", "r3"]
    assert ranking(rank_runs(runs, "f1", hot_rows=1)) == ["r1", "r4", "r0", "r3"]
    assert ranking(top_rankings(runs, "f1", 2)) == ["r1", "r4"]


def test_top_rankings_are_cut_before_the_shuffle(runs):
    plan = top_rankings(runs, "f1", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_best_runs(runs):
    assert {r["experiment_id"]: r["run_id"] for r in best_run(runs, "rmse").collect()} == {"e": "r3", "d": "r5"}
    assert best_run_by(runs.filter("experiment_id = 'e'"), "rmse", ascending=False).first()["run_id"] == "r4"
    found = {(r["experiment_id"], r["iteration"]): r["run_id"] for r in hpo_candidate(runs, "rmse").collect()}
    assert found == {("e", 0): "r1", ("e", 1): "r3", ("d", 0): "r5"}


def test_convergence_and_budget(runs):
    rows = {r["iteration"]: r for r in convergence(runs.filter("experiment_id = 'e'"), "rmse").collect()}
    assert not rows[0]["should_stop"] and rows[0]["previous_best"] is None
    assert rows[1]["converged"] and rows[1]["should_stop"] and math.isclose(rows[1]["improvement"], 0.005)
    spent = {r["iteration"]: r["should_stop"] for r in convergence(runs, "rmse", threshold=0.0, max_iterations=1).collect()}
    assert spent == {0: False, 1: True}


def test_progress(spark, runs):
    status = [("e", "running"), ("d", "running"), ("n", "running"), ("p", "pending"), ("c", "completed"), ("f", "failed")]
    experiments = spark.createDataFrame(status, "experiment_id string, status string")
    found = {r["experiment_id"]: r["step"] for r in run_progress(experiments, runs).collect()}
    assert found == {"e": "hpo", "d": "eval", "n": "planner", "p": "planner", "c": "report", "f": "runner"}


def test_records_are_completed_and_kept(spark, tmp_path, runs):
    path = str(tmp_path / "runs")
    append_runs(runs, path, partition_by="experiment_id")
    append_runs(spark.createDataFrame([("x",)], "experiment_id string"), path, partition_by="experiment_id")
    kept = read_table(spark, path, RUNS)
    assert kept.count() == 7
    bare = kept.filter("experiment_id = 'x'").first()
    assert (bare["model_name"], bare["iteration"], bare["stage"]) == ("unknown", 0, "initial")
    assert kept.filter("run_id = 'r2'").first()["error"] == "no memory"
    one = experiment_runs(kept, "e")
    assert [r["run_no"] for r in one.orderBy("run_no").collect()] == [1, 2, 3, 4, 5]
    assert "PartitionFilters: [isnotnull(experiment_id" in one._jdf.queryExecution().executedPlan().toString()
    traces = str(tmp_path / "traces")
    append_traces(spark.createDataFrame([("e",)], "experiment_id string"), traces)
    assert read_table(spark, traces, TRACES).first()["total_tokens"] == 0


def test_create_or_get(spark):
    existing = spark.createDataFrame([("7", "old")], "experiment_id string, name string")
    incoming = spark.createDataFrame([("old",), ("new",), ("new",), (None,)], "name string")
    found = {r["name"]: r["experiment_id"] for r in upsert_experiment(incoming, existing).collect()}
    assert set(found) == {"old", "new"} and found["old"] == "7"
    again = upsert_experiment(incoming, upsert_experiment(incoming, existing))
    assert {r["name"]: r["experiment_id"] for r in again.collect()} == found


def test_long_parameters(runs):
    assert {tuple(r) for r in log_params(runs).collect()} == {("r0", "k", "1"), ("r3", "C", "2.0")}


def test_detail_keeps_childless_experiments_and_does_not_multiply(spark, runs):
    experiments = spark.createDataFrame([("e", "goal one"), ("z", "goal two")], "experiment_id string, goal string")
    experiments = experiments.withColumn("created_at", F.current_timestamp())
    traces = spark.createDataFrame([("e", f"a{i}", i) for i in range(3)], "experiment_id string, agent_name string, seq bigint")
    traces = traces.withColumn("created_at", F.timestamp_seconds(F.col("seq")))
    detail = {r["experiment_id"]: r for r in experiment_detail(experiments, runs, traces).collect()}
    assert (detail["e"]["run_count"], detail["e"]["trace_count"], detail["e"]["last_run"]) == (5, 3, "r4")
    assert (detail["z"]["run_count"], detail["z"]["first_trace"]) == (0, None)
    items = experiment_items(experiments, runs.filter("experiment_id = 'e'"), traces).collect()
    assert [(r["experiment_id"], r["kind"]) for r in items] == (
        [("e", "experiment")] + [("e", "run")] * 5 + [("e", "trace")] * 3 + [("z", "experiment")]
    )


def test_pages(spark):
    rows = [(str(i), i % 4) for i in range(10)]
    experiments = spark.createDataFrame(rows, "experiment_id string, created_at int")
    page = list_experiments(experiments, limit=3, offset=1).collect()
    assert [(r["created_at"], r["experiment_id"], r["total"]) for r in page] == [(3, "7", 10), (2, "2", 10), (2, "6", 10)]


def test_reports_of_completed_experiments_only(spark):
    rows = [("a", "completed", "text"), ("b", "running", None)]
    df = spark.createDataFrame(rows, "experiment_id string, status string, final_report string").withColumn("goal", F.lit("g"))
    ready, refused = completed_reports(df)
    assert [r["experiment_id"] for r in ready.collect()] == ["a"]
    assert refused.first()["message"] == "Experiment is running, not completed yet."
    assert experiment_label(df).first()["label"] == "g (completed)"


def test_display(runs):
    assert metric_names(runs) == ["f1", "rmse"]
    row = pivot_metrics(runs).filter("run_id = 'r3'").first()
    assert (row["f1"], row["rmse"], row["stage_label"]) == (None, 2.995, "HPO Tuning")
    assert plot_metric("auc", ["f1", "rmse"]) == "f1" and plot_metric("rmse", ["f1", "rmse"]) == "rmse" and plot_metric("f1", []) is None
    lines = {r["run_id"]: r["line"] for r in format_results(runs).collect()}
    assert lines["r0"].startswith("forest (iter=0, stage=initial): ") and "r2" not in lines
    ranks = report_lines(runs, "rmse").filter("section = 'rankings' AND experiment_id = 'e' AND no = 1").first()
    assert ranks["line"] == "#1 linear (hpo): 2.9950"


def test_report(spark, runs):
    experiments = spark.createDataFrame([("e", "Predict it"), ("none", None)], "experiment_id string, goal string")
    found = {r["experiment_id"]: r["final_report"] for r in report_table(experiments, runs, "rmse").collect()}
    assert found["e"].startswith("# ML Experiment Report\n") and "**Model:** linear" in found["e"]
    assert "`C=2.0`" in found["e"] and "5 runs were recorded, 1 of them failed." in found["e"]
    assert "**Model:** N/A" in found["none"]


def one(spark, expression, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(expression.alias("x")).first()["x"]


def test_replies(spark):
    key = lambda text: one(spark, F.try_variant_get(parse_fenced_json(F.col("t")), "$.a", "int"), t=text)
    assert key('```json\n{"a": 1}\n```') == 1
    assert key('```\n{"a": 2}```') == 2
    assert key('  {"a": 3}\n') == 3
    assert key('{"a": 4') is None and key("no json") is None and key(None) is None
    strip = lambda text: one(spark, strip_markdown_fence(F.col("t")), t=text)
    assert strip(" ```markdown\n# T\n\ntext\n```\n") == "# T\n\ntext"
    assert strip("```\n# T\n```") == "# T" and strip("# T ``` x") == "# T ``` x" and strip("# T\n```") == "# T"


def test_tokens_and_costs(spark):
    assert one(spark, estimate_tokens(F.col("t")), t=" a  b\nc d ") == 16
    assert one(spark, estimate_tokens(F.col("t")), t="  ") == 0 and one(spark, estimate_tokens(F.col("t")), t=None) == 0
    million = F.lit(1_000_000)
    assert one(spark, llm_cost(million, million, F.col("m")), m="flash") == 0.375
    assert one(spark, llm_cost(million, million, F.col("m")), m="some-pro-x") == 6.25
    usage = lambda payload: tuple(one(spark, resolve_usage(F.col("j"), F.lit("a b"), F.lit("c")), j=payload))
    assert usage('{"usage_metadata": {"input_tokens": 3, "output_tokens": 4, "total_tokens": 9}}') == (3, 4, 9)
    assert usage('{"response_metadata": {"usage": {"input_tokens": 3, "output_tokens": 4}}}') == (3, 4, 7)
    assert usage('{"usage_metadata": {}, "response_metadata": {"token_usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 5}}}') == (1, 2, 5)
    assert usage("{}") == (8, 4, 12) and usage(None) == (8, 4, 12)


def test_small_texts(spark):
    assert one(spark, stage_label(F.col("s")), s="hpo") == "HPO Tuning" and one(spark, stage_label(F.col("s")), s="x") == "x"
    assert one(spark, iso_time_part(F.col("s")), s="2024-01-01T10:11:12.345") == "10:11:12"
    assert one(spark, iso_time_part(F.col("s")), s="10:11") == "10:11"


def test_traces_pair_a_question_with_the_next_answer(spark):
    turns = [(1, 0, "system", "x"), (1, 1, "user", "a b"), (1, 3, "assistant", "c"), (1, 4, "user", "d"), (1, 5, "user", "e"),
             (1, 6, "assistant", "f g"), (2, 0, "user", "h"), (2, 1, "system", "i"), (2, 2, "assistant", "j")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    for hot in (1, 1000):
        found = build_traces(df, F.lit("agent"), F.lit("flash"), hot_rows=hot).orderBy("turn").collect()
        assert [(r["turn"], r["prompt_tokens"], r["completion_tokens"]) for r in found] == [(1, 8, 4), (5, 4, 8)]
    shown = trace_display(spark.createDataFrame([("a", 1, 2, 3, 0.5, 1.25)], "agent_name string, prompt_tokens int, completion_tokens int, total_tokens int, cost double, latency double"), F.lit("2024-01-01T01:02:03.4"))
    assert tuple(shown.first()) == ("a", 1, 2, 3, "$0.500000", "1.250s", "01:02:03")
    empty = trace_totals(spark.createDataFrame([], TRACES)).first()
    assert tuple(empty) == (0, 0.0, 0.0)


def test_goals():
    plan = plan_from_goal("Predict whether a tumor is malignant from clinical features")
    assert plan["problem_type"] == "classification" and plan["target_column"] == "target" and "random_forest" in plan["models"]
    assert plan_from_goal("House PRICE")["primary_metric"] == "rmse"
    assert validate_goals("12345").dataset == "heart_disease"
    for bad in ("1234", None):
        with pytest.raises(ValueError):
            validate_goals(bad)


def test_plans():
    assert default_plan({"metrics": ["accuracy"]})["primary_metric"] == "accuracy"
    plan, features, iteration = merge_replan({"models": ["knn"], "metrics": ["f1"]}, {"a": 1}, {"models": ["svm"]}, None, 0)
    assert plan == {"models": ["svm"], "problem_type": "classification", "target_column": "target", "primary_metric": "f1", "metrics": ["f1"]}
    assert features == {"a": 1} and iteration == 1
    assert default_feature_plan(20)["feature_selection"]["apply"] is False
    assert default_feature_plan(21)["feature_selection"]["apply"] is True
    assert complete_feature_plan({})["preprocessing_steps"][0]["method"] == "standard"
    assert resolve_target(["a", "Label"], "y") == ("Label", False) and resolve_target(["a", "b"], "y") == ("b", True)


def test_decisions():
    assert (tune_once(0, False), tune_once(0, True), tune_once(1, False)) == ("tune", "stop", "stop")
    assert decision_from_feedback({}) == "stop"
    asked = [{"action": "other"}, {"action": "tune_hyperparameters"}]
    assert decision_from_feedback({"should_continue": True, "improvements": asked}) == "tune"
    assert decision_from_feedback({"should_continue": True, "improvements": asked[:1]}) == "replan"


def test_the_session_names_the_shared_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_scratch_tables_are_removed_when_asked(spark):
    path = scratch_path(spark, "few")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert clear_scratch(spark) >= 1 and not os.path.exists(path.removeprefix("file:"))
