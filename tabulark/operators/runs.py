"""Listing, detail and display of experiments and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.config import HOT_GROUP_ROWS
from tabulark.functions.columns import column
from tabulark.functions.text import format_metrics, stage_label
from tabulark.operators.ordered import numbered



def list_experiments(experiments: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of experiments, newest first, each with the total number of experiments."""
    page = experiments.orderBy(F.desc("created_at"), "experiment_id").offset(offset).limit(limit)
    total = experiments.agg(F.count(F.lit(1))).scalar()
    return page.withColumn("total", total)


def experiment_runs(
    runs: DataFrame, experiment_id: str | None = None, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Runs in order of creation, numbered per experiment; of one experiment if an id is given."""
    if experiment_id is not None:
        runs = runs.filter(F.col("experiment_id") == experiment_id)
    return numbered(runs, ["experiment_id"], [F.col("created_at"), F.col("seq")], "run_no", hot_rows)


def completed_reports(experiments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports of completed experiments, and the others with the reason they have none."""
    completed = F.coalesce(F.col("status") == "completed", F.lit(False))
    ready = experiments.filter(completed).select("experiment_id", "goal", "status", "final_report")
    message = F.format_string("Experiment is %s, not completed yet.", F.coalesce("status", F.lit("unknown")))
    refused = experiments.filter(~completed).select("experiment_id", "status", message.alias("message"))
    return ready, refused


def _children(df: DataFrame, prefix: str, item: Column) -> DataFrame:
    order = F.struct(F.col("created_at"), F.col("seq"))
    return df.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias(f"{prefix}_count"),
        F.min_by(item, order).alias(f"first_{prefix}"),
        F.max_by(item, order).alias(f"last_{prefix}"),
    )


def experiment_detail(experiments: DataFrame, runs: DataFrame, traces: DataFrame) -> DataFrame:
    """Every experiment with the number, first and last of its runs and traces.

    Each child table is aggregated before its join, so neither multiplies the other and a hot
    experiment sends one row per partition. The full lists are `experiment_items`.
    """
    detail = experiments.join(_children(runs, "run", F.col("run_id")), "experiment_id", "left")
    detail = detail.join(_children(traces, "trace", F.col("agent_name")), "experiment_id", "left")
    return detail.fillna(0, ["run_count", "trace_count"])


def experiment_items(experiments: DataFrame, runs: DataFrame, traces: DataFrame) -> DataFrame:
    """Every experiment followed by its runs and its traces in order of creation, as rows.

    A union sorted by (experiment, kind, time): no experiment is gathered into one row or
    one task, however many runs it has, and one without any keeps its own row.
    """

    def part(df: DataFrame, kind: int, name: str) -> DataFrame:
        seq = F.col("seq") if "seq" in df.columns else F.lit(0).cast("bigint")
        rest = [c for c in df.columns if c not in ("experiment_id", "created_at", "seq")]
        return df.select(
            "experiment_id",
            F.lit(kind).alias("kind_no"),
            F.lit(name).alias("kind"),
            F.col("created_at").cast("timestamp").alias("created_at"),
            seq.alias("seq"),
            F.to_json(F.struct(*rest)).alias("record"),
        )

    return (
        part(experiments, 0, "experiment")
        .unionByName(part(runs, 1, "run"))
        .unionByName(part(traces, 2, "trace"))
        .orderBy("experiment_id", "kind_no", "created_at", "seq")
        .drop("kind_no")
    )


def metric_names(runs: DataFrame) -> list[str]:
    """All names in sorted order; each becomes a column of a pivot, so they belong to the driver."""
    return sorted(r["name"] for r in runs.select(F.explode(F.map_keys("metrics")).alias("name")).distinct().collect())


def pivot_metrics(runs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One column per metric, read from the map without a shuffle."""
    names = metric_names(runs) if names is None else list(names)
    values = [F.try_element_at(F.col("metrics"), F.lit(n)).alias(n) for n in names]
    return runs.select(
        "run_id", "model_name", stage_label(F.col("stage")).alias("stage_label"), "stage", "iteration", *values
    )


def plot_metric(primary: str, available: Sequence[str]) -> str | None:
    """The primary metric if there is one, else the first at hand."""
    if primary in available or not available:
        return primary if primary in available else None
    return available[0]


def format_results(runs: DataFrame) -> DataFrame:
    """`model (iter=i, stage=s): f1=0.9000, …` for every run without an error."""
    line = F.format_string(
        "%s (iter=%d, stage=%s): %s",
        F.col("model_name"), F.coalesce("iteration", F.lit(0)), F.coalesce("stage", F.lit("initial")),
        F.coalesce(format_metrics(F.col("metrics")), F.lit("")),
    )
    return runs.filter(F.col("error").isNull()).select("experiment_id", "run_id", "seq", line.alias("line"))


def format_rankings(ranked: DataFrame) -> DataFrame:
    """`#rank model (stage): value` for every ranked run."""
    shown = F.format_string("%.4f", F.coalesce("primary_metric_value", F.lit(0.0)))
    line = F.format_string(
        "#%d %s (%s): %s", F.col("rank"), F.col("model_name"), F.coalesce("stage", F.lit("?")), shown
    )
    return ranked.select("experiment_id", "run_id", "rank", line.alias("line"))


def experiment_label(experiments: DataFrame, length: int = 40) -> DataFrame:
    """Short id, and the start of the goal with the status, for lists."""
    return experiments.select(
        *[column(c) for c in experiments.columns],
        F.substring("experiment_id", 1, 8).alias("short_id"),
        F.format_string("%s (%s)", F.substring("goal", 1, length), F.col("status")).alias("label"),
    )
