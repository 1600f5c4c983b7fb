"""Traces of model calls: building, totals and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.config import HOT_GROUP_ROWS
from tabulark.functions.columns import ratio
from tabulark.functions.text import estimate_tokens, iso_time_part, llm_cost
from tabulark.operators.ordered import with_next


def build_traces(
    turns: DataFrame, agent: Column, model: Column, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """One trace per user turn that an assistant turn follows directly.

    Tokens are estimated before turns are paired, so texts are not shuffled. Recorded
    conversations hold no latency, which stays NULL.
    """
    counted = turns.select("conv_id", "turn", "role", estimate_tokens(F.col("text")).alias("tokens"))
    paired = with_next(
        counted,
        ["conv_id"],
        [F.col("turn")],
        {"next_role": F.col("role"), "completion_tokens": F.col("tokens")},
        hot_rows,
    ).filter("role = 'user' AND next_role = 'assistant'")
    return paired.select(
        "conv_id",
        "turn",
        agent.alias("agent_name"),
        F.col("tokens").alias("prompt_tokens"),
        "completion_tokens",
        (F.col("tokens") + F.col("completion_tokens")).alias("total_tokens"),
        llm_cost(F.col("tokens"), F.col("completion_tokens"), model).alias("cost"),
        F.lit(None).cast("double").alias("latency"),
    )


def trace_totals(traces: DataFrame) -> DataFrame:
    return traces.agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.avg("latency"), F.lit(0.0)).alias("avg_latency"),
    )


def trace_cost_by_agent(traces: DataFrame) -> DataFrame:
    """Cost per agent and its share of the total, a scalar subquery over the per-agent sums."""
    per_agent = traces.groupBy("agent_name").agg(F.sum("cost").alias("cost"))
    total = per_agent.agg(F.sum("cost")).scalar()
    return per_agent.select("agent_name", "cost", ratio(F.col("cost"), total).alias("share"))


def trace_latency_by_agent(traces: DataFrame) -> DataFrame:
    return traces.groupBy("agent_name").agg(F.avg("latency").alias("avg_latency")).orderBy("avg_latency", "agent_name")


def trace_display(traces: DataFrame, stamp: Column) -> DataFrame:
    """Traces as shown to a reader: `$cost`, `latency` in seconds, time of day."""
    return traces.select(
        "agent_name",
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        F.format_string("$%.6f", F.col("cost")).alias("cost"),
        F.format_string("%.3fs", F.col("latency")).alias("latency"),
        iso_time_part(stamp).alias("time"),
    )
