"""Replies, tokens, costs and traces."""

from __future__ import annotations

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
from tabulark.operators.traces import (
    build_traces,
    trace_cost_by_agent,
    trace_display,
    trace_latency_by_agent,
    trace_totals,
)
from workload.common import (
    COST_SQL,
    EVENT_TRACES_SQL,
    RUNS_SQL,
    Checks,
    event_traces,
    model_name,
    rounded,
    runs,
    table,
)

CHECKS = Checks()

_FENCE = "```"


@CHECKS.query(
    "parse_fenced_json",
    "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN regexp_extract(props, '[0-9]+')::BIGINT END AS k FROM events",
)
def _(spark, sf):
    reply = (
        F.when(F.expr("event_id % 3 = 0"), F.col("props"))
        .when(F.expr("event_id % 3 = 1"), F.concat(F.lit(f"Here it is:\n{_FENCE}json\n"), F.col("props"), F.lit(f"\n{_FENCE}")))
        .otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    )
    # A fence inside other text leaves that text behind, so only whole fenced replies parse.
    reply = F.regexp_replace(reply, "^Here it is:\n", "")
    return table(spark, sf, "events").select(
        "event_id", F.try_variant_get(parse_fenced_json(reply), "$.k", "bigint").alias("k")
    )


@CHECKS.query(
    "strip_markdown_fence",
    r"""SELECT doc_id, md5(s) AS text_md5, length(s) AS n FROM (
      SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s\x{00A0}\x{2028}]+', ''), '[\s\x{00A0}\x{2028}]+$', '') AS s FROM documents)""",
)
def _(spark, sf):
    wrapped = (
        F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit(f" {_FENCE}markdown\n"), F.col("text"), F.lit(f"\n{_FENCE}\n")))
        .when(F.expr("doc_id % 3 = 1"), F.concat(F.lit(f"{_FENCE}\n"), F.col("text")))
        .otherwise(F.col("text"))
    )
    stripped = strip_markdown_fence(wrapped)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(stripped.cast("binary")).alias("text_md5"), F.length(stripped).cast("bigint").alias("n")
    )


WORDS_SQL = r"(4 * len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')))::BIGINT"


@CHECKS.query("estimate_tokens", f"SELECT conv_id, turn, {WORDS_SQL.format('text')} AS tokens FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", estimate_tokens(F.col("text")).alias("tokens"))


@CHECKS.query(
    "resolve_usage",
    """WITH u AS (SELECT event_id, regexp_extract(props, '[0-9]+')::BIGINT AS k, event_id % 3 = 2 OR k = 0 AS guess FROM events)
    SELECT event_id, CASE WHEN guess THEN 8 ELSE k END AS prompt_tokens,
      CASE WHEN guess THEN 4 ELSE 2 * k END AS completion_tokens, CASE WHEN guess THEN 12 ELSE 3 * k END AS total_tokens FROM u""",
)
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    payload = (
        F.when(
            F.expr("event_id % 3 = 0"),
            F.format_string('{"usage_metadata": {"input_tokens": %d, "output_tokens": %d, "total_tokens": %d}}', k, k * 2, k * 3),
        )
        .when(
            F.expr("event_id % 3 = 1"),
            F.format_string('{"response_metadata": {"token_usage": {"prompt_tokens": %d, "completion_tokens": %d}}}', k, k * 2),
        )
        .otherwise(F.lit("{}"))
    )
    usage = resolve_usage(payload, F.col("props"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", usage.alias("u")).select("event_id", "u.*")


@CHECKS.query(
    "llm_cost",
    f"""SELECT conv_id, turn, round({COST_SQL.format(parity='conv_id', p='t', c='(2 * t)')}, 8) AS cost
    FROM (SELECT conv_id, turn, {WORDS_SQL.format('text')} AS t FROM conversations)""",
)
def _(spark, sf):
    tokens = estimate_tokens(F.col("text"))
    cost = llm_cost(tokens, tokens * 2, model_name(F.col("conv_id")))
    return table(spark, sf, "conversations").select("conv_id", "turn", cost.alias("cost"))


@CHECKS.query(
    "stage_label",
    f"""WITH {RUNS_SQL} SELECT run_id, CASE stage WHEN 'initial' THEN 'Baseline Stage' WHEN 'hpo' THEN 'HPO Tuning'
      ELSE CASE WHEN seq % 2 = 0 THEN 'Replan Improvement' ELSE 'other' END END AS label FROM runs""",
)
def _(spark, sf):
    stage = F.expr("CASE WHEN stage = 'replan' AND seq % 2 <> 0 THEN 'other' ELSE stage END")
    return runs(spark, sf).select("run_id", stage_label(stage).alias("label"))


@CHECKS.query(
    "iso_time_part",
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS time
    FROM events""",
)
def _(spark, sf):
    text = F.expr(
        "CASE WHEN event_id % 4 <> 0 THEN replace(cast(ts as string), ' ', 'T') ELSE substring(cast(ts as string), 1, 10) END"
    )
    return table(spark, sf, "events").select("event_id", iso_time_part(text).alias("time"))


@CHECKS.query(
    "build_traces",
    f"""WITH c AS (SELECT conv_id, turn, role, {WORDS_SQL.format('text')} AS p,
        lead(role) OVER w AS next_role, lead({WORDS_SQL.format('text')}) OVER w AS c
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, 'agent' || (conv_id % 5) AS agent_name, p AS prompt_tokens, c AS completion_tokens,
      p + c AS total_tokens, round({COST_SQL.format(parity='conv_id', p='p', c='c')}, 8) AS cost, NULL::DOUBLE AS latency
    FROM c WHERE role = 'user' AND next_role = 'assistant'""",
)
def _(spark, sf):
    agent = F.concat(F.lit("agent"), F.col("conv_id") % 5)
    return build_traces(table(spark, sf, "conversations"), agent, model_name(F.col("conv_id")))


@CHECKS.query(
    "trace_totals",
    f"""WITH {EVENT_TRACES_SQL} SELECT sum(total_tokens)::BIGINT AS total_tokens, round(sum(cost), 6) AS total_cost,
      round(avg(latency), 8) AS avg_latency FROM traces""",
)
def _(spark, sf):
    return rounded(rounded(trace_totals(event_traces(spark, sf)), 6, "total_cost"), 8, "avg_latency")


@CHECKS.query(
    "trace_cost_by_agent",
    f"""WITH {EVENT_TRACES_SQL} SELECT agent_name, round(sum(cost), 7) AS cost,
      round(sum(cost) / (SELECT sum(cost) FROM traces), 8) AS share FROM traces GROUP BY agent_name""",
)
def _(spark, sf):
    return rounded(rounded(trace_cost_by_agent(event_traces(spark, sf)), 7, "cost"), 8, "share")


@CHECKS.query(
    "trace_latency_by_agent",
    f"WITH {EVENT_TRACES_SQL} SELECT agent_name, round(avg(latency), 8) AS avg_latency FROM traces GROUP BY agent_name",
)
def _(spark, sf):
    return rounded(trace_latency_by_agent(event_traces(spark, sf)), 8, "avg_latency")


@CHECKS.query(
    "trace_display",
    f"""WITH {EVENT_TRACES_SQL} SELECT agent_name, prompt_tokens, completion_tokens, total_tokens,
      '$' || cost::VARCHAR::DECIMAL(30, 20)::DECIMAL(18, 6)::VARCHAR AS cost,
      latency::VARCHAR::DECIMAL(30, 20)::DECIMAL(18, 3)::VARCHAR || 's' AS latency, strftime(created_at, '%H:%M:%S') AS time FROM traces""",
)
def _(spark, sf):
    stamp = F.expr("replace(cast(created_at as string), ' ', 'T')")
    return trace_display(event_traces(spark, sf), stamp)
