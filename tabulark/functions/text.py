"""Replies, tokens, costs and display strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price in dollars per million tokens, and words to tokens.
INPUT_RATE = 0.075
OUTPUT_RATE = 0.30
PRO_INPUT_RATE = 1.25
PRO_OUTPUT_RATE = 5.00
TOKENS_PER_WORD = 4

# Display names of the stages.
STAGE_LABELS = {
    "initial": "Baseline Stage",
    "hpo": "HPO Tuning",
    "replan": "Replan Improvement",
}

_FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
# White space in the Unicode sense plus the four separator controls.
_BLANK = r"(?U:[\s\x1C-\x1F])"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+\z", "")


def parse_fenced_json(text: Column) -> Column:
    """A reply as VARIANT: without code fences, else as it stands, else NULL."""
    return F.coalesce(F.try_parse_json(strip(F.regexp_replace(text, _FENCE, "$1"))), F.try_parse_json(strip(text)))


def strip_markdown_fence(text: Column) -> Column:
    """The text inside an enclosing Markdown fence."""
    result = strip(text)
    for pattern in (rf"^```markdown{_BLANK}*", rf"^```{_BLANK}*", rf"{_BLANK}*```\z"):
        result = strip(F.regexp_replace(result, pattern, ""))
    return result


def estimate_tokens(text: Column) -> Column:
    """Four tokens for every word; NULL text has none."""
    words = F.filter(F.split(text, _BLANK + "+"), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("bigint") * TOKENS_PER_WORD


def resolve_usage(payload: Column, prompt: Column, completion: Column) -> Column:
    """Token counts from the first usage block of a JSON payload, else estimated.

    `usage_metadata` comes first; then `token_usage` or `usage` in `response_metadata`,
    with prompt/completion or input/output names.
    """

    def read(path):
        return F.get_json_object(payload, path).cast("bigint")

    def non_zero(*paths):
        return F.coalesce(*[F.nullif(read(p), F.lit(0)) for p in paths], F.lit(0))

    def present(path):
        block = F.get_json_object(payload, path)
        return block.isNotNull() & ~block.isin("{}", "null", "")

    def usage(p, c, t):
        return F.struct(
            F.coalesce(p, F.lit(0)).cast("bigint").alias("prompt_tokens"),
            F.coalesce(c, F.lit(0)).cast("bigint").alias("completion_tokens"),
            F.coalesce(t, F.lit(0)).cast("bigint").alias("total_tokens"),
        )

    direct = usage(
        read("$.usage_metadata.input_tokens"),
        read("$.usage_metadata.output_tokens"),
        read("$.usage_metadata.total_tokens"),
    )

    def nested(root):
        p = non_zero(f"{root}.prompt_tokens", f"{root}.input_tokens")
        c = non_zero(f"{root}.completion_tokens", f"{root}.output_tokens")
        return usage(p, c, F.coalesce(F.nullif(read(f"{root}.total_tokens"), F.lit(0)), p + c))

    found = (
        F.when(present("$.usage_metadata"), direct)
        .when(present("$.response_metadata.token_usage"), nested("$.response_metadata.token_usage"))
        .when(present("$.response_metadata.usage"), nested("$.response_metadata.usage"))
    )
    p, c = estimate_tokens(prompt), estimate_tokens(completion)
    return F.when(F.coalesce(found["total_tokens"], F.lit(0)) == 0, usage(p, c, p + c)).otherwise(found)


def llm_cost(prompt_tokens: Column, completion_tokens: Column, model: Column) -> Column:
    """Dollars for a call to 8 decimals, at the higher rates if the model name holds `pro`.

    Counted in units of 1e-8 dollars, where the rates are exact, so halves round up for certain.
    """
    pro = model.contains("pro")

    def units(rate: float) -> Column:
        return F.lit(round(rate * 100, 6))

    rate_in = F.when(pro, units(PRO_INPUT_RATE)).otherwise(units(INPUT_RATE))
    rate_out = F.when(pro, units(PRO_OUTPUT_RATE)).otherwise(units(OUTPUT_RATE))
    return F.round(prompt_tokens * rate_in + completion_tokens * rate_out) / 1e8


def stage_label(stage: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STAGE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, stage), stage)


def iso_time_part(stamp: Column) -> Column:
    """Time of day of an ISO timestamp without its fraction; other text unchanged."""
    after = F.split_part(stamp, F.lit("T"), F.lit(2))
    return F.when(stamp.contains("T"), F.split_part(after, F.lit("."), F.lit(1))).otherwise(stamp)


def format_metrics(metrics: Column) -> Column:
    """`f1=0.9000, rmse=1.2500` in the order of the map."""
    parts = F.transform(
        F.map_entries(metrics), lambda e: F.format_string("%s=%.4f", e["key"], e["value"])
    )
    return F.array_join(parts, ", ")
