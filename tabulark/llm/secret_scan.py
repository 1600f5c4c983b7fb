"""Secrets in every version of every text: an incremental ledger of blobs, in DataFrame operations only.

A blob is the SHA-256 of a text. The ledger has, for each blob, which rules (kind and version) have
read it and what they found. A scan reads one copy of each blob that the ledger lacks for some rule,
with those rules alone, and joins the findings of all blobs back to every path that holds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.llm.tables import written


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; a match counts if it and its group 2 (if any) are long enough, in code points."""

    kind: str
    pattern: str
    least: int = 1
    group_least: int | None = None
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Where a match is a whole run of one class of characters, its least length stands in the pattern: leftmost
# matches are the same, and the many short runs of ordinary text are no matches.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED

_SPANS = "array<struct<start:bigint,no:int,kind:string,end:bigint,rule:string>>"
LEDGER = f"blob string, rules array<string>, spans {_SPANS}"
#: Matches whose places are summed up at a time, so that a text with very many matches costs no quadratic copying.
_STEP = 256


def _spans(text: Column, rule: Rule, no: int) -> Column:
    """The spans of one rule: places are running sums over the gaps between matches and the matches."""
    pattern = F.lit(rule.pattern)
    pieces = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long")).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long")).alias("size"),
        F.transform(
            F.regexp_extract_all(text, pattern, F.lit(0 if rule.group_least is None else 2)),
            lambda x: F.length(x).cast("long"),
        ).alias("value"),
    )
    return F.when(text.rlike(rule.pattern), _placed(pieces, rule, no)).otherwise(F.array().cast(_SPANS))


def _placed(pieces: Column, rule: Rule, no: int) -> Column:
    steps = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _STEP).cast("int")), lambda i: F.slice(pieces, i * _STEP + 1, _STEP)
    )
    total = F.transform(
        steps, lambda step: F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x["gap"] + F.coalesce(x["size"], F.lit(0)))
    )
    empty = F.array().cast(_SPANS)

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        good = x["size"].isNotNull() & (x["size"] >= rule.least)
        if rule.group_least is not None:
            good &= x["value"] >= rule.group_least
        span = F.struct(
            start.alias("start"), F.lit(no).alias("no"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.lit(rule.key).alias("rule")
        )
        return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def step_spans(step: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(total, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x)
        return F.aggregate(step, F.struct(before.alias("at"), empty.alias("out")), place, lambda state: state["out"])

    return F.flatten(F.transform(steps, step_spans))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(
    versions: DataFrame, path: str, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """The findings of every row of ``versions``, and the ledger rows this scan adds.

    Findings: the path, its blob, and ``spans`` (start, kind, end in code points, end exclusive) in order of
    start, then of ``rules``; one row per row of ``versions``, repeated rows included. A null text is the
    empty text; null paths are kept and equal each other. Other columns are not read. An empty table gives
    no rows and adds nothing.
    """
    spark = versions.sparkSession
    source = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("blob", F.sha2("text", 256))
    known = empty_ledger(spark) if ledger is None else ledger
    keys = F.array(*[F.lit(r.key) for r in rules])
    # One copy of each blob. The texts move once, by (blob, path), so copies of a text do not meet in one task.
    first = source.groupBy("blob").agg(F.min(F.struct("path")).alias("first"))
    if ledger is not None:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        first = first.join(seen, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
        first = first.filter(F.size("todo") > 0)
    else:
        first = first.withColumn("todo", keys)
    first = first.select(F.col("blob").alias("new_blob"), F.col("first.path").alias("new_path"), "todo")
    fresh = source.join(first, F.expr("blob = new_blob and path <=> new_path"))
    found = [
        F.when(F.array_contains("todo", r.key), _spans(F.col("text"), r, no)).otherwise(F.array().cast(_SPANS))
        for no, r in enumerate(rules)
    ]
    added = fresh.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("spans")).dropDuplicates(["blob"])
    added = written(added, "ledger")
    # Few blobs hold anything, and only those are joined back.
    merged = known.unionByName(added).filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    merged = merged.withColumn("spans", F.array_sort(F.filter("spans", lambda s: F.array_contains(keys, s["rule"]))))
    findings = source.select("path", "blob").join(merged, "blob", "left")
    return (
        findings.select(
            F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")
        ),
        added,
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, rules: tuple[Rule, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*[r.kind for r in rules]))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark."""

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        piece = F.when((s["start"] >= state["at"]), F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(
        spans,
        start,
        step,
        lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)
