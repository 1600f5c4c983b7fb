"""One query per operator over the whole tables, with a SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.llm import decontaminate, imatch, langid, linededup, neardup, packing, pages, repair, secret_scan, sharding, token_counts, toxicity, whitening
from tabulark.llm.tables import held_out, written

#: The tokenizer file, by its name among the public tokenizers.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out())
    model = langid.fit(docs.filter("not held_out"), "text", "lang")
    return langid.predict(docs.drop("lang"), "text", model).select("doc_id", "held_out", "lang_pred", "score")


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRET_KINDS = (
    ("assign", _ASSIGN, 2, 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20, 0),
    ("hex", "[0-9a-f]+", 0, 24, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, 0),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, 0),
)
_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {no} AS no, {least} AS least, {value} AS least_value, "
    f"string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d"
    for no, (kind, p, group, least, value) in enumerate(_SECRET_KINDS)
)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
s AS (
  SELECT doc_id, kind, no, length(m[i]) AS size,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
  FROM i WHERE length(m[i]) >= least AND length(v[i]) >= least_value),
f AS (
  SELECT doc_id, sum((no = 0)::INT) AS na, sum((no = 1)::INT) AS nk, sum((no = 2)::INT) AS nh,
    coalesce(string_agg(kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT, ',' ORDER BY a, no) FILTER (WHERE no < 3), '') AS base,
    string_agg(kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT, ',' ORDER BY a, no) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nk, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON d.doc_id = f.doc_id
"""


@query("op2_secret_scan", _SECRETS)
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secret_scan.scan(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    base = secret_scan.of_kinds(F.col("spans"), secret_scan.BASE)
    number = [
        F.size(secret_scan.of_kinds(F.col("spans"), (rule,))).cast("long").alias(f"n_{rule.kind}") for rule in secret_scan.BASE
    ]
    return findings.select(
        "doc_id", *number, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans")
    )


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized(_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces).drop("piece_key")


_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w),
c AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM c),
e AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, other) AS (SELECT rep, rep FROM c UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
g AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN g ON g.node = c.rep
"""


@query("op5_minhash_near_dedup", _NEAR)
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", neardup.Forest(words=2))


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", benchmark, "item_id", "text")


@query("op9_balanced_sharding")
def op9_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nodes = docs.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.unhex(F.md5("text")).alias("link"),
        F.monotonically_increasing_id().alias("key"),
    )
    found = sharding.balanced_shards(written(nodes, "nodes"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_imatch_fingerprints")
def op7_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return imatch.with_edited(docs, "doc_id", "text", imatch.fit(docs, "text"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    return toxicity.predict(docs, "text", model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


# For pages whose text is in one article element, with the character references that the tables have.
_MAIN_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g') AS a FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(a, '<[^>]*>'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS b FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS t FROM b),
d AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS text FROM t)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""


@query("op4_html_main_text", _MAIN_TEXT)
def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return token_counts.attributed(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER))


_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
d AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, d.k IS NOT NULL AND doc_id < keeper AS gone FROM k LEFT JOIN d ON k.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op13_line_dedup", _LINES)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    kept = linededup.kept_text(docs, "doc_id", "text", linededup.line_bitmaps(docs, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


_REPAIR = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS no,
    list_reduce(list_concat([4294967295], list_transform(
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))) AS c
  FROM conversations),
k AS (SELECT *, xor(c, 4294967295) % 20 AS kind FROM o),
r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, no, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS again
  FROM k WHERE kind <> 0),
n AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(role[1]) OVER w AS previous,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, no, again) > 1 AS again_seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, no, again)),
f AS (
  SELECT *, final = '' AS blank, final <> '' AND again_seen AS duplicate, final <> '' AND NOT again_seen AND final NOT IN ('.', '!', '?') AS truncated,
    previous IS NOT NULL AND previous || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM n),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS b FROM f
  UNION ALL
  SELECT conv_id, i, to_s, min(b) FROM (
    SELECT x.conv_id, x.i + 1 AS i,
      CASE e WHEN 'D' THEN x.s WHEN 'R' THEN CASE x.s WHEN 2 THEN 3 ELSE 2 END ELSE CASE f.role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS to_s,
      {'cost': x.b.cost + CASE e WHEN 'D' THEN 2 ELSE (e = 'R')::INT + 5 * f.truncated::INT END, 'audit': x.b.audit || e,
       'lines': CASE e WHEN 'D' THEN x.b.lines WHEN 'K' THEN list_append(x.b.lines, f.role || ':' || f.text)
         ELSE list_append(x.b.lines, CASE x.s WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text) END} AS b
    FROM (
      SELECT conv_id, i, CASE WHEN q = 0 THEN s WHEN (s = 2) = (q = 2) THEN 2 ELSE 3 END AS s,
        {'cost': b.cost + 5 * q, 'audit': b.audit || repeat('I', q::INT),
         'lines': list_concat(b.lines, (CASE s WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)[1:q])} AS b
      FROM best, (SELECT unnest(range(3)) AS q)) x
    JOIN f ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.i, (SELECT unnest(['D', 'K', 'R']) AS e)
    WHERE e = 'D' OR NOT f.blank AND NOT f.duplicate AND (e = 'R' OR f.role[1] = 's' AND x.s = 0 OR f.role[1] = 'u' AND x.s IN (0, 1, 3) OR f.role[1] = 'a' AND x.s = 2))
  GROUP BY conv_id, i, to_s),
done AS (
  SELECT best.conv_id, min({'cost': b.cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': b.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'lines': list_concat(b.lines, CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS b
  FROM best JOIN (SELECT conv_id, max(n) AS n FROM f GROUP BY conv_id) z ON best.conv_id IS NOT DISTINCT FROM z.conv_id AND best.i = z.n GROUP BY best.conv_id),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(done.b.cost, 0)::BIGINT AS cost, coalesce(done.b.audit, '') AS audit,
  sha256(coalesce(array_to_string(done.b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults ON c.conv_id IS NOT DISTINCT FROM faults.conv_id
LEFT JOIN done ON c.conv_id IS NOT DISTINCT FROM done.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by the checksum of their id and turn; a dropped row only names its conversation (``present`` is false)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")


@query("op11_conversation_repair", _REPAIR)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    pieces = repair.repaired_pieces(rows, "conv_id", "turn", "role", "text", "present")
    return repair.summaries(pieces).withColumnRenamed("conv", "conv_id")
