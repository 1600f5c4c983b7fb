"""The stages on the given documents against plain versions, and on odd tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.test_neardup import plain
from tests.llm.test_secret_scan import WHOLE
from tests.llm.test_secret_scan import plain as plain_spans
from tests.llm.test_sharding_packing import gapless

MIDDLE = "/root/testdata/sf0.01"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "123 456", "en", "s", 7), (4, "the dog and the cat were here today again", "en", "s", 41),
    (4, "the dog and the cat were here today again", "en", "s", 41), (5, "the dog and the cat were here today again", "en", None, 41),
    (None, "der Hund und die Katze sind heute wieder hier token=abcdef1", "de", "s", 55), (7, "der Hund schläft " * 20000, "de", "s", 340000),
]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, in order."""
    folder, found = tmp_path_factory.mktemp("stages"), {"documents": spark.read.parquet(f"{MIDDLE}/documents.parquet")}
    docs = found["documents"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MIDDLE).write.parquet(f"{folder}/{name}")
        docs = found[name] = spark.read.parquet(f"{folder}/{name}")
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_registered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_removal", "best_fit_packing"]
    assert contract.queries()["pipeline"] is corpus_pipeline.run


def test_languages_keep_clean_documents(kept):
    before, after = rows(kept["documents"]), rows(kept["language_id"])
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    assert all(after[i] == before[i] for i in after)


def test_near_dedup_keeps_one_of_each_group(kept):
    before, after = rows(kept["language_id"]), rows(kept["near_dedup"])
    _, group = plain({i: r.text for i, r in before.items()}, 5)
    assert set(after) == set(group.values()) and len(after) < len(before)


def test_decontamination_takes_only_leaks(spark, kept):
    words = lambda t: f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "
    items = [words(r.text) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    before, after = rows(kept["near_dedup"]), rows(kept["decontamination"])
    assert set(after) == {i for i, r in before.items() if not any(x in words(r.text) for x in items)} and len(after) < len(before)


def test_secrets_are_marked(kept):
    before, after = rows(kept["decontamination"]), rows(kept["secret_removal"])
    assert set(after) == set(before)
    changed = 0
    for i, r in after.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(before[i].text)]
        want, at = "", 0
        for a, b in spans:
            if a >= at:
                want += before[i].text[at:a] + "[secret]"
            at = max(at, b)
        want += before[i].text[at:]
        assert r.text == want and r.n_chars == len(want)
        changed += bool(spans)
    assert changed and WHOLE


def test_packing_has_every_document(kept):
    found = kept["best_fit_packing"].collect()
    assert {r.doc_id for r in found} == set(rows(kept["secret_removal"]))
    assert gapless(found, 1024) <= 1.01 * -(-sum(r.length for r in found) // 1024)


def test_run_is_the_stages_in_order(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.count() == got.select("doc_id", "piece").distinct().count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_and_empty_documents(spark, small, name, stage):
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, spans string, label double")
    got = stage(spark, docs, small)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == list(corpus_pipeline.COLUMNS)
    kept_ids = Counter(r.doc_id for r in got.collect())
    want = {
        "language_id": Counter({4: 2, 5: 1, None: 1, 7: 1}),
        "near_dedup": Counter({1: 1, 2: 1, 3: 1, 4: 2, None: 1, 7: 1}),
    }.get(name, Counter({1: 1, 2: 1, 3: 1, 4: 2, 5: 1, None: 1, 7: 1}))
    assert kept_ids == want or (name == "best_fit_packing" and set(kept_ids) == set(want))
    assert stage(spark, docs.limit(0), small).count() == 0


def test_queries_read_whole_tables(spark, small):
    total = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op1_language_id", "op2_secret_scan", "op5_minhash_near_dedup", "op7_imatch_fingerprints", "op9_balanced_sharding"):
        assert contract.queries()[name](spark, small).select(F.count_distinct("doc_id")).first()[0] == total
