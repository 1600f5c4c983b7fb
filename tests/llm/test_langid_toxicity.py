"""Language identification and toxicity: held-out accuracy, a plain version of the scores, and odd inputs."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulark.llm import langid, toxicity, workload
from tabulark.llm.gru import Network, tokens, windows
from tabulark.llm.words import blocks

MIDDLE = "/root/testdata/sf0.01"

LANGS = [("the cat and the dog were here", "en"), ("der Hund und die Katze sind hier", "de"), ("le chat et le chien sont ici", "fr")] * 3


def test_language_on_held_out_rows(spark):
    found = workload.op1_language_id(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet"), "doc_id")
    row = found.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row.n > 200 and row.right > 0.97


def test_language_scores_against_plain_naive_bayes(spark):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(LANGS)], "id long, t string, g string")
    model = langid.fit(train, "t", "g", buckets=1 << 20)
    text = "le chien et the dog"
    grams = lambda s: [f" {s.lower()} "[i : i + n] for n in (1, 2, 3) for i in range(len(s) + 3 - n)]
    logs = []
    for g in model.languages:
        counts = Counter(x for t, of in LANGS if of == g for x in grams(t))
        total = sum(counts.values()) + 0.5 * (1 << 20)
        logs.append(sum(math.log((counts[x] + 0.5) / total) for x in grams(text)))
    got = langid.predict(spark.createDataFrame([(text,)], "t string"), "t", model).first()
    share = np.exp(np.array(logs) - max(logs))
    assert got.lang_pred == model.languages[int(np.argmax(logs))]
    assert got.score == pytest.approx(share.max() / share.sum(), abs=1e-3)


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(t, g) for t, g in LANGS] + [(None, "en"), ("", "de"), ("the", None)], "t string, g string")
    model = langid.fit(train, "t", "g")
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog " * 50000), (5, "the dog"), (5, "the dog"), (None, "der Hund"), (7, "\U0001d400 \U0001f600")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "id long, t string, lang_pred string, score string")
    got = langid.predict(df, "t", model).collect()
    assert [(r.id, r.lang_pred) for r in got][:7] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (5, "en"), (None, "de")]
    assert all(r.score == 0 for r in got[:3]) and all(0 <= r.score <= 1 for r in got)
    nothing = langid.fit(train.limit(0), "t", "g")
    assert {r.lang_pred for r in langid.predict(df, "t", nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), "t", model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(train, "t", "g", max_languages=2)


def test_network_gradients():
    words = tokens(next(blocks(pa.array(["a good day you fool of a took", "nothing here"]))))
    network = Network(3)
    places, _ = windows(np.array([8, 2]), 8, 4, 10)
    places, label = np.append(words.token, len(words.bucket))[places], np.array([1, 0])

    def loss():
        p = 1 / (1 + np.exp(-network.run(network.projected(network.inputs(words)), places).astype(float)))
        return -np.mean(np.log(np.where(label > 0, p, 1 - p)))

    for name in ("out", "focus", "attend", "rec_f", "rec_b", "in_f", "in_b", "in_b_f"):
        network.p[name] = network.p[name].astype(np.float64)
    seen = {}
    network._adam = lambda g, rate: seen.update(g)
    network._sparse = lambda name, rows, grad, rate: seen.update({name: (rows, grad)})
    network.learn(words, places, label, 0.0)
    for name in ("out", "focus", "attend", "rec_f", "rec_b", "in_f", "in_b", "in_b_f"):
        flat, at = network.p[name].reshape(-1), np.abs(seen[name]).argmax()
        flat[at] += 1e-4
        up = loss()
        flat[at] -= 2e-4
        down = loss()
        flat[at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(seen[name].reshape(-1)[at], rel=0.02, abs=1e-5)


def test_windows_cover_every_token():
    for n in (0, 1, 15, 16, 17, 24, 25, 100):
        at, text = windows(np.array([n, 3]), 16, 8, 10**6)
        assert set(at[text == 0].ravel()) - {10**6} == set(range(n))
        assert (text == 0).sum() == (1 if n <= 16 else 1 + -(-(n - 16) // 8))


def test_toxicity_finds_marked_words(spark):
    clean = ["alpha beta gamma delta epsilon zeta eta theta"[i % 7 :] + f" word{i % 13} " + "iota kappa lambda " * (i % 9) for i in range(300)]
    rows = [(i, t + (" you vilest" + "xyz"[i % 3] + " one" if i % 3 == 0 else ""), int(i % 3 == 0)) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "id long, t string, y int")
    labels = df.select("id", "y")
    model = toxicity.fit(df.drop("y"), labels.filter("id < 200"), "id", "t", "y")
    got = toxicity.predict(df.withColumn("score", F.lit("old")), "t", model).collect()
    rest = [r for r in got if r.id >= 200]
    assert sum(r.predicted == r.y for r in rest) / len(rest) > 0.95
    long = toxicity.predict(spark.createDataFrame([(1, clean[0] * 3000 + " vilestx " + clean[1] * 3000), (2, None), (3, "")], "id long, t string"), "t", model).collect()
    assert [r.predicted for r in long] == [1, 0, 0] and long[1].score == long[2].score


def test_toxicity_without_both_labels(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 1), (3, None, 1), (4, "d", None)], "id long, t string, y int")
    model = toxicity.fit(df.drop("y"), df.select("id", "y"), "id", "t", "y")
    assert {r.predicted for r in toxicity.predict(df, "t", model).collect()} == {0}
    empty = toxicity.fit(df.drop("y").limit(0), df.select("id", "y").limit(0), "id", "t", "y")
    assert {round(r.score, 3) for r in toxicity.predict(df, "t", empty).collect()} == {0.5}
    assert toxicity.predict(df.limit(0), "t", model).count() == 0


def test_toxicity_query(spark):
    found = workload.op8_toxicity(spark, MIDDLE)
    assert found.count() == 1000 and found.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
