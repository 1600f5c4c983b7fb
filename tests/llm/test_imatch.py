"""Fingerprints of equal and edited texts, document frequencies, and the order of successors."""

import hashlib
import re
from collections import Counter

import numpy as np

from tabulark.llm import imatch, workload


def words(text):
    return set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def test_document_frequencies_against_a_count(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = Counter(w for r in docs.collect() for w in words(r.text))
    got = imatch.document_frequencies(docs, "text").collect()
    assert Counter(r.n for r in got) == Counter(want.values())
    band = imatch.fit(docs, "text", imatch.Band(0.02, 0.2))
    assert len(band) == sum(4 <= n <= 40 for n in want.values()) and (np.diff(band.astype(object)) > 0).all()


def check(rows, got):
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        n = len(text or "")
        edited = (text or "")[: n - n // 2] + (following or "")[: n // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == n


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: r for r in workload.op7_imatch_fingerprints(spark, small).collect()}
    assert len(got) == len(rows)
    check(rows, got)
    by_text = {}
    for i, text in rows:
        by_text.setdefault(text, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) < len(rows)
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > 5 * mean("near_next")


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "_ROWS", 20)
    rows = [(i * 3, f"text é🎉 number {i} " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in imatch.with_edited(df, "doc_id", "text", imatch.fit(df, "text", imatch.Band(0.01, 0.9))).collect()}
    assert len(got) == 300
    check(rows, got)


def test_likeness():
    a = np.zeros(imatch.LEXICONS, np.uint16)
    b = a.copy()
    a[:4], b[:4] = [1, 2, 3, 0], [1, 5, 0, 7]
    assert imatch.likeness(a, b) == 0.25 and imatch.likeness(a, a) == 1 and imatch.likeness(a, a[:8]) == 0


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(imatch, "_ROWS", 2)
    rows = [(5, None), (4, ""), (4, ""), (4, "b"), (None, "c"), (None, "c"), (None, None), (3, "word " * 50000), (2, "x")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string")
    got = imatch.with_edited(df, "doc_id", "text", imatch.fit(df, "text")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 1), (0, 1), (2, 1), (3, 250000), (4, 0), (4, 0), (4, 1), (5, 0)]
    empty = [r for r in got if r.n_chars == 0]
    assert len({r.fingerprint for r in empty}) == 1 and all(r.near_edited == 1 for r in got if r.n_chars < 2)
    one = df.filter("doc_id = 2")
    assert imatch.with_edited(one, "doc_id", "text", imatch.fit(one, "text")).first().near_next == 1
    none = df.limit(0)
    assert imatch.with_edited(none, "doc_id", "text", imatch.fit(none, "text")).count() == 0
