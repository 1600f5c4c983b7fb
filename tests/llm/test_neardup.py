"""Near duplicates against all pairs, components against union-find, and odd rows."""

import random
import re

import pytest

from tabulark.llm import neardup, workload
from tabulark.llm.components import components

MIDDLE = "/root/testdata/sf0.01"


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(found[i : i + words]) for i in range(max(len(found) - words, 0) + 1)) if found else frozenset()


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def plain(texts, words):
    sets = {i: shingles(t, words) for i, t in texts.items()}
    ids = sorted(sets)
    pairs = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))
        and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return {i: len(s) for i, s in sets.items()}, groups(pairs, ids)


def near_copies(count, seed):
    """Families of texts that differ in a few words, some of them exactly at the threshold."""
    chance = random.Random(seed)
    texts = {}
    for family in range(count):
        base = [f"w{chance.randrange(4000)}" for _ in range(chance.randrange(3, 120))]
        for _ in range(chance.randrange(1, 9)):
            copy = list(base)
            for _ in range(chance.randrange(0, 1 + len(base) // 12)):
                copy[chance.randrange(len(copy))] = f"x{chance.randrange(4000)}"
            texts[len(texts) * 7 + 5] = (" " if family % 2 else "\n").join(copy)
    return texts


@pytest.mark.parametrize("words", [2, 5])
def test_against_all_pairs(spark, words):
    texts = near_copies(60, words)
    sizes, want = plain(texts, words)
    df = spark.createDataFrame(list(texts.items()), "id long, t string").repartition(5)
    got = neardup.near_duplicates(df, "id", "t", neardup.Forest(words=words)).collect()
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (sizes[i], want[i], want[i] == i) for i in texts}


def test_one_large_group_of_near_copies(spark):
    chance = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(1500):
        copy = list(base)
        copy[chance.randrange(80)] = f"x{i}"
        texts[i] = " ".join(copy)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t", neardup.Forest(words=2))
    assert {(r.component_id, r.kept) for r in got.filter("id > 0").collect()} == {(0, False)}


@pytest.mark.parametrize("words,changed", [(2, 13), (5, 5)])
def test_edited_copies_of_one_original_that_are_not_similar_to_each_other(spark, words, changed):
    chance = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = {1000: " ".join(base)}
    for i in range(600):
        copy = list(base)
        for at in chance.sample(range(300), changed):
            copy[at] = f"x{i}_{at}"
        texts[i] = " ".join(copy)
    sizes, want = plain(texts, words)
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = neardup.near_duplicates(df, "id", "t", neardup.Forest(words=words)).collect()
    assert {r.id: r.component_id for r in got} == want and len(set(want.values())) < 20


def chain(length, seed):
    """Each text has a few words changed against the one before, so the ends have nothing in common."""
    chance, words, texts = random.Random(seed), [f"w{i}" for i in range(120)], {}
    for i in range(length):
        words = list(words)
        for at in chance.sample(range(120), 3):
            words[at] = f"c{seed}_{i}_{at}"
        texts[i] = " ".join(words)
    return texts


def mixed_crowd(count, seed):
    """Families in one form: half of the words are the same in all of them, a family shares the others but for a few."""
    chance, form, texts = random.Random(seed), [f"form{i}" for i in range(150)], {}
    while len(texts) < count:
        own = [f"f{seed}_{len(texts)}_{i}" for i in range(30)]
        for _ in range(chance.randrange(1, 40)):
            copy = form + [w if chance.random() > 0.15 else f"x{chance.random()}" for w in own]
            texts[len(texts)] = " ".join(copy)
    return texts


@pytest.mark.parametrize("texts", [chain(60, 1), mixed_crowd(100, 2)], ids=["chain", "mixed"])
def test_recall_in_crowds(spark, texts):
    """Of the pairs of one component by all pairs nine in ten at least are in one component here, and none is that should not be."""
    _, want = plain(texts, 2)
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = {r.id: r.component_id for r in neardup.near_duplicates(df, "id", "t", neardup.Forest(words=2)).collect()}
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    found = sum(got[a] == got[b] for a, b in pairs)
    print("recall", found / len(pairs), len(set(want.values())), len(set(got.values())))
    assert found >= 0.9 * len(pairs) and all(want[i] == want[got[i]] for i in want)


def test_rounds_that_find_nothing_lose_no_link(spark, monkeypatch):
    """What the rounds leave apart is compared in full: even if they connect nothing, the result is that of all pairs."""
    texts = mixed_crowd(100, 2)
    _, want = plain(texts, 2)
    nothing = lambda docs, known, full, forest: known.selectExpr("id AS a", "id AS b").limit(0)
    monkeypatch.setattr(neardup, "_crowded", nothing)
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    assert {r.id: r.component_id for r in neardup.near_duplicates(df, "id", "t", neardup.Forest(words=2)).collect()} == want


def test_exact_option(spark):
    texts = mixed_crowd(120, 4)
    _, want = plain(texts, 2)
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    assert {r.id: r.component_id for r in neardup.near_duplicates(df, "id", "t", neardup.Forest(words=2), exact=True).collect()} == want


def test_query_against_all_pairs(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sizes, want = plain(docs, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in workload.op5_minhash_near_dedup(spark, small).collect()}
    assert got == {i: (sizes[i], want[i]) for i in docs} and len(set(want.values())) < len(docs)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c"), (6, "a b c"), (None, "a b c"), (9, "é " * 90000), (8, "é " * 90000), (7, "one two")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = neardup.near_duplicates(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [
        (0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True),
        (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False),
    ]
    assert neardup.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_components_against_union_find(spark):
    chance = random.Random(2)
    for n, m in ((50, 30), (300, 260), (40, 400)):
        edges = [(chance.randrange(n), chance.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1100)]
        want = groups(edges, {x for e in edges for x in e})
        got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
        assert got == {x: c for x, c in want.items() if x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
