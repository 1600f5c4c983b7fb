"""Line dedup against a plain version, with ranges so small that groups go over their edges."""

import random
import re
from collections import defaultdict

import pytest

from tabulark.llm import linededup

SPACE = " \t\n\x0b\f\r"


def plain(rows, least_chars=20, least_documents=3):
    """Per row (id, text): n_lines, n_dropped and the kept text."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    where = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least_chars:
                where[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(where[key(x)]) < least_documents or doc == max(where[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(spark, rows, parts=None):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc long, text string, keep string, pos string")
    marks = linededup.line_bitmaps(df, "doc", "text")
    return sorted((tuple(r) for r in linededup.kept_text(df, "doc", "text", marks).collect()), key=repr)


def test_small_cases(spark):
    line = "this line is long enough to count"
    cases = [
        [],
        [(1, None), (2, ""), (3, "\n\n"), (None, None)],
        [(1, line), (2, line), (3, f"  {line.upper()}\t\n{line}\r"), (4, "short\nshort")],
        [(1, f"{line}\nx\n{line}"), (2, line), (2, line), (2, f"y\n{line}")],
        [(1, line), (2, line), (2, line + " "), (None, line), (3, f"{line}\n{line}")],
        [(i, "Größe und ÄRGER stehen hier\nGRÖSSE und ärger stehen hier\n" + "é" * 20) for i in range(5)],
        [(i, "a" * 19 + "\n" + "b" * 20 + "\n" + "c" * 18 + "  ") for i in range(4)],
        [(-(2**63), line), (2**63 - 1, line), (0, line)],
    ]
    for rows in cases:
        assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_documents_over_many_ranges(spark, seed):
    rng = random.Random(seed)
    pool = [f"line number {i} of the common pool" for i in range(30)]
    rows = []
    for doc in range(300):
        lines = [rng.choice(pool[: rng.choice((1, 5, 30))]) if rng.random() < 0.6 else f"own {rng.random()} of {doc} alone" for _ in range(rng.randrange(12))]
        lines += [pool[0]] * (doc % 3)
        rows.append((doc if rng.random() < 0.97 else None, "\n".join(lines)))
        if rng.random() < 0.05:
            rows.append(rows[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert found(spark, rows) == plain(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_line_in_all_documents_and_a_long_document(spark):
    rows = [(i, "the same line in each document\n" + f"only document {i} has this line") for i in range(3000)]
    rows.append((5000, "\n".join(f"line {i % 40_000} of a very long one" for i in range(200_000))))
    rows += [(6000 + i, "line 7 of a very long one") for i in range(2)]
    assert found(spark, rows) == plain(rows)


def test_bitmaps_hold_no_text(spark):
    rows = [(i, "the same line in each document\nown") for i in range(4)]
    df = spark.createDataFrame(rows, "doc long, text string")
    got = linededup.line_bitmaps(df, "doc", "text")
    assert got.columns == ["doc", "text_key", "n_lines", "n_dropped", "keep"]
    assert {r.doc: (r.n_lines, r.n_dropped, r.keep is None) for r in got.collect()} == {i: (2, int(i < 3), i == 3) for i in range(4)}
