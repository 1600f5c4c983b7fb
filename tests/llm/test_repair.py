"""Conversation repair against a plain search over all edits, with pieces of a few rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tabulark.llm import repair, workload

SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    return out


def best(rows, faulty, unfinished):
    """Cheapest (cost, audit, lines) over all edits, by extending every prefix of roles that can still be completed."""
    after = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    word = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(2):
            for last, (cost, audit, lines) in list(states.items()):
                for x in after[last] & {"u", "a"}:
                    way = (cost + 5, audit + "I", lines + [word[x] + ":"])
                    states[x] = min(states.get(x, way), way)
        return states

    states = {"": (0, "", [])}
    for (role, text), bad, cut in zip(rows, faulty, unfinished):
        new = {}
        for last, (cost, audit, lines) in inserted(states).items():
            ways = [(last, (cost + 2, audit + "D", lines))]
            if not bad:
                more = 5 if cut else 0
                ways += [(x, (cost + 1 + more, audit + "R", lines + [f"{word[x]}:{text}"])) for x in after[last] & {"u", "a"}]
                if role[:1] and role[:1] in after[last]:
                    ways.append((role[:1], (cost + more, audit + "K", lines + [f"{role}:{text}"])))
            for x, way in ways:
                new[x] = min(new.get(x, way), way)
        states = new
    states = inserted(states)
    return min(states[x] for x in ("", "a") if x in states)


def plain(rows):
    """rows: (conv, turn, role, text, present) in the order read."""
    convs = defaultdict(list)
    for conv, turn, role, text, present in rows:
        convs[conv] += [(turn, " " if role is None else role, " " if text is None else text)] if present else []
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        n = Counter(faults)
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = best([r[1:] for r in own], [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, **limits):
    df = spark.createDataFrame([(*r, "more", 1) for r in rows], "conv long, turn long, role string, text string, present boolean, audit string, part int")
    got = repair.summaries(repair.repaired_pieces(df, "conv", "turn", "role", "text", "present", **limits)).collect()
    out = {r[0]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def rows_of(rng, convs, longest):
    texts = ["Yes.", "No!", "Why?", "open end", "", " \t", "Text. ", "x\n", "more.", "end? "] + [f"own {i}." for i in range(30)]
    roles = ["user", "assistant"] * 6 + ["system", "tool", None, "", "ux", "s"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(longest)):
            at = None if rng.random() < 0.05 else turn + (rng.random() < 0.1) * rng.randrange(9)
            rows.append((conv if conv else None, at, rng.choice(roles), rng.choice([*texts, None]), rng.random() < 0.95))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rows = rows_of(random.Random(seed), 150, 14)
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("most_rows", (1, 2, 5))
def test_conversations_in_many_chunks(spark, most_rows):
    rows = rows_of(random.Random(10 + most_rows), 12, 40)
    assert found(spark, rows, most_rows=most_rows) == plain(rows)


def test_a_conversation_over_all_ranges(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(("user", "assistant", "system")), f"{rng.randrange(40)}{rng.choice('.!? x')}", True) for i in range(3000)]
    rows += [(i, 0, "user", "Hello.", True) for i in range(8, 40)]
    assert found(spark, rows, most_rows=100) == plain(rows)


def test_odd_tables(spark):
    long = "a" * 3_000_000 + "."
    cases = [
        [],
        [(1, 0, "user", "Hi.", False), (2, None, None, None, True)],
        [(1, None, "user", "Same.", True)] * 50 + [(1, 3, "assistant", "Yes.", True)],
        [(None, 5, "system", "Be kind.", True), (None, 9, "user", "Hi.", True)],
        [(1, 0, "user", long, True), (1, 1, "assistant", long, True), (1, 2, "user", long, True), (2, 0, "assistant", long, True)],
    ]
    for rows in cases:
        assert found(spark, rows) == plain(rows)


def test_costs_and_walks_without_spark():
    """Chunk matrices chain to the same costs as one backward pass."""
    rng = random.Random(1)
    for _ in range(300):
        symbols = [(rng.choice("sua") if rng.random() < 0.9 else rng.choice(("", "t")), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(12))]
        vector = repair.END
        for symbol in reversed(symbols):
            vector = repair._before(symbol, vector)
        cut = rng.randrange(len(symbols) + 1)
        one, two = repair.chunk_costs(symbols[:cut]), repair.chunk_costs(symbols[cut:])
        middle = [min(c + x for c, x in zip(line, repair.END)) for line in two]
        assert tuple(min(c + x for c, x in zip(line, middle)) for line in one) == vector
        letters, states, cost, end = repair.walk(symbols, 0, repair.END, True)
        assert cost == vector[0] and end in (0, 3) and sum(x != "I" for x in letters) == len(symbols)


def test_damage(spark):
    rows = rows_of(random.Random(3), 60, 12)
    df = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, workload.damaged(df).collect()), key=repr) == sorted(damaged([r[:4] for r in rows]), key=repr)


def test_query(spark, small):
    table = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = workload.op11_conversation_repair(spark, small)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain(damaged(table))
