"""Cheapest repairs of conversations whose roles must alternate.

A repair keeps, re-labels, deletes and inserts rows. The cost of the best way to go on from a row depends on
the role before it alone, so four numbers for each row, worked out backwards, say what to do when walking forward. They are
stored at every square root of n rows only and recomputed block by block on the way.

Rows are range-partitioned by conversation and turn. A conversation that lies within a range is
repaired there. One that reaches an edge, or is too long for one piece, is dealt with in chunks: each chunk is reduced to a
four by four matrix of costs, chains of these give the costs at the chunks' ends and then the roles at their starts, and all
chunks are walked at once. So no task holds a conversation, however long it is.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.tables import small_side, written

SPACE = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
#: What stands before a row: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 60
#: The state after a row that is inserted or re-labelled; it is a user's unless a user's stands before it.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_PAIRS = {"su", "ua", "au"}
#: Costs after the last row: a conversation may end empty or after an assistant's row.
END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, int, int, int]
#: Initial of the role, whether the row must go, whether its text is unfinished.
Symbol = tuple[str, bool, bool]


@functools.lru_cache(maxsize=65536)
def _before(symbol: Symbol, after: Vector) -> Vector:
    """The least costs from each state before a row, given those after it."""
    initial, must_go, unfinished = symbol
    own = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if not must_go:
            more = UNFINISHED if unfinished else 0
            ways.append(REROLE + more + after[_NEXT[state]])
            if (state, initial) in _KEPT:
                ways.append(more + after[_KEPT[state, initial]])
        own.append(min(min(ways), _NEVER))
    user = min(own[USER], INSERT + own[ASSISTANT])
    assistant = min(own[ASSISTANT], INSERT + own[USER])
    return min(own[START], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant


def _back(symbol: Symbol, after: Vector) -> Vector:
    """As ``_before``; vectors that differ by a constant are worked out once."""
    least = min(after)
    return tuple(min(least + x, _NEVER) for x in _before(symbol, tuple(x - least for x in after)))


def chunk_costs(symbols: Sequence[Symbol]) -> list[list[int]]:
    """The least cost from each state before the rows to each state after them."""
    columns = []
    for end in range(4):
        vector = tuple(0 if state == end else _NEVER for state in range(4))
        for symbol in reversed(symbols):
            vector = _back(symbol, vector)
        columns.append(vector)
    return [[columns[end][state] for end in range(4)] for state in range(4)]


def walk(symbols: Sequence[Symbol], state: int, after: Vector, last: bool) -> tuple[str, list[int], int, int]:
    """The ASCII-least cheapest edits from ``state`` on: their initials, the state after each, their cost and the final state.

    ``after`` has the costs behind the rows; if they are the ``last`` ones, what must still be inserted there is.
    Costs are stored at every square root of the rows, and a block's are recomputed when the walk comes to it.
    """
    n = len(symbols)
    step = max(1, math.isqrt(n))
    stored, vector = {n: after}, after
    for i in range(n - 1, -1, -1):
        vector = _back(symbols[i], vector)
        if i % step == 0:
            stored[i] = vector
    cost, letters, states = vector[state], [], []
    for begin in range(0, n, step):
        end = min(begin + step, n)
        block = [stored[end]]
        for i in range(end - 1, begin - 1, -1):
            block.append(_back(symbols[i], block[-1]))
        block.reverse()
        for i in range(begin, end):
            here, behind = block[i - begin], block[i - begin + 1]
            initial, must_go, unfinished = symbols[i]
            more = UNFINISHED if unfinished else 0
            while True:
                kept = _KEPT.get((state, initial))
                if here[state] == DELETE + behind[state]:
                    letter = "D"
                elif here[state] == INSERT + here[_NEXT[state]]:
                    letter, state = "I", _NEXT[state]
                elif not must_go and kept is not None and here[state] == more + behind[kept]:
                    letter, state = "K", kept
                else:
                    letter, state = "R", _NEXT[state]
                letters.append(letter)
                states.append(state)
                if letter != "I":
                    break
    if last:
        while state in (SYSTEM, USER):
            letters.append("I")
            state = _NEXT[state]
            states.append(state)
    else:
        cost -= after[state]
    return "".join(letters), states, cost, state


def _repaired(roles: list[str], texts: list[str], letters: str, states: list[int]) -> str:
    lines, i = [], 0
    for letter, state in zip(letters, states):
        if letter == "I":
            lines.append(f"{_ROLE[state]}:")
            continue
        if letter != "D":
            lines.append(f"{roles[i] if letter == 'K' else _ROLE[state]}:{texts[i]}")
        i += 1
    return "\n".join(lines)


def _blank(text: str) -> bool:
    return not text.strip(SPACE)


def _examined(roles: list[str], texts: list[str], turns: list[int | None], first: set[int] | None = None) -> tuple[list[Symbol], dict]:
    """The symbol of each row, and what is wrong with them; ``first`` has the places of rows that no earlier one equals."""
    if first is None:
        seen: dict[tuple[str, str], int] = {}
        for i, row in enumerate(zip(roles, texts)):
            seen.setdefault(row, i)
        first = set(seen.values())
    symbols, blank, duplicate, truncated = [], 0, 0, 0
    for i, (role, text) in enumerate(zip(roles, texts)):
        is_blank, repeated = _blank(text), i not in first
        unfinished = not is_blank and not repeated and text.rstrip(SPACE)[-1] not in ".!?"
        blank, duplicate, truncated = blank + is_blank, duplicate + (repeated and not is_blank), truncated + unfinished
        symbols.append((role[:1], is_blank or repeated, unfinished))
    known = [t for t in turns if t is not None]
    return symbols, {
        "blank": blank,
        "duplicate": duplicate,
        "truncated": truncated,
        "illegal": sum(a[:1] + b[:1] not in _PAIRS for a, b in zip(roles, roles[1:])),
        "first": roles[0][:1] if roles else None,
        "last": roles[-1][:1] if roles else None,
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "turns": len(set(known)),
    }


_RAW = "rows_at array<long>, roles array<string>, texts array<string>"
_FAULTS = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
_PIECE = f"{_FAULTS}, cost long, audit string, repaired string"
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _schema(conv: pa.DataType, fields: str) -> pa.Schema:
    return pa.schema([("conv", conv)] + [(name, _ARROW[kind]) for name, kind in (x.split() for x in fields.split(", "))])


def _streamed(most_rows: int, most_bytes: int, fields: str):
    """A task's sorted rows to pieces of the conversations that end inside it and to chunks of rows of the others."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size, conv, schema = TaskContext.get().partitionId(), 0, 0, None, None
        rows: list[tuple] = []
        open_here, out = True, []

        def chunk(whole: bool) -> dict:
            present = [r for r in rows if r[0]]
            turns, roles, texts = ([r[i] for r in present] for i in (1, 2, 3))
            at = {"conv": conv, "part": part, "seq": seq, "whole": whole}
            if not whole:
                return at | {"rows_at": turns, "roles": roles, "texts": texts}
            symbols, faults = _examined(roles, texts, turns)
            audit, states, cost, _ = walk(symbols, START, END, True)
            return at | faults | {"cost": cost, "audit": audit, "repaired": _repaired(roles, texts, audit, states)}

        held = 0
        for batch in batches:
            schema = schema or _schema(batch.schema.field(0).type, fields)
            for c, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if rows and c != conv:
                    out.append(chunk(not open_here))
                    seq, size, rows, open_here = seq + 1, 0, [], False
                elif rows and (len(rows) >= most_rows or size >= most_bytes):
                    open_here = True
                    out.append(chunk(False))
                    seq, size, rows = seq + 1, 0, []
                conv = c
                rows.append(row)
                size += len(row[2]) + len(row[3])
                held += len(row[2]) + len(row[3])
                if held > most_bytes:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], size
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, held = [], size
        if rows:
            yield pa.RecordBatch.from_pylist([chunk(False)], schema=schema)

    return stream


def _over_rows(schema_of: str, change):
    """``change`` (a row to a row) for each row of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                yield pa.RecordBatch.from_pylist([change(r) for r in part.to_pylist()], schema=_schema(part.schema.field("conv").type, schema_of))

    return run


def _over_chains(schema_of: str, begin, step):
    """A task's rows in order, each with what the rows of its conversation before it have left: ``step(row, state)`` gives a row and a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, started = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not started or row["conv"] != conv:
                    conv, state, started = row["conv"], begin, True
                made, state = step(row, state)
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema=_schema(batch.schema.field("conv").type, schema_of))

    return run


def _first_rows(chunks: DataFrame) -> DataFrame:
    """For each chunk the places of the rows that no earlier row of the conversation equals."""
    digests = F.expr("transform(roles, (r, i) -> unhex(md5(concat(length(r), ':', r, texts[i]))))")
    rows = chunks.select("conv", "part", "seq", F.posexplode(digests).alias("place", "digest"))
    first = rows.groupBy("conv", "digest").agg(F.min(F.struct("part", "seq", "place")).alias("at"))
    return first.groupBy("at.part", "at.seq").agg(F.collect_list("at.place").alias("first_rows"))


def _in_chunks(chunks: DataFrame, kind: str) -> DataFrame:
    """The pieces of conversations that are dealt with chunk by chunk; ``chunks`` are written."""
    at = "part int, seq int"

    def marked(row: dict) -> dict:
        symbols, faults = _examined(row["roles"], row["texts"], row["rows_at"], set(row["first_rows"] or []))
        codes = [f"{'x' if must_go else '-'}{'t' if unfinished else '-'}{initial}" for initial, must_go, unfinished in symbols]
        costs = [min(x, _NEVER) for line in chunk_costs(symbols) for x in line]
        return {k: row[k] for k in ("conv", "part", "seq")} | faults | {"symbols": codes, "costs": costs}

    def symbols_of(row: dict) -> list[Symbol]:
        return [(code[2:], code[0] == "x", code[1] == "t") for code in row["symbols"]]

    marks = f"{at}, {_FAULTS}, symbols array<string>, costs array<long>"
    with_first = chunks.join(_first_rows(chunks), ["part", "seq"], "left").select("conv", *chunks.columns[1:], "first_rows")
    rows = written(with_first.mapInArrow(_over_rows(marks, marked), f"conv {kind}, {marks}"), "marked")

    def ended(row: dict, after: Vector | None) -> tuple[dict, Vector]:
        here = END if after is None else after
        costs = [row["costs"][4 * s : 4 * s + 4] for s in range(4)]
        before = tuple(min(min(c + x for c, x in zip(line, here)), _NEVER) for line in costs)
        return {k: row[k] for k in ("conv", "part", "seq")} | {"after": list(here), "final": after is None}, before

    def in_order(frame: DataFrame, direction) -> DataFrame:
        return frame.repartition("conv").sortWithinPartitions("conv", direction("part"), direction("seq"))

    ends = f"{at}, after array<long>, final boolean"
    small = in_order(rows.select("conv", "part", "seq", "costs"), F.desc)
    after = written(small.mapInArrow(_over_chains(ends, None, ended), f"conv {kind}, {ends}"), "ends")

    def exits(row: dict) -> dict:
        found = [walk(symbols_of(row), s, tuple(row["after"]), row["final"])[3] for s in range(4)]
        return {k: row[k] for k in ("conv", "part", "seq")} | {"exits": found}

    both = rows.join(small_side(after.drop("conv")), ["part", "seq"]).select("conv", "part", "seq", "symbols", "after", "final")
    leaving = f"{at}, exits array<long>"
    small = in_order(both.mapInArrow(_over_rows(leaving, exits), f"conv {kind}, {leaving}"), F.asc)

    def entered(row: dict, state: int) -> tuple[dict, int]:
        return {k: row[k] for k in ("conv", "part", "seq")} | {"state": state}, row["exits"][state]

    starts = f"{at}, state int"
    states = written(small.mapInArrow(_over_chains(starts, START, entered), f"conv {kind}, {starts}"), "starts")

    def mended(row: dict) -> dict:
        letters, passed, cost, _ = walk(symbols_of(row), row["state"], tuple(row["after"]), row["final"])
        return row | {"cost": cost, "audit": letters, "repaired": _repaired(row["roles"], row["texts"], letters, passed)}

    whole = chunks.select("conv", "part", "seq", "roles", "texts")
    for side in (rows.drop("conv", "costs"), small_side(after.drop("conv")), small_side(states.drop("conv"))):
        whole = whole.join(side, ["part", "seq"])
    whole = whole.select("conv", *[c for c in whole.columns if c != "conv"])
    pieces = f"{at}, {_PIECE}"
    return whole.mapInArrow(_over_rows(pieces, mended), f"conv {kind}, {pieces}")


def repaired_pieces(
    df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None = None, most_rows: int = 1 << 16, most_bytes: int = 1 << 22
) -> DataFrame:
    """Pieces of repaired conversations: ``conv``, ``part`` and ``seq`` (their order), faults, ``cost``, ``audit`` and ``repaired``; other columns are not read.

    Rows are taken by turn, those without one first, and equal turns as they are read. A null role or text is one space. A blank row
    (nothing but space, tab to carriage return) and one whose role and text came earlier must go; an undeleted row that ends in none
    of ``.!?`` adds 5. Keeping costs 0, re-labelling as user or assistant 1, deleting 2, inserting an empty row 5. The cheapest edits
    that give roles with initials ``(s?(ua)+)?`` are taken, of equal ones those whose initials D, I, K, R are least in ASCII.
    Where ``present`` is false a row only names its conversation. Rows without a conversation are one. Most conversations
    are one piece; the ``repaired`` lines of one in several are those of its pieces in order, and the pieces without any are empty.
    An empty table gives none.
    """
    there = F.col(present) if present else F.lit(True)
    rows = df.select(
        F.col(conv).alias("conv"),
        F.coalesce(there, F.lit(False)).alias("present"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("read"),
    )
    kind = rows.schema["conv"].dataType.simpleString()
    order = ["conv", F.asc_nulls_first("turn"), "read"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("read")
    fields = f"part int, seq int, whole boolean, {_RAW}, {_PIECE}"
    found = written(ranged.mapInArrow(_streamed(most_rows, most_bytes, fields), f"conv {kind}, {fields}"), "conversations")
    piece = ["conv", "part", "seq", *[x.split()[0] for x in _PIECE.split(", ")]]
    chunks = found.filter("not whole").select("conv", "part", "seq", "rows_at", "roles", "texts")
    return found.filter("whole").select(*piece).unionByName(_in_chunks(chunks, kind).select(*piece))


def summaries(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv``, ``gaps``, counts of faults, ``cost``, ``audit`` and ``repaired_sha256``.

    A digest is sequential, so the pieces of one conversation stream through one task, none of them kept.
    """
    kind = pieces.schema["conv"].dataType.simpleString()
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, audits, schema = None, None, [], None

        def done() -> dict:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            return now | {"gaps": gaps, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            schema = schema or _schema(batch.schema.field("conv").type, fields)
            out = []
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if now is None or row["conv"] != now["conv"]:
                    if now is not None:
                        out.append(done())
                    now, digest, audits, empty = row, hashlib.sha256(row["repaired"].encode()), [row["audit"]], not row["repaired"]
                    continue
                now["illegal"] += row["illegal"]
                if row["first"] is not None:
                    now["illegal"] += now["last"] is not None and now["last"] + row["first"] not in _PAIRS
                    now["last"] = row["last"]
                if row["low"] is not None:
                    now["turns"] += row["turns"] - (now["high"] == row["low"])
                    now["low"], now["high"] = row["low"] if now["low"] is None else now["low"], row["high"]
                for name in ("blank", "duplicate", "truncated", "cost"):
                    now[name] += row[name]
                audits.append(row["audit"])
                if row["repaired"]:
                    digest.update(("" if empty else "\n").encode() + row["repaired"].encode())
                    empty = False
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)

    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return ordered.mapInArrow(combine, f"conv {kind}, {fields}")
