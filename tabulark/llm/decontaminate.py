"""Benchmark questions in documents, re-parameterised ones included.

Numbers, names and units become typed placeholders. Windows of the templates are joined by hash, and each
value of the question must have become one value, so a question with other names and numbers is found
while a template that fits by chance is not. Questions made mostly of slots are looked for with their real values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.tables import small_side, written
from tabulark.llm.words import Block, blocks, counts_per_text, mixed, prefix_sums, span_hashes

#: Words that are units when they follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces pound pounds gram grams "
    "kilogram kilograms ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years c f k v w kw kwh j n pa hz khz mhz ghz b kb mb gb tb percent dollar dollars cent "
    "cents euro euros usd eur gbp meter meters metre metres kilometer kilometers kmh mph"
).split()

_WORD, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256), 39]] = True
_LITERAL, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
_VALUES, _ANY_CASE, _NAMES = 0, 1, 2  # readings of a text
_BITS = 24

# First and last code points.
#: Scripts written without spaces, of which every code point is a token.
UNSPACED = (
    (0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)
#: Spaces, punctuation and signs beyond ASCII, which are no part of a word.
BETWEEN = (
    (0x0080, 0x00A9), (0x00AB, 0x00B4), (0x00B6, 0x00B9), (0x00BB, 0x00BF), (0x00D7, 0x00D7), (0x00F7, 0x00F7), (0x2000, 0x206F),
    (0x2190, 0x2BFF), (0x3000, 0x3004), (0x3008, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65),
)


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z, and the capitals of the Latin-1 block in UTF-8, in lower case."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 32
    return low


def _within(points: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Which code points lie in one of the ascending ranges."""
    first, last = np.array(ranges).T
    at = np.searchsorted(first, points, "right") - 1
    return (at >= 0) & (points <= last[at])


def _beyond_ascii(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each code point above 127 begins, its length in bytes, and its number."""
    heads = np.flatnonzero(data >= 0xC2)
    lead = data[heads]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    points = lead.astype(np.int64) & (0xFF >> (size + 1))
    for i in (1, 2, 3):
        more = size > i
        points[more] = points[more] << 6 | (data[heads[more] + i] & 0x3F)
    return heads, size, points


def _unit_hashes() -> np.ndarray:
    return np.sort(np.array([span_hashes(prefix_sums(np.frombuffer(u.encode(), np.uint8)), np.array([0]), np.array([len(u)]))[0] for u in UNITS]))


def templates(block: Block, names: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts: template hash, kind, hash of the value, and the text they belong to.

    With ``names``, names are slots; without, case says nothing, for texts in capitals. A token is a run of letters or of digits (with
    points and commas between digits), or one code point of a script without spaces. A word is a name if it
    begins with a capital and goes on in lower case; names with only a space between them are one. Other words count in lower case.
    """
    data = block.data
    digit, word = _DIGIT[data], _WORD[data]
    heads, sizes, points = _beyond_ascii(data)
    between, alone = _within(points, BETWEEN), _within(points, UNSPACED)
    for i in range(4):
        word[heads[between & (sizes > i)] + i] = False
    if len(data) > 2:
        inner = np.isin(data[1:-1], (44, 46)) & digit[:-2] & digit[2:]
        digit = digit.copy()
        digit[1:-1] |= inner
    kind = word.astype(np.int8) + 2 * digit.astype(np.int8)
    edge = np.zeros(len(data) + 1, bool)
    edge[block.offsets] = True
    change = np.ones(len(data) + 1, bool)
    if len(data):
        change[1:-1] = kind[1:] != kind[:-1]
        change |= edge
        change[heads[alone]] = change[heads[alone] + sizes[alone]] = True
    cuts = np.flatnonzero(change)
    starts, ends = (cuts[:-1], cuts[1:]) if len(data) else (cuts[:0], cuts[:0])
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    owner = np.searchsorted(block.offsets, starts, "right") - 1
    low = _lower(data)
    hashes = span_hashes(prefix_sums(low), starts, ends)
    kinds = np.where(digit[starts], _NUMBER, _LITERAL)
    wide = (data[starts] == 0xC3).astype(np.int64) + 1
    second = np.minimum(starts + wide, ends - 1)
    capital = low[np.minimum(starts + wide - 1, ends - 1)] != data[np.minimum(starts + wide - 1, ends - 1)]
    small = (low[second] == data[second]) & (data[second] != 0xC3) | (second < starts + wide)
    small |= (data[second] == 0xC3) & (low[np.minimum(second + 1, ends - 1)] == data[np.minimum(second + 1, ends - 1)])
    if names:
        kinds[(kinds == _LITERAL) & capital & small] = _NAME
    same_text = np.zeros(len(owner), bool)
    same_text[1:] = owner[1:] == owner[:-1]
    after_number = np.zeros(len(owner), bool)
    after_number[1:] = (kinds[:-1] == _NUMBER) & same_text[1:]
    kinds[(kinds == _LITERAL) & after_number & np.isin(hashes, _unit_hashes())] = _UNIT
    goes_on = np.zeros(len(owner), bool)
    goes_on[1:] = (kinds[1:] == _NAME) & (kinds[:-1] == _NAME) & same_text[1:]
    goes_on[1:] &= (starts[1:] - ends[:-1] == 1) & (data[ends[:-1]] == 32) if len(owner) > 1 else True
    heads = np.flatnonzero(~goes_on)
    if len(heads):
        values = np.add.reduceat(mixed(hashes) * np.uint64(3), heads)
    else:
        values = hashes[:0]
    kinds, owner, hashes = kinds[heads], owner[heads], hashes[heads]
    shapes = np.where(kinds == _LITERAL, hashes, mixed(kinds.astype(np.uint64) + np.uint64(977)))
    return shapes, kinds, values, owner


def windows(shapes: np.ndarray, kinds: np.ndarray, owner: np.ndarray, texts: int, size: int, *, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of ``size`` tokens begins and its hash, if at least half of its tokens are literal.

    With ``whole`` a text that is exactly that long counts, and no other.
    """
    starts = counts_per_text(owner, texts)
    n = np.diff(starts)[owner]
    begin = np.flatnonzero((n == size) if whole else (np.arange(len(owner)) - starts[owner] <= n - size))
    if whole:
        begin = begin[begin == starts[owner[begin]]]
    literal = np.concatenate(([0], np.cumsum(kinds == _LITERAL)))
    begin = begin[2 * (literal[begin + size] - literal[begin]) >= size] if len(begin) else begin
    value = np.full(len(begin), size, np.uint64)
    for i in range(size):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + shapes[begin + i])
    return begin, value


_FIELDS = ("id", "window", "length", "reading", "place", "slots", "n_windows")
_WINDOWS = "id long, window long, length int, reading int, place int, slots array<long>, n_windows int"


def _emitted(df: DataFrame, size: int, short: tuple[int, ...], wanted: Broadcast | None) -> DataFrame:
    """Windows of each text (``id``, ``text``) in each reading; with ``wanted`` only those whose bit is set there.

    Items are read without ``wanted``: one that is shorter than a window is one window of its own length, and only those
    of which a window has too few literals are read with their real values. Documents have windows of all lengths in
    ``short`` besides.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value if wanted else None
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids = batch.column(0).slice(block.first, len(block)).to_pylist()
                rows: list[list] = [[] for _ in _FIELDS]
                telling = {}
                for reading in (_NAMES, _ANY_CASE, _VALUES):
                    if reading != _VALUES:
                        shapes, kinds, values, owner = templates(block, reading == _NAMES)
                    else:
                        shapes, kinds = values, np.full(len(values), _LITERAL)
                    starts = counts_per_text(owner, len(block))
                    for n in (*short, size):
                        begin, hashes = windows(shapes, kinds, owner, len(block), n, whole=bits is None and n < size)
                        hashes = hashes ^ np.uint64(reading)
                        per_text = np.bincount(owner[begin], minlength=len(block))
                        if bits is not None:
                            bit = hashes >> np.uint64(64 - _BITS)
                            hit = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                            begin, hashes = begin[hit], hashes[hit]
                        elif reading == _ANY_CASE:
                            telling[n] = per_text
                        elif reading == _VALUES:
                            silent = (per_text > telling[n])[owner[begin]]
                            begin, hashes = begin[silent], hashes[silent]
                        for at, h in zip(begin.tolist(), hashes.view(np.int64).tolist()):
                            text = int(owner[at])
                            own = values[at : at + n][kinds[at : at + n] != _LITERAL].view(np.int64).tolist()
                            for column, x in zip(rows, (ids[text], h, n, reading, at - int(starts[text]), own, int(per_text[text]))):
                                column.append(x)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], list(_FIELDS))

    return df.mapInArrow(emit, _WINDOWS)


def _texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null")


def contaminated(
    docs: DataFrame, id_col: str, text: str, benchmark: DataFrame, item_id: str, item_text: str, *, size: int = 8, coverage: float = 0.5
) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains: ``doc_id, item_id, n_windows, coverage, n_slots, n_changed``.

    ``coverage`` is the share of the item's windows found at places where each slot value of the item has become one value
    of the document (two may have become the same); ``n_changed`` of the ``n_slots`` distinct slot values are others than the
    item's, so above 0 the question is re-parameterised. Items shorter than ``size`` tokens must be there whole, with their own values.
    Three readings are tried, and the one that covers more counts: with names as slots, without regard to case, and, for items with
    windows of which more than half are slots, the real values of all tokens. Such windows say nothing in the first two.
    Null and empty texts have no windows; items or documents without an id are left out; rows with the same id count as one.
    Other columns are not read. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    items = written(_emitted(_texts(benchmark, item_id, item_text), size, tuple(range(1, size)), None), "windows")
    # One bit per window hash: 2 MB, whatever the size of the benchmark.
    hash_bits = F.shiftrightunsigned("window", 64 - _BITS)
    one = F.expr(f"shiftleft(1, cast(shiftrightunsigned(window, {64 - _BITS}) & 7 as int))")
    table = items.groupBy(F.shiftright(hash_bits, 3).alias("byte")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(1 << (_BITS - 3), np.uint8)
    bits[table["byte"].to_numpy()] = table["bits"].to_numpy()
    short = tuple(sorted(r["length"] for r in items.filter(F.col("length") < size).select("length").distinct().collect()))
    found = _emitted(_texts(docs, id_col, text), size, short, spark.sparkContext.broadcast(bits))
    found = found.select(F.col("id").alias("doc_id"), "window", "length", "reading", F.col("place").alias("at"), F.col("slots").alias("doc_slots"))
    items = items.withColumnsRenamed({"id": "item_id", "slots": "item_slots"})
    hits = found.join(small_side(items), ["window", "length", "reading"]).filter(F.size("doc_slots") == F.size("item_slots"))
    # Windows at the same distance belong to one occurrence; there are at most as many as the item has.
    lined_up = hits.groupBy("doc_id", "item_id", "length", "reading", "n_windows", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.collect_set("place").alias("places"),
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("item_slots", "doc_slots")))).alias("slots"),
    )
    one_each = F.size(F.array_distinct(F.col("slots.item_slots"))) == F.size("slots")
    changed = F.size(F.filter("slots", lambda s: s["item_slots"] != s["doc_slots"]))
    whole = F.when(F.col("length") < size, changed == 0).otherwise(True)
    by_view = lined_up.filter(one_each & whole).groupBy("doc_id", "item_id", "reading", "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"),
        F.max(F.struct(F.size("places"), F.size("slots").alias("n_slots"), (-changed).alias("n_changed"))).alias("best"),
    )
    share = F.col("found") / F.col("n_windows")
    found = by_view.filter(share >= coverage).groupBy("doc_id", "item_id").agg(
        F.max(F.struct(share.alias("coverage"), F.col("best.n_changed").alias("n_changed"), "reading", "found", "best")).alias("top")
    )
    return found.select(
        "doc_id", "item_id", F.col("top.found").cast("long").alias("n_windows"), F.col("top.coverage").alias("coverage"),
        F.col("top.best.n_slots").cast("long").alias("n_slots"), (-F.col("top.n_changed")).cast("long").alias("n_changed"),
    )
