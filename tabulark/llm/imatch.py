"""Document fingerprints after I-Match: terms in a band of inverse document frequency, hashed for several randomised lexicons."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.words import Block, blocks, distinct_per_text, mixed, word_hashes

#: Rows that a task of the successor step gets, on average.
_ROWS = 5000


@dataclass(frozen=True)
class Band:
    """Terms that between ``low`` and ``high`` of all documents have, and at least two.

    A document with k distinct terms adds k to all document frequencies, so there are at most (mean k) / ``low``
    such terms however many documents there are: that bounds the lexicon that is sent to every executor.
    """

    low: float = 0.001
    high: float = 0.1


#: Randomised lexicons: for each draw the terms are dealt into so many parts, of which the first few are lexicons.
#: Lexicons of large parts tell copies, those of small parts tell texts that share a half.
DRAWS = ((2, 2), (2, 2), (2, 2), (2, 2), (8, 8), (32, 16), (128, 32), (512, 64))
LEXICONS = sum(kept for _, kept in DRAWS)


def document_frequencies(df: DataFrame, text: str) -> DataFrame:
    """``term`` (64-bit hash of a word in lower case) and ``n``, in how many texts it is. Tasks send sums, not words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merge() -> None:
            nonlocal terms, counts
            found, n = np.unique(np.concatenate(held) if held else terms[:0], return_counts=True)
            every, at = np.unique(np.concatenate((terms, found)), return_inverse=True)
            sums = np.zeros(len(every), np.int64)
            np.add.at(sums, at, np.concatenate((counts, n)))
            terms, counts = every, sums
            held.clear()

        for batch in batches:
            for block in blocks(batch.column(0)):
                hashes, owner = word_hashes(block)
                held.append(distinct_per_text(hashes, owner, len(block))[0])
                if sum(map(len, held)) > 1 << 21:
                    merge()
        merge()
        for at in range(0, len(terms), 1 << 18):
            part = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(terms[part].view(np.int64)), pa.array(counts[part])], ["term", "n"])

    return df.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str, band: Band = Band()) -> np.ndarray:
    """The band's terms among all documents, ascending. An empty table has none."""
    total = df.count()
    inside = F.col("n").between(max(2, math.ceil(band.low * total)), max(2, math.floor(band.high * total)))
    terms = document_frequencies(df, text).filter(inside).select("term").toArrow().column("term").to_numpy()
    return np.sort(terms.view(np.uint64))


def digests(block: Block, terms: np.ndarray) -> list[np.ndarray]:
    """For each text 16 bits for each lexicon, 0 where the text has none of its terms.

    A digest is a hash of the distinct terms of the text in the lexicon, in ascending order. A text without any
    term of the band has instead 16 bytes of a hash of all its terms, or of its bytes if it has no word.
    """
    hashes, owner = word_hashes(block)
    values, at = distinct_per_text(hashes, owner, len(block))
    place = np.minimum(np.searchsorted(terms, values), max(len(terms) - 1, 0))
    inside = terms[place] == values if len(terms) else np.zeros(len(values), bool)
    text = np.repeat(np.arange(len(block)), np.diff(at))[inside]
    chosen = values[inside]
    sums, column = np.zeros(len(block) * LEXICONS, np.uint64), 0
    for draw, (parts, kept) in enumerate(DRAWS, 1):
        part = (mixed(chosen ^ mixed(np.array([draw], np.uint64))) % np.uint64(parts)).astype(np.int64)
        mine = part < kept
        np.add.at(sums, text[mine] * LEXICONS + column + part[mine], mixed(chosen[mine] + np.uint64(draw)))
        column += kept
    short = (mixed(sums) >> np.uint64(48)).astype(">u2")
    short[(short == 0) & (sums != 0)] = 1
    short[sums == 0] = 0
    has = np.bincount(text, minlength=len(block)) > 0
    out = []
    for i, row in enumerate(short.reshape(len(block), LEXICONS)):
        if not has[i]:
            own = values[at[i] : at[i + 1]].tobytes()
            raw = own or block.data[block.offsets[i] : block.offsets[i + 1]].tobytes()
            row = np.frombuffer(hashlib.blake2b(raw, digest_size=16, person=b"terms" if own else b"bytes").digest(), ">u2")
        out.append(row)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of lexicons with equal digests among those that either text has terms of."""
    if len(a) != len(b) or len(a) < LEXICONS:
        return float(len(a) == len(b) and bool((a == b).all()))
    either = (a != 0) | (b != 0)
    return float((a[either] == b[either]).mean())


def _order(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Null ids after all others; rows with one id in the order of a hash of their texts."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("id"), body.alias("text"), F.col(id_col).isNull().cast("int").alias("void"),
        F.coalesce(-F.col(id_col).cast("long"), F.lit(0)).cast("long").alias("rank"), F.xxhash64(body).alias("tie"),
    )


def with_edited(df: DataFrame, id_col: str, text: str, terms: np.ndarray) -> DataFrame:
    """Every document with its fingerprint, and that of the text with its second half taken from the next document.

    The next document is the one with the next smaller id; after the last comes the first. The last floor(n / 2) code
    points of a text are replaced by as many from the start of the next text, or all of it. Returns the id, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``. A null text is empty. Null ids
    come after all others, in the order of a hash of the text; so do rows with one id. Other columns are not read. A table
    with one row is its own next; an empty table gives an empty result. The texts move once, in ranges of the id whose
    first rows are sent to the range before as well.
    """
    spark = df.sparkSession
    rows = _order(df, id_col, text)
    total, void = rows.agg(F.count("*"), F.coalesce(F.sum("void"), F.lit(0))).first()
    ranges, void_ranges = max(1, math.ceil((total - void) / _ROWS)), math.ceil(void / _ROWS)
    parts = ranges + void_ranges
    named = rows.filter("void = 0")
    cuts = named.approxQuantile("rank", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    steps = np.array(sorted(cuts), np.float64)

    def bucket(batch: pa.RecordBatch) -> np.ndarray:
        void_at, rank, tie = (batch.column(c).to_numpy() for c in ("void", "rank", "tie"))
        share = ((tie.astype(np.float64) / 2.0**64 + 0.5) * void_ranges).astype(np.int64)
        return np.where(void_at == 0, np.searchsorted(steps, rank, "left"), ranges + np.minimum(share, max(void_ranges - 1, 0)))

    def only_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(bucket(batch).astype(np.int32)), *(batch.column(c) for c in ("void", "rank", "tie"))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "void", "rank", "tie"])

    heads = rows.select("void", "rank", "tie").mapInArrow(only_bucket, "bucket int, void int, rank long, tie long")
    first = {r["bucket"]: tuple(r["head"]) for r in heads.groupBy("bucket").agg(F.min(F.struct("void", "rank", "tie")).alias("head")).collect()}
    full = sorted(first)
    before = {b: full[i - 1] for i, b in enumerate(full)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        names = ["bucket", "ghost", "void", "rank", "tie", "id", "packed"]
        for batch in batches:
            at = bucket(batch)
            packed = pa.array([squeeze(x.as_py().encode()) for x in batch.column("text")], pa.binary())
            rest = [batch.column(c) for c in ("void", "rank", "tie", "id")]
            keys = zip(*(batch.column(c).to_pylist() for c in ("void", "rank", "tie")))
            ghost = [i for i, key in enumerate(keys) if first[int(at[i])] == key]
            for rows_at, to, flag in ((None, at, 0), (ghost, [before[int(at[i])] for i in ghost], 1)):
                columns = [*rest, packed] if rows_at is None else [c.take(pa.array(rows_at, pa.int64())) for c in (*rest, packed)]
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([flag] * n, pa.int32()), *columns], names)

    schema = "bucket int, ghost int, void int, rank long, tie long, id long, packed binary"
    moved = rows.mapInArrow(pack, schema).repartitionById(parts, F.col("bucket"))
    moved = moved.sortWithinPartitions("bucket", "ghost", "void", "rank", "tie")
    sent = spark.sparkContext.broadcast(terms)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []

        def prints(texts: list[str]) -> list[np.ndarray]:
            return [x for block in blocks(pa.array(texts, pa.large_string())) for x in digests(block, sent.value)]

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [unpack(x).decode() for x in part.column("packed").to_pylist()]
                held += zip(part.column("ghost").to_pylist(), part.column("id").to_pylist(), texts, prints(texts))
                # A row is done when its next one is there; copies of the next range's first row follow the last.
                pairs = [(x, y) for x, y in zip(held, held[1:]) if not x[0]]
                held = held[-1:]
                edited = [x[2][: len(x[2]) - len(x[2]) // 2] + y[2][: len(x[2]) // 2] for x, y in pairs]
                marks = prints(edited)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[1] for x, _ in pairs], pa.int64()),
                        pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([x[3].tobytes().hex() for x, _ in pairs], pa.string()),
                        pa.array([m.tobytes().hex() for m in marks], pa.string()),
                        pa.array([likeness(x[3], m) for (x, _), m in zip(pairs, marks)], pa.float64()),
                        pa.array([likeness(x[3], y[3]) for x, y in pairs], pa.float64()),
                    ],
                    ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    out = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return moved.mapInArrow(compare, out).withColumnRenamed("id", id_col)
