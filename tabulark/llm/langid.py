"""Language of a text: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Code points handled at a time; a longer text is scored in pieces and the few n-grams over a cut do not count.
_PIECE = 1 << 16


@dataclass(frozen=True)
class Model:
    """Log probabilities by bucket and language, log priors, and the languages in sorted order."""

    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray
    orders: tuple[int, ...]


@functools.lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """For each code point its letter in lower case, or a space for anything but a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _letters(piece: str) -> np.ndarray:
    """Folded code points between two spaces, each run of others as one space; empty without letters."""
    codes = _fold()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    codes = codes[keep]
    if not len(codes) or (len(codes) == 1 and codes[0] == 32):
        return codes[:0]
    parts = [codes] if codes[0] == 32 else [np.array([32], np.uint32), codes]
    return np.concatenate(parts if codes[-1] == 32 else [*parts, np.array([32], np.uint32)])


def _buckets(codes: np.ndarray, orders: tuple[int, ...], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the bucket of the n-gram that begins at each place."""
    for n in orders:
        if len(codes) >= n:
            mixed = np.full(len(codes) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                mixed = (mixed ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x01000193) + np.uint32(0x7FEB352D)
                mixed ^= mixed >> np.uint32(15)
            yield n, mixed & np.uint32(size - 1)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), _PIECE):
            yield row, _letters(text[at : at + _PIECE])


def _groups(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Folded texts one after the other, about a piece at a time, and the row of each code point."""
    codes, rows, held = [], [], 0
    for row, letters in _pieces(texts):
        if len(letters):
            codes.append(letters)
            rows.append(np.full(len(letters), row, np.int64))
            held += len(letters)
        if held >= _PIECE:
            yield np.concatenate(codes), np.concatenate(rows)
            codes, rows, held = [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(rows)


def fit(
    df: DataFrame,
    text: str,
    lang: str,
    *,
    orders: tuple[int, ...] = (1, 2, 3),
    buckets: int = 1 << 15,
    docs_per_language: int = 5000,
    max_languages: int = 500,
    smoothing: float = 0.5,
) -> Model:
    """Learn from the rows with a language, from about ``docs_per_language`` of each (all if there are fewer).

    The sample is taken by a hash of the text, so copies of a text are in or out together. Tasks send
    counts, not texts: at most ``buckets`` numbers per language, which bounds the model that is sent to
    executors; more than ``max_languages`` languages are refused. Priors are equal. An empty table gives
    a model without languages, which calls every text unknown.
    """
    labelled = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    found = labelled.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = tuple(sorted(r["lang"] for r in found))
    index = {name: i for i, name in enumerate(languages)}
    if not languages:
        return Model((), np.zeros(0), np.zeros((buckets, 0), np.float32), orders)
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, docs_per_language / max(r["n"], 1)))])
    sample = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.try_element_at(share, "lang") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            owner = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for codes, rows in _groups(batch.column("text").to_pylist()):
                for n, at in _buckets(codes, orders, buckets):
                    same = rows[: len(at)] == rows[n - 1 :]
                    flat = owner[rows[: len(at)][same]] * buckets + at[same]
                    totals += np.bincount(flat, minlength=totals.size).reshape(totals.shape)
        lang_at, bucket_at = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang_at.astype(np.int32)), pa.array(bucket_at.astype(np.int32)), pa.array(totals[lang_at, bucket_at])],
            ["lang", "bucket", "n"],
        )

    counts = np.zeros((buckets, len(languages)))
    sums = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    counts[table["bucket"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
    counts += smoothing
    weights = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return Model(languages, np.zeros(len(languages)), weights, orders)


def predict(df: DataFrame, text: str, model: Model, *, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Every row with its language and the posterior probability of it.

    A text that is null or has no letter gets ``und`` and 0; ties go to the first language in sorted
    order. Rows are independent, so repeated rows and null ids need nothing. Columns of the result's
    names are replaced.
    """
    df = df.drop(*[c for c in (lang_col, score_col) if c != text])
    names_out = [*df.columns, lang_col, score_col]
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.weights, model.orders))
    at_text = df.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, weights, orders = sent.value
        size = len(weights)
        for batch in batches:
            sums = np.tile(prior, (batch.num_rows, 1))
            seen = np.zeros(batch.num_rows, bool)
            for codes, rows in _groups(batch.column(at_text).to_pylist()):
                seen[rows] = True
                if not languages:
                    continue
                heads = np.flatnonzero(np.diff(rows, prepend=-1))
                for n, at in _buckets(codes, orders, size):
                    part = weights[at]
                    part[rows[: len(at)] != rows[n - 1 :]] = 0
                    begin = heads[heads < len(at)]
                    sums[rows[begin]] += np.add.reduceat(part, begin, axis=0, dtype=np.float64)
            if languages:
                best = sums.argmax(axis=1)
                sums = np.exp(sums - sums.max(axis=1, keepdims=True))
                top = sums[np.arange(len(best)), best] / sums.sum(axis=1)
                names = [languages[b] if s else UNKNOWN for b, s in zip(best, seen)]
            else:
                names, top = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(np.where(seen, top, 0.0))],
                names_out,
            )

    schema = T.StructType([*df.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return df.mapInArrow(score, schema)
