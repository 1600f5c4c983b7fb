"""Tokens of the sections of documents: each document is encoded once, and its tokens are joined to sections by their places."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabulark.llm.encoding import encoder, token_ids

RULES = ("first", "most", "share")
Sections = Callable[[str], list[tuple[str, int, int]]]
_OUT = ("id", "section", "start", "end", "n_tokens", "n_crossing")


def lines(text: str) -> list[tuple[str, int, int]]:
    """The lines of a text: ``title`` for the first that is not blank, ``line`` for the others; line feeds are in no section."""
    out, at, kind = [], 0, "title"
    for line in text.split("\n"):
        if line.strip():
            out.append((kind, at, at + len(line)))
            kind = "line"
        at += len(line) + 1
    return out


@functools.lru_cache(maxsize=2)
def _byte_lengths(path: str) -> np.ndarray:
    coder = encoder(path)
    sizes = np.zeros(coder.n_vocab, np.int64)
    for token in coder.token_byte_values():
        sizes[coder.encode_single_token(token)] = len(token)
    for token in coder.special_tokens_set:
        sizes[coder.encode_single_token(token)] = len(token.encode())
    return sizes


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in code points; a token that holds a part of a code point spans all of it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    sizes = _byte_lengths(path)[np.array(token_ids(encoder(path), text), np.int64)]
    ends = np.cumsum(sizes)
    number = np.cumsum((raw & 0xC0) != 0x80) - 1
    return number[ends - sizes], number[ends - 1] + 1


def counts(text: str, sections: list[tuple[str, int, int]], path: str, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each section, and at last for places in none, its tokens and how many of its tokens cross its edge."""
    n = len(sections)
    owner = np.full(len(text), n, np.int64)
    # Where sections overlap, a character belongs to the one that begins last.
    for i in sorted(range(n), key=lambda i: (sections[i][1], -sections[i][2], i)):
        owner[max(sections[i][1], 0) : max(sections[i][2], 0)] = i
    start, end = token_spans(text, path)
    size = end - start
    token = np.repeat(np.arange(len(start)), size)
    char = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    pair, chars = np.unique(token * (n + 1) + owner[char], return_counts=True)
    token, section = pair // (n + 1), pair % (n + 1)
    parts = np.bincount(token, minlength=len(start))
    if rule == "share":
        weight, to = chars / size[token], section
    elif rule == "first":
        weight, to = np.ones(len(start)), owner[start]
    else:
        # The largest part; of equal parts the one that comes first.
        begins = np.full(len(pair), 1 << 60)
        at = np.searchsorted(pair, np.repeat(np.arange(len(start)), size) * (n + 1) + owner[char])
        np.minimum.at(begins, at, char)
        order = np.lexsort((begins, -chars, token))
        top = order[np.diff(token[order], prepend=-1) != 0]
        weight, to = np.ones(len(start)), section[top]
    crossing = np.bincount(section[parts[token] > 1], minlength=n + 1)
    return np.bincount(to, weight, n + 1), crossing


def attributed(
    df: DataFrame, id_col: str, text: str, tokenizer: str, *, sections: str | Sections = lines, rule: str = "most"
) -> DataFrame:
    """One row for each section of each document: ``section, start, end, n_tokens, n_crossing``, beside the id.

    ``sections`` is a column (array of structs: name, start, end in code points) or a function of the text. A token
    that crosses an edge goes by ``rule`` to the section of its ``first`` character, to the one that has ``most`` of its
    characters (of equal parts the first), or in proportion to characters (``share``). A last row ``none`` from 0 to the
    length of the text has the tokens outside all sections, so a document's rows add up to its tokens. A null or empty
    text has that row alone, with 0; null sections are none. Null and repeated ids are documents of their own. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    by_column = isinstance(sections, str)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(2).to_pylist() if by_column else None
            rows: list[list] = [[] for _ in _OUT]
            for i, (doc, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                body = value.as_py() or ""
                own = [tuple(s.values()) for s in given[i] or () if s and None not in s.values()] if by_column else sections(body)
                tokens, crossing = counts(body, own, tokenizer, rule)
                for section, n, c in zip([*own, ("none", 0, len(body))], tokens.tolist(), crossing.tolist()):
                    for column, x in zip(rows, (doc, *section, n, c)):
                        column.append(x)
            types = (batch.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], list(_OUT))

    id_type = df.schema[id_col].dataType.simpleString()
    chosen = df.select(id_col, text, *([sections] if by_column else []))
    out = chosen.mapInArrow(count, f"id {id_type}, section string, start long, `end` long, n_tokens double, n_crossing long")
    return out.withColumnRenamed("id", id_col)
