"""Words and hashes of many texts at once, on the UTF-8 bytes of an Arrow batch.

A block holds whole texts; working memory is about 50 bytes for each byte of the block, so of
``BLOCK_BYTES`` or of the one text that is longer than that.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: All bytes of ASCII but letters, digits and the apostrophe.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Block:
    """Whole texts: their bytes one after the other, and where each begins (one entry more than texts)."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in blocks of at most ``limit`` bytes, or of one longer text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def word_spans(block: Block, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes other than ``outside`` (space and tab to carriage return)."""
    inside = ~outside[block.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[block.offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(inside) else inside
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    owner = np.searchsorted(block.offsets, starts, "right") - 1
    return starts, ends, owner


def counts_per_text(owner: np.ndarray, texts: int) -> np.ndarray:
    """How many of the items each text has, as offsets: one entry more than texts."""
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=texts)[:texts]))).astype(np.int64)


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span of the bytes."""
    size = 1 << max(20, int(len(data) + 1).bit_length())
    up, _ = _powers(size)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal bytes have equal hashes wherever they stand."""
    size = 1 << max(20, int(len(sums)).bit_length())
    _, down = _powers(size)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all bits (a bijection)."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in lower case (A-Z), and the text it belongs to."""
    starts, ends, owner = word_spans(block)
    return span_hashes(prefix_sums(lowered(block.data)), starts, ends), owner


def code_points(block: Block) -> np.ndarray:
    """How many code points each text has."""
    heads = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    return np.diff(heads[block.offsets])


def distinct_per_text(values: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and where each text's begin."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], counts_per_text(owner[fresh], texts)
