"""Vectorised words of Arrow text columns.

A word is a run of word bytes of the UTF-8 text; which bytes those are is a
256-entry table, so words are found and hashed with numpy over many documents at
once. Texts are taken in slices of bounded bytes, so that memory does not depend
on the size of an Arrow batch; a single long text is hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Letters, digits and everything outside ASCII (after lower-casing A-Z).
LETTERS_DIGITS = _byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but blanks and the control characters of white space.
NO_SPACE = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

LOWER_TABLE = bytes(LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) < size:
        size = max(size, BLOCK_BYTES + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers = (tables[0], tables[1])
    return _powers


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of at most ``limit`` bytes, or of one row.

    Missing texts are empty.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end).

    ``raw`` is already lower-cased if that matters to ``word_bytes``.
    """
    is_word = word_bytes[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = False
        before[1:] = is_word[:-1]
        starts = np.flatnonzero(is_word & (~before | edge[:-1]))
        after = np.empty(len(raw), dtype=bool)
        after[-1] = False
        after[:-1] = is_word[1:]
        ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    else:
        starts = ends = np.zeros(0, dtype=np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they stand."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(int(np.searchsorted(ends, low + BLOCK_BYTES, side="right")), first + 1)
        block = raw[low : int(ends[last - 1])]
        power, inverse = _power_tables(len(block) + 1)
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[block] * power[: len(block)], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        first = last
    return out


#: Odd multipliers that make a combination of neighbours depend on their order.
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbouring words of one text."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = words[:count] * _PLACES[0]
    for k in range(1, width):
        total = total + words[k : k + count] * _PLACES[k]
    return mix(total)


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def list_array(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from the lengths of its rows and all their values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
