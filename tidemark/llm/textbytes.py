"""Vectorised work on the UTF-8 bytes of an Arrow string column.

A block of rows is one byte array with row offsets, as Arrow stores it; no
Python string is made for a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel takes at once; a longer single document is a block of its own.
BLOCK_BYTES = 3_000_000

#: Bytes that one prefix sum of the span hashes covers.
HASH_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: The bytes of a word once A-Z are lower case: 0-9, a-z and all non-ASCII bytes.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True

_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_RADIX_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def valid_utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """``data`` and ``offsets`` with every byte that is no UTF-8 replaced by U+FFFD, and the data as bytes; nearly always just as they are."""
    raw, heads = data.tobytes(), data[offsets[:-1][np.diff(offsets) > 0]]
    try:
        raw.decode()
        # no character goes from one row to the next
        if not ((heads & 0xC0) == 0x80).any():
            return data, offsets, raw
    except UnicodeDecodeError:
        pass
    at = offsets.tolist()
    parts = [raw[s:e].decode("utf-8", "replace").encode() for s, e in zip(at, at[1:])]
    raw = b"".join(parts)
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), raw


def string_column(parts: list[bytes | None], kind: pa.DataType = pa.string()) -> pa.Array:
    """A string column of these bytes, as they are."""
    wide = pa.types.is_large_string(kind)
    column = pa.array(parts, pa.large_binary() if wide else pa.binary())
    return pa.Array.from_buffers(kind, len(column), column.buffers(), column.null_count)


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def blocks_of(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the incoming batches with the bytes and row offsets of ``text``."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        for i, j in row_blocks(offsets, limit):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts and ends of all words, runs of ``is_word`` bytes; index of each row's first word."""
    low = LOWER[data]
    n = len(low)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = is_word[low]
    edge = offsets[offsets < n]
    begins = inside[1:-1] & ~inside[:-2]
    begins[edge] = inside[1:-1][edge]
    ends = inside[1:-1] & ~inside[2:]
    before = edge[edge > 0] - 1
    ends[before] = inside[1:-1][before]
    starts = np.flatnonzero(begins)
    return low, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_RADIX, _RADIX_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, their starts ascending, by prefix sums over about ``HASH_BYTES`` at a time."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        base = starts[k]
        j = int(np.searchsorted(starts, base + HASH_BYTES))
        part = low[base : ends[k:j].max()]
        power, inverse = _power_tables(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUE[part] * power[: len(part)], out=sums[1:])
        out[k:j] = (sums[ends[k:j] - base] - sums[starts[k:j] - base]) * inverse[starts[k:j] - base]
        k = j
    return mix64(out)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that ``span_hashes`` gives single words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return span_hashes(data, ends - np.array([len(w) for w in words], np.int64), ends) if words else np.zeros(0, np.uint64)
