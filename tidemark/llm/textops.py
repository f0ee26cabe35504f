"""Array helpers that the operators run inside Arrow tasks.

A batch of texts is seen as one UTF-8 byte array plus document offsets, so that splitting into words, hashing and
rolling windows are a few array operations a batch instead of a Python loop over words.  Batches are cut into slices of
a few megabytes first, which bounds the memory of a task whatever the number of rows in a batch; a single text longer
than a slice is still handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SLICE_ROWS = 4096

_GENERATOR = np.random.default_rng(20240229)
#: A random 64-bit value for each byte and an odd multiplier: word hashes are polynomials over them modulo 2**64.
BYTE_VALUE = _GENERATOR.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WINDOW_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table that is true for the bytes in the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Letters and digits of ASCII (lower case) and every byte of a non-ASCII character.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Letters only.
ALPHA = byte_class((0x61, 0x7A), (0x80, 0xFF))
#: Everything but the ASCII blanks.
NON_BLANK = ~byte_class((0x09, 0x0D), (0x20, 0x20))


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most max_bytes of text (one row at least) and max_rows rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = utf8(batch.column(text))[1][1:]
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, base + max_bytes, "right"))
            end = min(max(end, begin + 1), begin + max_rows, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows in them."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and document of each maximal run of bytes of a kind; no run crosses documents."""
    m = kind[data]
    if not m.any():
        return (np.zeros(0, np.int64),) * 3
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    s[first], e[last] = m[first], m[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run that words() found with the same kind."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    body = data[kind[data]]
    place = np.arange(len(body)) - np.repeat(first, lens)
    power = np.cumprod(np.full(int(lens.max()), MULTIPLIER))
    return mix(np.add.reduceat(BYTE_VALUE[body] * power[place], first))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive hashes, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g = g * WINDOW_MULTIPLIER + h[j : j + n]
    return mix(g + np.uint64(k))


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of consecutive stretches of the values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def hash_words(text: str, kind: np.ndarray = ALNUM) -> np.ndarray:
    """The hashes of the words of one text, lower-cased."""
    data, offsets = utf8(pa.array([text]))
    data = LOWER[data]
    starts, ends, _ = words(data, offsets, kind)
    return run_hashes(data, starts, ends, kind)
