"""Words of whole texts as 64-bit numbers, a batch at a time.

Texts arrive as Arrow buffers and are never turned into Python strings: a byte
table marks word bytes, and a prefix sum of byte values times powers of an odd
number gives the value of every word at once. Buffers are worked on in pieces of
a quarter of a megabyte, so memory follows the piece and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A word takes some fifty bytes of arrays while it is worked on. A worker keeps the
# most it ever took, beside a JVM whose heap may be full.
PIECE_BYTES = 256 << 10
GROUP_BYTES = 1 << 20
TEXT_BATCH = "4m"

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_POWERS: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]  # A-Z count as a-z

# What is a word byte. Spaced words are runs without ASCII white
# space; plain words are runs of digits, letters and everything beyond ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
PLAIN = np.ones(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    PLAIN[_low : _high + 1] = False


def text_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the bounds of each row; nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "")
    wide = pa.types.is_large_string(text.type)
    kind = np.int64 if wide else np.int32
    if len(text) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    buffers = text.buffers()
    bounds = np.frombuffer(buffers[1], dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_groups(bounds: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes, one row at least."""
    rows, first = len(bounds) - 1, 0
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def _pieces(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut a row group between words."""
    first = 0
    while first < len(words):
        last = min(len(words), first + PIECE_BYTES)
        if last < len(words):
            gap = np.flatnonzero(~words[first:last])
            if len(gap):
                last = first + int(gap[-1]) + 1
            else:
                gap = np.flatnonzero(~words[last:])
                last = last + int(gap[0]) + 1 if len(gap) else len(words)
        yield first, last
        first = last


def hash_words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words of consecutive texts, and each text's bounds in them.

    ``bounds`` are positions in ``data``; A-Z count as a-z. Equal words have
    equal values; different ones differ but for chance in 2**64.
    """
    inside = kind[data]
    breaks = bounds[:-1][bounds[:-1] < len(data)]
    values, starts = [], []
    for first, last in _pieces(inside):
        part = inside[first:last]
        begin = part.copy()
        begin[1:] &= ~part[:-1]
        end = part.copy()
        end[:-1] &= ~part[1:]
        own = breaks[(breaks >= first) & (breaks < last)] - first
        begin[own] = part[own]
        before = own[own > 0] - 1
        end[before] = part[before]
        at, to = np.flatnonzero(begin), np.flatnonzero(end) + 1
        up, down = _power_tables(max(PIECE_BYTES, last - first))
        total = np.empty(last - first + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_VALUES[data[first:last]] * up[: last - first], out=total[1:])
        values.append(mix((total[to] - total[at]) * down[at]))
        starts.append(at + first)
    if not values:
        return np.empty(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    # A text that is cut between pieces keeps its words in order; a word is never cut.
    return np.concatenate(values), np.searchsorted(np.concatenate(starts), bounds).astype(np.int64)


def bounded_batches(spark, size: str = "16m") -> None:
    """Arrow batches hold so many bytes at most, or one row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
