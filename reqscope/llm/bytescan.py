"""Vectorised scanning of UTF-8 text batches: words, rolling hashes, segment sums.

A batch is one byte buffer plus document offsets. All functions work on whole
batches with numpy and hold a bounded multiple of the batch's bytes, so callers
cut their Arrow batches with :func:`blocks` first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ``[^\x20\x09-\x0D]+`` is the word rule everywhere in this subpackage.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

BLOCK_BYTES = 1 << 19  # a scan holds about fifty times as much for a moment


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes.

    Yields ``(first_row, last_row, bytes, offsets)``; a null text is empty. A
    single text longer than ``limit`` is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield row, last, data[offsets[row]: offsets[last]], offsets[row: last + 1] - offsets[row]
        row = last


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each document's first word (n+1 offsets). No word spans documents."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, ``n`` of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        base = BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[which] = np.cumprod(up), np.cumprod(down)
    return have[0][:n], have[1][:n]


def prefix_hash(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial prefix sums: ``out[i]`` covers ``buf[:i]``."""
    up, _ = powers(len(buf) + 1, which)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``buf[start:end]``, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix), which)
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span_hash(prefix_hash(buf, which), starts, ends, which)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Wrapping sums of ``values`` between consecutive offsets (empty segments give 0)."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sequence_hash(items: np.ndarray, offsets: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each segment's sequence of item hashes (order counts)."""
    up, down = powers(len(items) + 1, which)
    total = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * up[: len(items)], out=total[1:])
    length = (offsets[1:] - offsets[:-1]).astype(np.uint64)
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * down[offsets[:-1]] + length)


def shingles(items: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each segment's ``n``-item windows, and their offsets.

    A segment of 1 to ``n - 1`` items has one shingle, its whole sequence; an
    empty segment has none.
    """
    count = offsets[1:] - offsets[:-1]
    total = np.zeros(max(len(items) - n + 1, 0), np.uint64)
    for k in range(n):
        total += mix(items[k: k + len(total)] + np.uint64(k + 1)) * np.uint64(2 * k + 0x51ED2701)
    total = mix(total)
    full = np.maximum(count - n + 1, 0)
    short = (count > 0) & (count < n)
    out_off = np.zeros(len(offsets), np.int64)
    np.cumsum(full + short, out=out_off[1:])
    out = np.empty(out_off[-1], np.uint64)
    ranks = np.arange(out_off[-1]) - np.repeat(out_off[:-1], full + short)
    where = np.repeat(offsets[:-1], full + short) + ranks
    is_short = np.repeat(short, full + short)
    out[~is_short] = total[where[~is_short]]
    if short.any():
        out[is_short] = sequence_hash(items, offsets)[short]
    return out, out_off
