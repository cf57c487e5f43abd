"""Byte-level helpers shared by the operators that work on whole texts.

Everything here runs on one Arrow batch at a time and on numpy views of the
Arrow buffers, so a text is never copied into Python strings.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

def release() -> None:
    """Gives unused memory back: workers of Python are used again by other stages, and executors have little to spare."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(work):
    """A function over batches that gives its memory back at the end of a partition."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


U64 = np.uint64
SEED = 20240229
BASE = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def byte_table(seed: int = SEED) -> np.ndarray:
    """256 random odd 64-bit values, so that polynomial hashes mod 2**64 mix well."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 62, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hash(values: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of every run of ``length`` values; out[i] covers i .. i + length - 1."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    out, have, at = None, 0, 0
    power, size = values, 1
    rest = length
    # Binary decomposition: blocks of 1, 2, 4, ... values are joined left to right.
    blocks = []
    while rest:
        if rest & 1:
            blocks.append((power, size))
        rest >>= 1
        if rest:
            power = power[: len(power) - size] * U64(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
    n = len(values) - length + 1
    for block, size in reversed(blocks):
        part = block[at : at + n]
        out = part.copy() if out is None else out * U64(pow(base, size, 1 << 64)) + part
        at += size
        have += size
    return out


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that ``space`` (256 flags) does not mark; runs end with their row."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    prev = np.empty(len(raw), bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~prev | first[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    # first[len(raw)] is set by offsets only when the last rows are empty; the last run ends at the buffer's end anyway.
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, by prefix sums of table values times powers of an odd base."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    n = len(raw)
    powers = np.empty(n + 1, np.uint64)
    powers[0] = 1
    powers[1:] = U64(BASE)
    np.cumprod(powers, out=powers)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[raw] * powers[:n], out=total[1:])
    inverse = np.empty(n + 1, np.uint64)
    inverse[0] = 1
    inverse[1:] = U64(pow(BASE, -1, 1 << 64))
    np.cumprod(inverse, out=inverse)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
