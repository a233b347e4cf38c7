"""Vectorised word splitting and hashing over Arrow string columns (numpy only, no per-word Python)."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that every machine derives alike."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


#: Byte values, base and its inverse of the two independent word hashes.
FAMILIES = [(constants(256, s), int(constants(1, s + 1)[0]), pow(int(constants(1, s + 1)[0]), -1, 1 << 64)) for s in (11, 13)]
CHUNK = 1 << 20
#: A word of more bytes travels as its digest.
LONG = 64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK), U64(base))
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=U64)
    return _powers[base][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive runs of rows, of about `limit` bytes or one row."""
    buf, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs of non-space bytes in each row, and each row's first word index."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    black = ~SPACE[buf]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    filled = off[:-1] < off[1:]
    heads, tails = off[:-1][filled], off[1:][filled] - 1
    first[heads] = black[heads]
    last[tails] = black[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def canonical(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same words in each row, each followed by one space at most; those over LONG bytes are 128-bit digests.

    A digest begins with the byte FF, which no UTF-8 text has, so that it equals no other word.
    """
    black = ~SPACE[buf]
    keep = black.copy()
    keep[1:] |= black[:-1]
    sums = np.append(0, np.cumsum(keep))
    buf, off = np.where(black, buf, np.uint8(32))[keep], sums[off]
    starts, ends, ptr = words(buf, off)
    long = np.flatnonzero(ends - starts > LONG)
    if not len(long):
        return buf, off
    raw, parts, at, moved = buf.tobytes(), [], 0, np.zeros(len(off), np.int64)
    for i in long.tolist():
        s, e = int(starts[i]), int(ends[i])
        parts += [raw[at:s], b"\xff" + hashlib.blake2b(raw[s:e], digest_size=16).hexdigest().encode()]
        at = e
    saved = np.cumsum(ends[long] - starts[long] - 33)
    moved = np.append(0, saved)[np.searchsorted(ends[long], off, side="right")]
    return np.frombuffer(b"".join([*parts, raw[at:]]), np.uint8), off - moved


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; the families are independent of each other."""
    values, base, inverse = FAMILIES[family]
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        lo, hi = starts[i], ends[j - 1]
        n = int(hi - lo)
        sums = np.zeros(n + 1, U64)
        np.cumsum(values[buf[lo:hi]] * powers(base, n), out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * powers(inverse, n)[starts[i:j] - lo]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def grams(h: np.ndarray, n: int, seed: int = 21) -> np.ndarray:
    """A 64-bit hash of each n successive values of h: len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j, c in enumerate(constants(n, seed)):
        out += h[j : j + m] * c
    return mix(out)


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """Least of each n successive values: len(h) - n + 1 of them."""
    if len(h) < n:
        return h[:0]
    have, low = 1, h
    while 2 * have <= n:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(h) - n + 1], low[n - have : n - have + len(h) - n + 1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total)
    return out


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return LOWER[buf]


def trim() -> None:
    """Give freed memory back: idle Python workers stay, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries do so by themselves
        pass


def trimmed(run: Callable) -> Callable:
    """run, a function of batches that yields batches, with trim() at its end."""

    @functools.wraps(run)
    def outer(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return outer
