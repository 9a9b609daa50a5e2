"""Words, n-grams and their hashes for Arrow batches of text, in numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
SLICE = 1 << 20

_U = np.uint64
#: Two odd numbers, for hashes of 64 and of 128 bits. Each step of a hash is scrambled, so nothing that two texts have in common cancels out.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Bytes from which on a span is given to BLAKE2b alone.
LONG = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: Lower case; whatever is neither an ASCII letter or digit nor a byte of a longer UTF-8 character parts words.
PLAIN = LOWER.copy()
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32


def giving_back(run: Callable) -> Callable:
    """A task's function that gives freed memory back to the system at its end: Python workers live on between tasks beside the JVM, which needs it in later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc's alone
            ctypes.CDLL(None).malloc_trim(0)

    return task


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a one-to-one scrambling of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def spans_hashed(b: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: int = 1) -> list[np.ndarray]:
    """Hashes of the bytes b[start:end] of each pair: eight bytes a step, in as many passes as the longest span has steps."""
    size = end - start
    padded = np.append(b, np.zeros(8, np.uint8))
    lanes = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))
    out = [mixed(size.astype(_U) * _U(BASES[k]) + _U(k + 1)) for k in range(hashes)]
    with np.errstate(over="ignore"):
        on = np.flatnonzero(size <= LONG)
        at, left = start[on], size[on]
        while len(on):
            lane = lanes[at] & _MASKS[np.minimum(left, 8)]
            for k in range(hashes):
                out[k][on] = mixed(out[k][on] * _U(BASES[k]) + lane)
            more = left > 8
            on, at, left = on[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        digest = np.frombuffer(blake2b(b[start[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
        for k in range(hashes):
            out[k][i] = digest[k]
    return out


def _met(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(a * _U(BASES[which]) + b)


def windows_hashed(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of h[i:i + n] for each i, from hashes of runs of 1, 2, 4, ... values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    level, size, done, out = mixed(h ^ _U(BASES[which])), 1, 0, np.full(m, _U(n))
    while True:
        if n & size:
            out = _met(out, level[done : done + m], which)
            done += size
        if done == n:
            return out
        level = _met(level[:-size], level[size:], which)
        size *= 2


def runs_hashed(h: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the sequence h[start:end] for each pair, from hashes of runs of 1, 2, 4, ... values."""
    n = end - start
    out, at = mixed(n.astype(_U) ^ _U(BASES[which])), start.copy()
    level, size = mixed(h ^ _U(BASES[which])), 1
    most = int(n.max()) if len(n) else 0
    while size <= most:
        on = np.flatnonzero(n & size)
        out[on] = _met(out[on], level[at[on]], which)
        at[on] += size
        level = _met(level[:-size], level[size:], which)
        size *= 2
    return out


def sets_hashed(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the set values[start:end] for each pair, whatever its order."""
    total = np.zeros(len(values) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(mixed(mixed(values) ^ _U(BASES[which])), out=total[1:])
        return mixed((total[end] - total[start]) ^ mixed((end - start).astype(_U) + _U(BASES[which])))


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them): rows of about `most` bytes in all, a longer row alone. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray = IDENTITY, hashes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, end, first word of each row and one more, hashes) of the words of each row after `table` has replaced each byte."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64), [none.astype(np.uint64)] * hashes
    b = table[data] if table is not IDENTITY else data
    ink = ~_SPACE[b]
    opens, closes = ink.copy(), ink.copy()
    opens[1:] &= ~ink[:-1]
    closes[:-1] &= ~ink[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(b))]
    opens[inner] |= ink[inner]
    closes[inner - 1] |= ink[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, at), spans_hashed(b, start, end, hashes)


def grams(h: np.ndarray, first: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of each run of n words within one row; h holds the words' hashes."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    at = np.flatnonzero(left >= n)
    return windows_hashed(h, n, which)[at], at


def rows_of(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The row that each word position belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[at]


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, sorted by both. row ascends."""
    cuts = np.flatnonzero(np.diff(row)) + 1
    out_r, out_v = [], []
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(row)], strict=True):
        if hi > lo:
            v = np.sort(value[lo:hi])
            v = v[np.r_[True, v[1:] != v[:-1]]]
            out_v.append(v)
            out_r.append(np.full(len(v), row[lo]))
    return (np.concatenate(out_r), np.concatenate(out_v)) if out_r else (row[:0], value[:0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
