"""Vectorised hashes of words, n-grams and windows, for use inside tasks.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; all functions take the UTF-8 bytes of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier for polynomial hashes modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Fixed values of the 64-bit finaliser.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """``BASE ** 0 .. n - 1``."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 256) - 1, BASE, dtype=np.uint64))), dtype=np.uint64)
    return _POWERS[:n]


#: ASCII bytes other than letters and digits.
_OTHER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def plain_words(raw: bytes) -> np.ndarray:
    """Hashes of the runs of letters and digits, with A-Z lower-cased; all bytes from 128 on count as letters."""
    b = np.frombuffer(raw, dtype=np.uint8)
    edge = np.diff(np.concatenate(([False], ~_OTHER[b], [False])).astype(np.int8))
    return word_hashes(_LOWER[b].tobytes(), (np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every word."""
    b = np.frombuffer(raw, dtype=np.uint8)
    edge = np.diff(np.concatenate(([False], ~_SPACE[b], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of every word, in order."""
    starts, ends = word_spans(raw) if spans is None else spans
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(raw, dtype=np.uint8)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = b[np.repeat(starts, lengths) + within].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(values * powers(int(lengths.max()))[within], firsts))


def rolled(symbols: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every ``k`` consecutive symbols, put together from blocks of doubled length."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, block, size, power = None, 0, symbols, 1, int(BASE)
    while True:
        if k & size:
            piece = block[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(power) + piece
            done += size
        if 2 * size > k:
            return out
        block = block[:-size] * np.uint64(power) + block[size:]
        power, size = power * power % 2**64, 2 * size


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of every ``width`` consecutive values, as far as their upper 40 bits tell."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    if len(values) >= 1 << 24:
        raise ValueError("cut longer inputs into parts first")
    low = np.uint64((1 << 24) - 1)
    block = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    return (np.minimum(block[:n], block[width - size : width - size + n]) & low).astype(np.int64)


def phrases(symbols: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut a text into phrases that overlap by ``length - 1`` symbols.

    The trigger of a window of ``length`` symbols is the ``k`` symbols in it with the smallest rolling hash. Consecutive windows
    with the same trigger form a phrase, so each window lies in exactly one phrase, and equal windows have equal triggers at the
    same place. Returns each phrase's first window, its number of windows, and its trigger's hash.
    """
    hashes = mix(rolled(symbols, k))
    at = lowest(hashes, length - k + 1)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    firsts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    return firsts, np.diff(np.append(firsts, len(at))), hashes[at[firsts]]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
