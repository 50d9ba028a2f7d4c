"""Vectorised word kernels on UTF-8 bytes: no Python loop over words."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
#: Random word per (place in the word mod 64, byte): the sum over a word is a tabulation hash.
TABULATION = _rng.integers(0, 2**64, 64 * 256, dtype=np.uint64)
ODD = _rng.integers(0, 2**64, 64, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words ``[^\\x20\\x09-\\x0D]+`` (or between other bytes) of texts laid back to back, and the first word of each text (length + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = between[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~space & edge[:-1])
    edge[:n] = space
    edge[n] = True
    edge[offsets] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes whose hashes are worked out at once: temporaries take some 50 bytes for each.
STRETCH = 1 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    out, ends_at, at = np.empty(len(starts), np.uint64), np.cumsum(ends - starts), 0
    while at < len(starts):
        base = ends_at[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends_at, base + STRETCH, "right")))
        out[at:to] = _some_hashes(data, starts[at:to], ends[at:to])
        at = to
    return out


def _some_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    at = place + np.repeat(starts, size)
    value = TABULATION[((place & 63) << 8) | data[at]]
    if size.max() > 64:
        far = place >= 64
        value[far] *= mix((place[far] >> 6).astype(np.uint64)) | U(1)
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * ODD[63])


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (at its first word); runs across texts have to be masked by the caller."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * ODD[j % 62] if width <= 62 else mix(hashes[j : j + n] + U(j))
    return mix(out)
