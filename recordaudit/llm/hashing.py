"""Vectorised rolling hashes over the UTF-8 bytes of many texts, for use inside Arrow tasks.

A chunk holds whole texts back to back. Every function is a handful of numpy passes over the chunk, so the
cost follows the number of bytes and the memory is bounded by the chunk (or by the longest single text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def lean(task: Callable) -> Callable:
    """The task of a partition, after which its worker returns freed memory to the system.

    Spark keeps workers for later stages; what an idle one holds would count against the executor's next stage.
    """

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1, modulo 2**64."""
    if "base" not in _powers or len(_powers["base"]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        for name, value in (("base", _BASE), ("inverse", _INVERSE)):
            steps = np.full(size, value, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["base"][:n], _powers["inverse"][:n]


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` bytes; a longer text is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        size = len(text or b"") + 1
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i; a window's hash is a difference, see ``windows``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def windows(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k values, by their start."""
    n = len(sums) - k
    if n <= 0:
        return np.empty(0, np.uint64)
    return (sums[k:] - sums[:n]) * powers(n)[1]


class Words:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D) of a chunk of texts.

    ``hashes`` has one 64-bit hash per word (A-Z lower-cased), ``first[i]:first[i + 1]`` are text i's words.
    """

    def __init__(self, texts: list[bytes | None]):
        joined = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
        space = _SPACE[joined]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        sums = prefix(_TABLE[_LOWER[joined]])
        at = self.start
        self.hashes = mix((sums[self.end] - sums[at]) * powers(len(joined))[1][at] + (self.end - at).astype(np.uint64))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the offsets of each text's; a shorter text has its whole sequence as one."""
    sums = prefix(words.hashes)
    count = np.diff(words.first)
    each = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    offset = np.concatenate([[0], np.cumsum(each)])
    start = np.arange(offset[-1]) + np.repeat(words.first[:-1] - offset[:-1], each)
    end = np.minimum(start + k, np.repeat(words.first[1:], each))
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64)), offset


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, by its start; log2(w) passes."""
    span, out = 1, values
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def sliding_max(values: np.ndarray, w: int) -> np.ndarray:
    """Maximum of every window of w values, by its start."""
    return ~sliding_min(~values, w)


def byte_windows(text: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of a byte array, by their start."""
    return mix(windows(prefix(_TABLE[text]), k))
