"""Words and word n-grams of whole Arrow text columns as 64-bit hashes, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Each word has a hash of its own: its length and its bytes, eight
at a time, go through a non-linear mixing step each (all words of a column at once), and words of more than ``LONG`` bytes
through BLAKE2b.  Runs of words are hashed by doubling, with a mixing step at each join.  Nothing is a sum over a ring, so
words and runs built from two letters or two words don't cancel out.
Texts longer than ``PIECE`` bytes go through in pieces cut at white space, so the working memory doesn't follow the
length of a text (the result, eight bytes a word, does).
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
U = np.uint64
LONG = 256
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LENGTH, _LEFT, _RUN = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8)


def _word_hashes(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of each word of ``b`` by its first byte and its length."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    eight = np.ndarray((len(b),), "<u8", padded, strides=(1,))
    h = mix(size.astype(U) * _LENGTH)
    h = mix(h ^ (eight[start] & _MASKS[np.minimum(size, 8)]))
    left = np.flatnonzero(size > 8)
    for at in range(8, LONG, 8):
        if not len(left):
            return h
        rest = np.minimum(size[left] - at, 8)
        h[left] = mix(h[left] * _LENGTH ^ (eight[start[left] + at] & _MASKS[rest]))
        left = left[size[left] > at + 8]
    for i in left:
        word = b[start[i] : start[i] + size[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h


def _hashed(b: np.ndarray, cuts: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``b`` and the number of words before each of ``cuts``, at which words end."""
    if not len(b):
        return np.zeros(0, U), np.zeros(len(cuts), np.int64)
    word = ~_SPACE[b]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(b))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _word_hashes(_FOLDED[b] if fold else b, start, end - start), np.searchsorted(start, cuts)


def hashed_words(column: pa.Array, fold: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of whole rows: first row, row after the last, word hashes, and offsets of each row's words in them.

    ``fold`` lower-cases A-Z first.
    """
    at, data = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, "right")) - 1)
        if at[hi] - at[lo] <= PIECE or hi > lo + 1:
            h, offsets = _hashed(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], fold)
            yield lo, hi, h, offsets
        else:
            parts, a, end = [], int(at[lo]), int(at[hi])
            while a < end:
                z = min(a + PIECE, end)
                while z < end and not _SPACE[data[z]]:
                    step = np.flatnonzero(_SPACE[data[z : min(z + PIECE, end)]])
                    z = z + int(step[0]) if len(step) else min(z + PIECE, end)
                parts.append(_hashed(data[a:z], np.array([0, z - a]), fold)[0])
                a = z
            h = np.concatenate(parts)
            yield lo, hi, h, np.array([0, len(h)])
        lo = hi


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbouring values; those that cross a row's end are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    made, done, size, run = None, 0, 1, h  # runs of ``size`` words from each place on, and of the first ``done`` of the k
    while True:
        if k & size:
            made = run[:n] if made is None else mix(made * _LEFT + (run[done : done + n] ^ _RUN))
            done += size
        if 2 * size > k:
            return mix(made ^ U(k))
        run = mix(run[:-size] * _LEFT + (run[size:] ^ _RUN))
        size *= 2


def trim() -> None:
    """Give memory that a finished task has freed back to the system: workers live on and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """``run`` over batches, with :func:`trim` at the end of the task."""

    def over(batches):
        yield from run(batches)
        trim()

    return over
