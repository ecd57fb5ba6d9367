"""Runs of whole tokens in a batch of texts, by numpy over their bytes: no step of Python for a text or a token.

A token is a word (``[a-z0-9_]+``, in any case of A-Z) or the whole stretch between two words.  A run has an edge of a word at either end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = True
#: Bits of a filter for each run, and at most.
BITS, MOST_BITS = 16, 1 << 28


class Tokens(NamedTuple):
    """Of a batch: bytes in lower case; by token where it begins and ends there, its text's number, its place in it (code
    points), whether an edge stands at it, the number of its value; and the hash of each value."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    at: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    hashes: np.ndarray


def tokens(texts: pa.Array) -> Tokens | None:
    low = pc.ascii_lower(pa.concat_arrays([texts.fill_null("")]))
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return None
    word = _WORD[data]
    flag = np.concatenate([[True], word[1:] != word[:-1]])
    flag[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    begin = np.flatnonzero(flag)
    end = np.append(begin[1:], len(data))
    row = np.searchsorted(offsets, begin, "right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    inside = (begin > offsets[row]) & (end < offsets[row + 1])
    strings = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data))
    values = strings.dictionary_encode()
    hashes = pd.util.hash_array(values.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return Tokens(data, begin, end, row, points[begin] - points[offsets[row]], word[begin] | inside, values.indices.to_numpy(), hashes)


def _hash(t: Tokens, first: np.ndarray, n: int) -> np.ndarray:
    x = np.full(len(first), n, np.uint64)
    for k in range(n):
        x = (x ^ t.hashes[t.value[first + k]]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def _bits(x: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte and bit of each of a hash's places in a filter of so many bits."""
    step = (x >> np.uint64(32)) | np.uint64(1)
    for k in range(4):
        at = (x + np.uint64(k) * step) & np.uint64(size - 1)
        yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)


def filter_of(texts: pa.Array, bits: np.ndarray) -> None:
    """Put whole texts into a filter."""
    t = tokens(texts)
    if t is None:
        return
    first = np.flatnonzero(np.concatenate([[True], t.row[1:] != t.row[:-1]]))
    size = np.diff(np.append(first, len(t.row)))
    for n in np.unique(size).tolist():
        for byte, bit in _bits(_hash(t, first[size == n], n), 8 * len(bits)):
            np.bitwise_or.at(bits, byte, bit)


def _apart(row: np.ndarray, at: np.ndarray, size: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Places of one run in a text don't overlap: from left to right, one that begins within the one before is left out.
    ``same``: whether the place before is one of the same run in the same text."""
    keep = np.ones(len(row), bool)
    if not (same[1:] & (at[1:] < at[:-1] + size[:-1])).any():
        return keep
    end = 0
    for i, (s, a, n) in enumerate(zip(same.tolist(), at.tolist(), size.tolist())):
        keep[i] = not s or a >= end
        end = a + n if keep[i] else end
    return keep


def runs(texts: pa.Array, sizes: list[int], bits: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of tokens: runs that a filter has, each once; how many places each has; and the places, in order of runs, as numbers of
    texts and code points."""
    t = tokens(texts)
    if t is None:
        return
    for n in sizes:
        first = np.flatnonzero(t.edge[: len(t.edge) - n + 1] & t.edge[n - 1 :] & (t.row[: len(t.row) - n + 1] == t.row[n - 1 :]))
        has = np.ones(len(first), bool)
        for byte, bit in _bits(_hash(t, first, n), 8 * len(bits)):
            has &= (bits[byte] & bit) != 0
        first = first[has]
        if not len(first):
            continue
        keys = [t.value[first + k] for k in range(n)]
        order = np.lexsort((first, *keys))
        first, keys = first[order], [k[order] for k in keys]
        equal = np.concatenate([[False], np.logical_and.reduce([k[1:] == k[:-1] for k in keys])])
        row, at = t.row[first], t.at[first]
        head = np.flatnonzero(~equal)
        string = [t.data[a:z].tobytes() for a, z in zip(t.begin[first[head]].tolist(), t.end[first[head] + (n - 1)].tolist())]
        terms = pa.array(string, pa.binary()).cast(pa.string())
        count = np.diff(np.append(head, len(first)))
        if n > 1:  # a token doesn't overlap itself
            size = np.repeat(pc.utf8_length(terms).to_numpy(), count)
            keep = _apart(row, at, size, equal & np.concatenate([[False], row[1:] == row[:-1]]))
            count = np.add.reduceat(keep.astype(np.int64), head)
            row, at = row[keep], at[keep]
        yield terms, count, row, at
