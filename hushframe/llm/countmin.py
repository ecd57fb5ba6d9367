"""Count-min sketches over 64-bit keys, made by partition and merged.

A merged cell is never below the true count of any key in it, so "estimated once" means "occurs once".  Two forms:

:func:`frequencies` is a small dense sketch that every task gets: ``DEPTH`` rows of ``2**bits`` bytes whatever the input.
It tells the frequent keys from the others.

:func:`counted` has as many cells as the keys need to be told apart (about ``SPARE`` cells a key), and no task ever holds
it all.  Rows of a table are buckets with their keys.  A bucket's sketch is sparse, the sorted numbers of its cells with
counts, and goes by ranges of cells to the tasks that merge them; each merged range goes back to the buckets it came
from, with the merged count of each of their cells.  Ranges and buckets keep their size when the input grows, and a bucket
sends rows only for the ranges that its own keys fall into.  A key of every bucket sends a row of each to one range, so
beyond ``TOGETHER`` buckets these are dealt by salt as well: about so many are merged to one row of a range, and those rows
are merged in turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.words import U, mix, trim, trimmed

DEPTH = 2
BLOCK_BITS = 18
#: Keys of a range on the mean; cells a key, as a binary logarithm.
RANGE, SPARE = 1 << 18, 10
#: Buckets that are merged in one step, on the mean: rows of a few keys each in a range of a key that all buckets have.
TOGETHER = 1 << 16
_SEEDS = [U(0x2545F4914F6CDD1D), U(0x6A09E667F3BCC909)]


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ _SEEDS[row]) >> U(64 - bits)).astype(np.int64)


def frequencies(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> list[bytes]:
    """One buffer for each row of the sketch, a byte a cell: four times the binary logarithm of the count."""
    block = 1 << min(BLOCK_BITS, bits)
    per_row = (1 << bits) // block

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            for key in keys(batch):
                rows = np.zeros((DEPTH, 1 << bits), np.uint32) if rows is None else rows
                for i in range(DEPTH):
                    rows[i] += np.bincount(_cells(key, i, bits), minlength=1 << bits).astype(np.uint32)
        if rows is not None:
            pack = zstandard.ZstdCompressor(level=1).compress
            planes = [pack(part.view(np.uint8).reshape(-1, 4).T.tobytes()) for row in rows for part in row.reshape(per_row, block)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(planes)), pa.int32()), pa.array(planes, pa.binary())], ["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, cells in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(zstandard.decompress(cells), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
                whole[at] = whole[at] + own if at in whole else own.astype(np.int64)
        for at, counts in whole.items():
            level = np.minimum(255, np.floor(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "cells"])

    parts = df.mapInArrow(trimmed(partial), "block int, cells binary")
    got = {r["block"]: bytes(r["cells"]) for r in parts.repartition("block").mapInArrow(trimmed(merge), "block int, cells binary").collect()}  # DEPTH * 2**bits bytes
    return [b"".join(got.get(row * per_row + i, bytes(block)) for i in range(per_row)) for row in range(DEPTH)]


def frequency(rows: list[bytes], bits: int, keys: np.ndarray) -> np.ndarray:
    return np.minimum.reduce([np.frombuffer(r, np.uint8)[_cells(keys, i, bits)] for i, r in enumerate(rows)])


def _packed(x: np.ndarray) -> bytes:
    """Values as compressed differences, one plane of bytes after the other."""
    return zstandard.compress(np.diff(x, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T.copy().view(U).ravel(), dtype=U)


def counted(buckets: DataFrame) -> tuple[DataFrame, int]:
    """``bucket`` and ``levels`` for ``buckets`` (bucket: a number of its own, keys: 64-bit values, n_keys), and how many
    bits of a key make its cell; :func:`levels_of` reads the two."""
    rows, bits, salts = _sent(buckets)
    kind = "bucket long, range long, level binary"

    def levels(count: np.ndarray) -> np.ndarray:
        level = (1 + np.log2(np.maximum(count, 1))).astype(np.uint8)
        level[count <= 1] = 0
        return level

    def merged(part: pa.Table) -> pa.Table:
        cells, _, count = _merged(part)
        found = [zstandard.compress(levels(x).tobytes(), 1) for x in np.split(count, np.cumsum([len(c) for c in cells])[:-1])]
        return pa.table([part.column("bucket"), part.column("range"), pa.array(found, pa.binary())], names=["bucket", "range", "level"])

    def twice(part: pa.Table) -> pa.Table:
        """For each salt of a range, those of its cells that are counted twice or more, with their counts."""
        cells, _, count = _merged(part)
        each = [(c[n > 1], n[n > 1]) for c, n in zip(cells, np.split(count, np.cumsum([len(c) for c in cells])[:-1]))]
        return pa.table([part.column("range"), part.column("salt"), *(pa.array([_packed(x[i]) for x in each], pa.binary()) for i in (0, 1))], names=["range", "salt", "cells", "counts"])

    def back(own: pa.Table, whole: pa.Table) -> pa.Table:
        trim()
        cell, count = _pairs(whole)
        cell, count = np.append(cell, U(2**64 - 1)), np.append(count, U(0))
        found = []
        for x in own.column("cells").to_pylist():
            x = unpacked(x)
            at = np.searchsorted(cell, x)
            found.append(zstandard.compress(levels(np.where(cell[at] == x, count[at], U(1))).tobytes(), 1))
        return pa.table([own.column("bucket"), own.column("range"), pa.array(found, pa.binary())], names=["bucket", "range", "level"])

    if salts == 1:
        got = rows.groupBy("range").applyInArrow(merged, kind)
    else:
        whole = _by_salt(rows).groupBy("range").applyInArrow(twice, "range long, salt int, cells binary, counts binary")
        got = rows.groupBy("range", "salt").cogroup(whole.groupBy("range", "salt")).applyInArrow(back, kind)
    return got.groupBy("bucket").agg(F.collect_list(F.struct("range", "level")).alias("levels")), bits  # a byte for each key of a bucket


def repeated(buckets: DataFrame) -> tuple[DataFrame, int]:
    """``range``, ``cells`` (:func:`unpacked` reads them) and ``n`` of all cells that are counted twice or more."""
    rows, bits, salts = _sent(buckets)

    def merged(part: pa.Table) -> pa.Table:
        _, cell, count = _merged(part)
        twice = np.unique(cell[count > 1])
        return pa.table([part.column("range")[:1], pa.array([_packed(twice)], pa.binary()), pa.array([len(twice)], pa.int64())], names=["range", "cells", "n"])

    return (rows if salts == 1 else _by_salt(rows)).groupBy("range").applyInArrow(merged, "range long, cells binary, n long"), bits


def _pairs(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All cells of all rows with their counts."""
    cells, counts = (np.concatenate([np.zeros(0, U), *map(unpacked, part.column(c).to_pylist())]) for c in ("cells", "counts"))
    return cells, counts


def _by_salt(rows: DataFrame) -> DataFrame:
    return rows.groupBy("range", "salt").applyInArrow(_added, "range long, salt int, cells binary, counts binary")


def _added(part: pa.Table) -> pa.Table:
    """One row of the cells of all rows of a range and salt, with the sums of their counts."""
    trim()  # of the part before
    cells, counts = _pairs(part)
    cell, at = np.unique(cells, return_inverse=True)
    n = np.bincount(at, counts).astype(U)
    return pa.table([part.column("range")[:1], part.column("salt")[:1], pa.array([_packed(cell)], pa.binary()), pa.array([_packed(n)], pa.binary())], names=["range", "salt", "cells", "counts"])


def _merged(part: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The cells of each row of a range, all of them, and the merged count of each."""
    trim()  # of the range before
    cells = [unpacked(x) for x in part.column("cells").to_pylist()]
    every, counts = np.concatenate(cells), np.concatenate([unpacked(x) for x in part.column("counts").to_pylist()])
    _, at = np.unique(every, return_inverse=True)
    return cells, every, np.bincount(at, counts).astype(U)[at]


def split(cell: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """The ranges that sorted cells fall into, each with its first place and the one after its last."""
    of = cell >> U(shift)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
    return zip(of[at].tolist(), at.tolist(), [*at[1:].tolist(), len(cell)])


def _sent(buckets: DataFrame) -> tuple[DataFrame, int, int]:
    """The buckets' sparse sketches by range and salt, the bits of a cell, and the number of salts."""
    total, n_buckets = buckets.agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.count("*")).first()
    bits, salts = min(62, int(total).bit_length() + SPARE), 1 + n_buckets // TOGETHER
    shift = bits - min(bits, (total // RANGE).bit_length())

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, salt, keys in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2)):
                cell, n = np.unique(np.frombuffer(keys.as_buffer(), U) >> U(64 - bits), return_counts=True)
                own = [*split(cell, shift)]
                cells = [_packed(cell[a:z]) for _, a, z in own]
                counts = [_packed(n[a:z].astype(U)) for _, a, z in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in own], pa.int64()), pa.array([salt] * len(own), pa.int32()), pa.array([bucket] * len(own), pa.int64()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())],
                    ["range", "salt", "bucket", "cells", "counts"],
                )

    salted = buckets.where("n_keys > 0").select("bucket", F.pmod(F.xxhash64("bucket"), F.lit(salts)).cast("int").alias("salt"), "keys")
    return salted.mapInArrow(trimmed(sent), "range long, salt int, bucket long, cells binary, counts binary"), bits, salts


def levels_of(keys: np.ndarray, levels: list[dict], bits: int) -> np.ndarray:
    """For each key of a bucket 0, if it is counted once, else one more than the binary logarithm of its count."""
    _, at = np.unique(keys >> U(64 - bits), return_inverse=True)
    return np.concatenate([np.frombuffer(zstandard.decompress(x["level"]), np.uint8) for x in sorted(levels, key=lambda x: x["range"])])[at]
