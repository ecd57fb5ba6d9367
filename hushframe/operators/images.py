"""Perceptual hashes of images and their similarity; kinds and sizes of images from their first bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First bytes (hex) by kind of image.
MAGIC = [("png", "^89504E470D0A1A0A"), ("jpeg", "^FFD8FF"), ("gif", "^47494638"), ("bmp", "^424D"), ("webp", "^52494646.{8}57454250")]

#: Hashes of a block, comparisons made at once, parts that targets are dealt to; blocks are compared whole if bands let more than this share of all pairs meet.
BLOCK, AT_ONCE, PARTS, SELECTIVE = 4096, 1 << 18, 4, 1 / 64


def image_kind(content: Column) -> Column:
    """png, jpeg, gif, bmp, webp or null."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(MAGIC):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def image_size(b: bytes | None) -> tuple[int, int] | None:
    """Width and height of png, gif, bmp and jpeg."""
    if not b or len(b) < 26:
        return None
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", b[16:24])
    if b[:3] == b"GIF":
        return struct.unpack("<HH", b[6:10])
    if b[:2] == b"BM":
        w, h = struct.unpack("<ii", b[18:26])
        return w, abs(h)
    at = 2
    while b[:2] == b"\xff\xd8" and at + 9 < len(b) and b[at] == 0xFF:
        if 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once for a row, however often it is named there or within functions of elements."""
    return F.get(F.transform(F.array(value), use), 0)


def average_hash(pixels: Column) -> Column:
    """16 hex digits of 64 grey values: a bit is set if its pixel is above the mean."""
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
    bits = lambda p, m: F.array_join(F.transform(p, lambda x: F.when(x > m, "1").otherwise("0")), "")
    digits = lambda b: F.lower(F.concat(*(F.lpad(F.conv(F.substring(b, 16 * i + 1, 16), 2, 16), 4, "0") for i in range(4))))
    return _once(pixels, lambda p: _once(mean(p), lambda m: _once(bits(p, m), digits)))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two hashes in hex; of unequal length, four for each digit of the longer."""
    halves = [F.bit_count(F.conv(F.substring(a, k, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, k, 8), 16, 10).cast("long"))) for k in (1, 9)]
    return F.when(F.length(a) == F.length(b), halves[0] + F.coalesce(halves[1], F.lit(0))).otherwise(4 * F.greatest(F.length(a), F.length(b)))


def similarity(a: Column, b: Column) -> Column:
    """Percent of equal bits, two decimals; 0 for unequal lengths."""
    bits = F.length(a) * 4
    return F.when(F.length(a) == F.length(b), F.round((bits - hamming(a, b)) / bits * 100, 2)).otherwise(F.lit(0.0))


def matching(images: DataFrame, target: str, threshold: float = 85, column: str = "hash") -> DataFrame:
    """Images whose hash is as similar to ``target`` as ``threshold`` asks."""
    return images.withColumn("similarity", similarity(F.col(column), F.lit(target))).where(F.col("similarity") >= threshold)


def _bits(h: Column) -> Column:
    """The 64 bits of a hash of 16 hex digits."""
    half = lambda k: F.conv(F.substring(h, k, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def farthest(threshold: float, bits: int = 64) -> int:
    """The most bits in which two hashes as similar as ``threshold`` (percent, two decimals) can differ; -1 if none can."""
    return max((d for d in range(bits + 1) if int((bits - d) / bits * 10_000 + 0.5) / 100 >= threshold), default=-1)


def _by_blocks(x: DataFrame, y: DataFrame, far: int) -> DataFrame:
    """Pairs ``a``, ``b``, ``distance`` of two tables of distinct hashes (``v``), all compared, a block with a block: no row of
    Spark is made for a pair that is too far apart."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            held = np.concatenate([held, batch.column(0).to_numpy()])
            while len(held) >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([held[:BLOCK].tobytes()], pa.binary())], ["block"])
                held = held[BLOCK:]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["block"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of_x, of_y in zip(*batch.columns):
                one, two = (np.frombuffer(b.as_buffer(), np.int64) for b in (of_x, of_y))
                step = max(1, AT_ONCE // len(two))
                for at in range(0, len(one), step):
                    distance = np.bitwise_count(one[at : at + step, None].view(np.uint64) ^ two[None].view(np.uint64))
                    i, j = np.nonzero(distance <= far)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(one[at + i]), pa.array(two[j]), pa.array(distance[i, j].astype(np.int32))], ["a", "b", "distance"])

    spark = x.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTS)
    one, two = (df.select("v").mapInArrow(packed, "block binary").repartition(n) for df, n in ((x, parts), (y, PARTS)))
    return one.hint("shuffle_replicate_nl").crossJoin(two.select(F.col("block").alias("other"))).mapInArrow(compared, "a long, b long, distance int")


def _by_bands(x: DataFrame, y: DataFrame, far: int, edges: list[int]) -> DataFrame:
    """The same, of which only those are compared that agree in a band but for one bit at most."""
    bands = len(edges) - 1
    cut = lambda v, i: F.shiftrightunsigned(v, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1 if bands > 1 else -1).cast("long"))
    filed = F.array(*(F.struct(F.lit(i).alias("band"), cut(F.col("v"), i).alias("part")) for i in range(bands)))
    near = F.array(*(F.struct(F.lit(i).alias("band"), cut(F.col("v"), i).bitwiseXOR(F.lit(flip).cast("long")).alias("part")) for i in range(bands) for flip in [0, *(1 << b if b < 63 else -(1 << 63) for b in range(edges[i + 1] - edges[i]))])) if far > 0 else filed
    x = x.select(F.col("v").alias("a"), F.inline(filed))
    y = y.select(F.col("v").alias("b"), F.inline(near))
    differs = lambda i: F.bit_count(cut(F.col("a"), i).bitwiseXOR(cut(F.col("b"), i)))
    first = F.coalesce(*(F.when(differs(i) <= 1, i) for i in range(bands)))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return x.join(y, ["band", "part"]).where((F.col("band") == first) & (distance <= far)).select("a", "b", distance.alias("distance"))


def similar(images: DataFrame, targets: DataFrame, threshold: float = 85, image: str = "image_id", target: str = "target_id", column: str = "hash") -> DataFrame:
    """Pairs of a table of images and a table of targets as similar as ``threshold`` asks: ``image``, ``target``,
    ``distance``, ``similarity``.

    Hashes that differ in at most D bits, cut into bands of which there are more than half as many, agree in one band but
    for one bit at most.  So an image is filed under the value of each of its bands, a target under each of its own and those one bit
    from it, and only pairs that meet there are compared.  A pair that meets in several bands counts in the first.  Low
    thresholds make bands so narrow that nearly all pairs meet (at 67 more often than there are pairs); then blocks of hashes
    are compared whole, which takes time by the product of the tables and memory by the block.  Equal
    hashes are one until the pairs are known, so many equal pictures are compared once.  Hashes are of 16 hex digits; null
    and other ones are similar to nothing.
    """
    far = farthest(threshold)
    bands = far // 2 + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    hashes = lambda df, *names: df.where(F.lower(column).rlike(r"^[0-9a-f]{16}\z")).select(*names, _bits(F.lower(column)).alias("v"))
    x, y = hashes(images).distinct(), hashes(targets).distinct()
    meet = sum((w + 1) / 2**w for w in (z - a for a, z in zip(edges, edges[1:])))
    pairs = _by_blocks(x, y, far) if meet > SELECTIVE else _by_bands(x, y, far, edges)
    one = hashes(images, F.col(image)).withColumnRenamed("v", "a").join(pairs, "a")
    both = one.join(hashes(targets, F.col(target)).withColumnRenamed("v", "b"), "b")
    return both.select(image, target, F.col("distance").cast("int").alias("distance"), F.round((64 - F.col("distance")) / 64 * 100, 2).alias("similarity"))


def logo_detections(images: DataFrame, target: str, threshold: float = 85, text: str = "[LOGO]") -> DataFrame:
    """Matches as detections at place 0, which masking leaves out and mappings keep."""
    got = matching(images, target, threshold)
    return got.select("doc_id", F.lit("[Logo Image]").alias("text"), F.lit("company").alias("category"), F.lit("Logo").alias("subcategory"), (F.col("similarity") / 100).alias("confidence"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(text).alias("placeholder"), F.lit(True).alias("approved"), "image_id")
