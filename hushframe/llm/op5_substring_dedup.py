"""Substring dedup: words that lie in a 50-word window which also starts in a document with a smaller id are removed.

Method: count-min prefilter.  The sketch doesn't count windows one by one.  Each window has a representative run of
``WINDOW // 2`` words, the one with the smallest hash in the window; equal windows have equal representatives, so the
number of documents with a representative is never below the number of documents with any window it stands for.
Partitions sketch the representatives of each document once (about one key for thirteen words), the parts are merged by
ranges of cells on the executors, and only windows whose representative is estimated in two or more documents go on.  The
sketch has about a thousand cells a key however large the input is.  Up to ``MOST`` cells that are estimated twice, tasks
get them all; beyond that each partition gets those of its own documents by a join.  The second pass groups exactly the
windows that are left, by representative and 64-bit hashes of the windows themselves, which makes 128 bits for an
equality.  No window that occurs in two documents is lost: the sketch only overestimates.

The exact pass holds neighbouring windows with one representative as one row, so copies collapse before windows are
looked at one by one: a row of windows that is the same wherever its representative occurs is settled as a whole, and
only rows that differ are taken apart into windows.  Grouping is by aggregation with partial sums and by joins that
adaptive execution can split, so a passage that a third of the documents share doesn't meet in one task.

Ids can be of any type that has an order.  Defined cases: null or empty text has no words; texts under 50 words lose nothing; rows that repeat a ``doc_id``
don't remove each other's words; a row with a null ``doc_id`` neither removes words nor loses any; an empty table gives
an empty result; further columns are carried along, except those named as a result column, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm import countmin
from hushframe.llm.scratch import bounded_batches, cut, drop, keep_only, scope
from hushframe.llm.words import U, buffers, grams, hashed_words, mix, trimmed

WINDOW = 50
#: Repeated cells that are broadcast at most (about three bytes each).
MOST = 1 << 22
#: Windows in a row of the exact pass at most.
RUN = 32
_WORDS = b" \t\n\r\x0b\x0c"


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each ``k`` neighbours."""
    size = 1
    while size * 2 <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == k else np.minimum(x[: len(x) - (k - size)], x[k - size :])


def _windows(text: pa.Array, window: int, hashes: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """For groups of rows: the row, first word, representative and (with ``hashes``) own hash of each window."""
    half = window // 2
    for lo, hi, h, at in hashed_words(text):
        if len(h) < window:
            continue
        rep = _sliding_min(mix(grams(h, half)), window - half + 1)
        row = np.repeat(np.arange(lo, hi), np.diff(at))
        first = np.arange(len(rep))
        inside = first + window <= np.repeat(at[1:], np.diff(at))[: len(rep)]
        first = first[inside]
        yield row[first], first - at[row[first] - lo], rep[first], grams(h, window)[first] if hashes else None


def _buckets(docs: DataFrame, window: int) -> DataFrame:
    """One row for each batch: its documents (doc_id, text_key) and the representatives that each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), 0
        for batch in batches:
            n, own = np.zeros(batch.num_rows, np.int32), []
            for row, _, rep, _ in _windows(batch.column(1), window, False):
                if len(rep):
                    new = np.concatenate([[True], (rep[1:] != rep[:-1]) | (row[1:] != row[:-1])])
                    r, d = rep[new], row[new]
                    order = np.lexsort((r, d))
                    r, d = r[order], d[order]
                    new = np.concatenate([[True], (r[1:] != r[:-1]) | (d[1:] != d[:-1])])
                    own.append(r[new])
                    n += np.bincount(d[new], minlength=len(n)).astype(np.int32)
            keys, made = np.concatenate([np.zeros(0, U), *own]), made + 1
            array = lambda x: pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task.partitionId() << 32) + made]), array(batch.column(0)), array(batch.column(2)), array(pa.array(n)), pa.array([keys.tobytes()], pa.binary()), pa.array([len(keys)], pa.int64())],
                ["bucket", "doc_id", "text_key", "n", "keys", "n_keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(trimmed(run), f"bucket long, doc_id array<{kind}>, text_key array<long>, n array<int>, keys binary, n_keys long")


def _candidates(docs: DataFrame, buckets: DataFrame) -> DataFrame:
    """doc_id, text_key and the representatives that are estimated in two documents, of each document with any."""
    counted, bits = countmin.counted(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text_key, n, keys, levels in zip(*batch.columns):
                key = np.frombuffer(keys.as_buffer(), U)
                twice = countmin.levels_of(key, levels.as_py(), bits) > 0
                size = n.values.to_numpy(zero_copy_only=False)
                left = np.bincount(np.repeat(np.arange(len(size)), size)[twice], minlength=len(size))
                reps = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)), pa.int32()), pa.array(key[twice].view(np.int64)))
                any_ = pa.array(left > 0)
                yield pa.RecordBatch.from_arrays([doc_id.values.filter(any_), text_key.values.filter(any_), reps.filter(any_)], ["doc_id", "text_key", "reps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = buckets.where("n_keys > 0").join(counted, "bucket").select("doc_id", "text_key", "n", "keys", "levels")
    return joined.mapInArrow(trimmed(run), f"doc_id {kind}, text_key long, reps array<long>").groupBy("doc_id", "text_key").agg(F.first("reps").alias("reps"))


def _flags(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, and the first windows and masks of repeated windows of each document that has any."""
    context, kind = docs.sparkSession.sparkContext, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    buckets = cut(_buckets(docs, window))
    cells, bits = countmin.repeated(buckets)
    cells = cut(cells)
    if (cells.agg(F.sum("n")).first()[0] or 0) <= MOST:
        docs = docs.withColumn("reps", F.lit(None).cast("array<long>"))
        shared = context.broadcast([r.cells for r in cells.orderBy("range").collect()])
    else:
        docs = docs.join(cut(_candidates(docs, buckets)), ["doc_id", "text_key"]).select("doc_id", "text", "text_key", "reps")
        shared = None
    drop(cells, buckets)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.concatenate([np.zeros(0, U), *map(countmin.unpacked, shared.value)]) if shared else None
        for batch in batches:
            ids = batch.column(0)
            if shared is None:
                twice = np.unique(pa.compute.list_flatten(batch.column(3)).to_numpy().view(U) >> U(64 - bits))
            for row, first, rep, own in _windows(batch.column(1), window, True):
                if not len(rep) or not len(twice):
                    continue
                cell = rep >> U(64 - bits)
                keep = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, cell), len(twice) - 1)] == cell)
                if not len(keep):
                    continue
                row, first, rep, own = row[keep], first[keep], rep[keep], own[keep]
                new = np.concatenate([[True], (rep[1:] != rep[:-1]) | (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)])
                start = np.flatnonzero(new)
                length = np.diff(np.append(start, len(rep)))
                if length.max() > RUN:
                    start = np.concatenate([np.arange(s, s + n, RUN) for s, n in zip(start, length)])
                    length = np.diff(np.append(start, len(rep)))
                words, at = own.view(np.int64), np.append(start, len(rep)).astype(np.int32)
                total = np.concatenate([[U(0)], np.cumsum(mix(own + (np.arange(len(own)) - np.repeat(start, length)).astype(U) * U(0x9E3779B97F4A7C15)))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rep[start].view(np.int64)), pa.array(mix(total[at[1:]] - total[at[:-1]] + length.astype(U)).view(np.int64)),
                        ids.take(pa.array(row[start])), batch.column(2).take(pa.array(row[start])), pa.array(first[start].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(words)),
                    ],
                    ["rep", "run", "doc_id", "text_key", "first", "windows"],
                )

    runs = cut(docs.mapInArrow(trimmed(repeated), f"rep long, run long, doc_id {kind}, text_key long, first int, windows array<long>"))
    distinct = cut(runs.groupBy("rep", "run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("windows").alias("windows")))
    several = distinct.groupBy("rep").agg(F.count("*").alias("n"), F.min("least").alias("a"), F.max("most").alias("z")).where("n > 1 and a < z").select("rep")
    apart = distinct.join(several, "rep").select("rep", "run", "least", "most", F.posexplode("windows").alias("i", "w"))
    by_window = apart.groupBy("rep", "w").agg(F.min("least").alias("a"), F.max("most").alias("z")).where("a < z")
    by_run = apart.select("rep", "run", "i", "w").join(by_window, ["rep", "w"]).groupBy("rep", "run").agg(F.collect_list(F.struct("i", "a")).alias("each"))
    whole = distinct.where("least < most").join(several, "rep", "left_anti").select("rep", "run", "least", F.lit(None).cast(f"array<struct<i:int,a:{kind}>>").alias("each"))
    settled = whole.unionByName(by_run.select("rep", "run", F.lit(None).cast(kind).alias("least"), "each"))
    light = runs.select("rep", "run", "doc_id", "text_key", "first", F.size("windows").alias("n"))
    hit = light.join(settled, ["rep", "run"]).where("each is not null or least < doc_id")
    mask: Column = F.when(F.col("each").isNull(), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.expr("transform(filter(each, x -> x.a < doc_id), x -> x.i)"))
    hit = hit.select("doc_id", "text_key", F.transform(mask, lambda i: i + F.col("first")).alias("starts")).where(F.size("starts") > 0)
    return hit.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` (which needs ``doc_id`` and ``text``) and ``n_words``, ``n_removed``, ``kept_text``
    (kept words joined by one space)."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    bounded_batches(docs.sparkSession)
    with scope() as made:
        flags = cut(_flags(docs.select("doc_id", "text"), window))
        keep_only(made, flags)
    flags = flags.select(F.col("doc_id").alias("__hushframe_id"), F.col("text_key").alias("__hushframe_key"), F.col("starts").alias("__hushframe_starts"))
    joined = docs.join(flags, (docs["doc_id"] == flags["__hushframe_id"]) & (F.xxhash64(docs["text"]) == flags["__hushframe_key"]), "left").drop("__hushframe_id", "__hushframe_key")
    place = joined.columns.index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = buffers(batch.column(place))
            raw, n_words, n_removed, kept = data.tobytes(), [], [], []
            for i, starts in enumerate(batch.column(batch.num_columns - 1)):
                words = raw[at[i] : at[i + 1]].split()
                n_words.append(len(words))
                if starts.is_valid and len(words):
                    level = np.zeros(len(words) + 1, np.int64)
                    first = np.unique(starts.values.to_numpy(zero_copy_only=False))
                    np.add.at(level, first, 1)
                    np.add.at(level, first + window, -1)
                    stays = np.cumsum(level[:-1]) == 0
                    words = [words[j] for j in np.flatnonzero(stays)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text], [*batch.schema.names[:-1], "n_words", "n_removed", "kept_text"])

    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema
    return joined.mapInArrow(trimmed(strip), schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p, ws FROM w WHERE len(ws) >= 50
), h AS (
  SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS k FROM s
), m AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS a FROM h
), r AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM m WHERE a < doc_id
), g AS (
  SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id
), k AS (
  SELECT w.doc_id, ws, [x FOR x, i IN ws IF NOT list_contains(coalesce(gone, []), i)] AS kept
  FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""
