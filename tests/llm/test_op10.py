"""Rows without id, and ids that repeat, cost no more than others; sketches in many ranges and salts."""

import collections
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import countmin, op10_ngram_jaccard
from hushframe.llm.words import U


def table(spark, n, id_of):
    """Pairs of near copies."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("w"), F.hash(F.col("id") - F.col("id") % 2, i).cast("string"))), " ")
    return spark.range(n).select(id_of.cast("long").alias("doc_id"), F.concat(words, F.when(F.col("id") % 2 == 1, " tail").otherwise("")).alias("text")).repartition(4).cache()


@pytest.mark.parametrize("id_of", ["null", "7"])
def test_rows_without_ids_of_their_own(spark, id_of):
    took, sizes = {}, {}
    for name, of in (("warm", F.col("id")), ("ids", F.col("id")), ("none", F.expr(id_of))):
        df, began = table(spark, 400 if name == "warm" else 4000, of), time.perf_counter()
        df.count()
        got = op10_ngram_jaccard.near_copies(df).groupBy("component_id").count().collect()
        took[name], sizes[name] = time.perf_counter() - began, sorted(r["count"] for r in got)
    assert sizes["ids"] == [2] * 2000 and sizes["none"] == [4000]  # one id for all, so one name for all components
    assert took["none"] < 2 * took["ids"] + 10, took


def test_copies_of_one_id_and_text(spark):
    df = table(spark, 40, F.col("id"))
    many = df.union(df.where("doc_id < 4").select(F.lit(None).cast("long"), "text").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("x")).union(df.where("doc_id = 2").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("x"))
    got = {(r.doc_id, r.component_id): r["count"] for r in op10_ngram_jaccard.near_copies(many).groupBy("doc_id", "component_id").count().collect()}
    want = {(i, i - i % 2): 1 for i in range(40)} | {(2, 2): 301, (None, 0): 1000, (None, 2): 1000}
    assert got == want


@pytest.mark.parametrize("together", [1, 3, countmin.TOGETHER])
def test_counts_of_many_ranges_and_salts(spark, together, monkeypatch):
    """Counts are whole, however often one bucket has a key, and each bucket gets those of its own keys."""
    monkeypatch.setattr(countmin, "RANGE", 50)
    monkeypatch.setattr(countmin, "TOGETHER", together)
    draw = np.random.default_rng(1)
    hot = draw.integers(0, 2**63, 3, dtype=np.uint64)
    own = {b: np.concatenate([draw.integers(0, 2**63, 40, dtype=np.uint64), hot, np.repeat(hot[0], 300 * (b == 4))]) for b in range(20)}
    df = spark.createDataFrame([(b, x.tobytes(), len(x)) for b, x in own.items()] + [(99, b"", 0)], "bucket long, keys binary, n_keys long")
    got, bits = countmin.counted(df)
    cell = lambda x: (x >> U(64 - bits)).tolist()
    n = collections.Counter(cell(np.concatenate([*own.values()])))
    levels = {r.bucket: r.levels for r in got.collect()}
    assert set(levels) == set(own)
    for b, x in own.items():
        assert countmin.levels_of(x, [r.asDict() for r in levels[b]], bits).tolist() == [0 if n[k] == 1 else 1 + int(np.log2(n[k])) for k in cell(x)]
    cells, bits = countmin.repeated(df)
    assert sorted(int(c) for r in cells.collect() for c in countmin.unpacked(r.cells)) == sorted(c for c, k in n.items() if k > 1)


def test_split_looks_at_ranges_that_are_there():
    """A bucket of few keys and as many ranges as there are numbers."""
    cell = np.unique(np.random.default_rng(2).integers(0, 2**62, 100_000, dtype=np.uint64))
    began = time.perf_counter()
    got = [*countmin.split(cell, 12)]
    assert time.perf_counter() - began < 2
    assert got[0][1] == 0 and got[-1][2] == len(cell) and all(x[2] == y[1] and x[0] < y[0] for x, y in zip(got, got[1:]))
    assert [*countmin.split(cell[:0], 12)] == []


def test_sets_that_meet_by_chance_are_not_read(spark, monkeypatch):
    """Texts of passages, each of which one other text has as well: rare n-grams that lead to no link."""
    word = lambda *of: f"w{abs(hash(of))}"
    passage = lambda a, b: " ".join(word(min(a, b), max(a, b), i) for i in range(40))
    rows = [(i, " ".join(passage(i, (i + d) % 40) for d in (-3, -2, -1, 1, 2, 3))) for i in range(40)]
    rows += [(100, f"{rows[7][1]} tail"), (101, None), (102, rows[7][1].replace(" ", "\n"))]
    read, members = [], op10_ngram_jaccard._members

    def counted(docs, reps, sids, *more):
        read.append(sids.distinct().count())
        return members(docs, reps, sids, *more)

    monkeypatch.setattr(op10_ngram_jaccard, "_members", counted)
    got = {r.doc_id: r.component_id for r in op10_ngram_jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in rows} | {100: 7, 102: 7}
    assert 2 <= sum(read) <= 6, read


def test_profiles_bound_overlaps(spark):
    """What two profiles leave room for is never less than the overlap, also where numbers are cut off at 255."""
    draw = np.random.default_rng(3)
    pool = np.unique(draw.integers(0, 2**64, 60_000, dtype=np.uint64))
    sets = [np.unique(draw.choice(pool, n, replace=False)) for n in (1, 30, 700, 9_000, 40_000, 59_000, 59_500)] + [pool[:50_000], pool[1_000:52_000], np.array([5], U)]
    reps = spark.createDataFrame([(i, bytearray(op10_ngram_jaccard._profile(s))) for i, s in enumerate(sets)], "sid long, profile binary")
    pairs = spark.createDataFrame([(i, len(x), j, len(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j], "a long, na long, b long, nb long")
    got = {(r.a, r.b): r.most for r in op10_ngram_jaccard._bounded(pairs, reps).collect()}
    assert len(got) == 45 and all(len(np.intersect1d(sets[a], sets[b])) <= most <= (len(sets[a]) + len(sets[b])) // 2 for (a, b), most in got.items())
