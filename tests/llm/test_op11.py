"""The filter audit against brute force, whatever is held at once, and on odd rows."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from hushframe.llm import op11_filter_audit as op

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """All rows of the report, document by document and order by order."""
    marks = collections.defaultdict(lambda: [0, 0])
    for d, q, t in labels:
        if d is not None:
            marks[d] = [max(marks[d][0], q == 1), max(marks[d][1], t == 1)]
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    out = collections.Counter()
    parts = {s or "" for *_, s in docs}
    for d, text, source in docs:
        t = text or ""
        words = WORDS.findall(t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        good, bad = marks[d] if d is not None else (0, 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                at = (source or "", order, step)
                removed = fails[letter] and not gone
                out[at, "redundant"] += fails[letter] and gone
                out[at, "unique_fails"] += fails[letter] and sum(fails.values()) == 1
                gone |= fails[letter]
                out[at, "kept"] += not gone
                out[at, "removed"] += removed
                out[at, "good_lost"] += removed and good
                out[at, "toxic_lost"] += removed and bad
                out[at[0], letter] += removed
    return {(p, o, s): (*(out[(p, o, s), k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), out[p, o[s - 1]]) for p in parts for o in map("".join, itertools.permutations("ABCDE")) for s in range(1, 6)}


def rows(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


@pytest.mark.parametrize("held", [op.HELD, 100])
def test_equals_brute_force(spark, edge, held, monkeypatch):
    monkeypatch.setattr(op, "HELD", held)
    docs = edge.union(edge.where("doc_id in (5, 6, 7)").withColumn("doc_id", F.col("doc_id") + 100)).union(edge.withColumn("source", F.lit("c")))
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (107, 1, 1), (107, 0, 0), (None, 1, 1), (11, None, 1), (12, 1, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = op.audit(docs.withColumn("part", F.lit(1)).withColumn("mask", F.lit("x")).withColumn("copy", F.lit("x")), labels)
    assert got.count() == len(rows(got))
    assert rows(got) == brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_nothing(nothing, spark):
    assert op.audit(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert op.exact_copies(nothing).count() == 0


def test_copies_many_times_over(spark, monkeypatch):
    """A hot text, ids as strings, and ids that repeat."""
    monkeypatch.setattr(op, "HELD", 50)
    ids = [f"{i:05}" for i in range(3000)]
    docs = spark.createDataFrame([(d, "hot" if i % 3 else f"t{i % 500}") for i, d in enumerate(ids)] + [("00001", "hot"), (None, "hot")], "doc_id string, text string").repartition(7)
    least = {}
    for d, t in docs.collect():
        if d is not None:
            least[t] = min(d, least.get(t, d))
    assert sorted(r[0] for r in op.exact_copies(docs).collect()) == sorted(d for d, t in docs.collect() if d is not None and d > least[t])


def test_texts_of_one_fingerprint_stay_apart():
    chains = op.Chains()
    one = lambda v: ((v, 1),)
    assert [chains.meet(1, t, d, one(t)) for t, d in (("a", 5), ("b", 1), ("a", 7), ("a", 2), ("b", 1))] == [None, None, (7, one("a")), (5, one("a")), None]
    assert sorted(chains.links()) == [(1, "a", 2, one("a")), (1, "b", 1, (("b", 2),))]
