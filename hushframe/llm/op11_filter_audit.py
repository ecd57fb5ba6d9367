"""Filter interaction audit: what each order of five filters removes, what filters hide from each other, and their
Shapley values, for each source.

Method: fingerprint-routed RDD.  Four filters look at one text (expressions in the JVM); the fifth, "equal to the text of
a smaller id", needs the whole table.  Rows are partitioned by xxhash64 of the text.  A task keeps a collision chain for
each fingerprint, whose links hold the full text and the smallest id seen with it, so equal fingerprints of different
texts do no harm, and emits each row that turns out not to have the smallest id.  Before rows are routed, the same chains
run over a bounded part of each input partition (``HELD`` characters), so a text of which there are millions of copies is
sent once a part, and what is already known as a copy goes on without its text and by no key.  Labels are joined to the light rows
that come out.  ``combineByKey`` then merges vectors of counts by mask (32 masks of failed filters, each with all, good
and toxic documents) for each part; every figure of the report is a product of that vector with a fixed matrix.

Filters: A under 50 words; B fewer than 65 % of the words are distinct; C over 5 % of the code points are A-Z; D any of
``#$%&*|``; E equal to the text of a smaller id.

Memory of a task is its share of the distinct texts (``SHARE`` characters on the mean) whatever the table's size.

Defined cases: a null text is empty; null source is the part of the empty string; rows with a null ``doc_id`` never fail E, nor make others fail
it, and have no label; rows that repeat an id and its text don't fail E by each other; of labels that repeat an id, any 1
counts; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTERS = "ABCDE"
#: Characters of distinct texts that a task of the first pass holds, and that a task of the second gets on the mean.
HELD, SHARE = 1 << 24, 1 << 25
MASKS = 1 << len(FILTERS)
_COPY = 1 << FILTERS.index("E")
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


class Chains:
    """By fingerprint, a chain of texts, each with the smallest id met so far and the tallies of its rows."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.size = 0

    def meet(self, key: int, text: str, doc_id, tallies: tuple) -> tuple | None:
        """Take in rows of one id and text; the id and tallies that lose to a smaller id, if any do."""
        chain = self.of.setdefault(key, [])
        link = next((x for x in chain if x[0] == text), None)
        if link is None:
            chain.append([text, doc_id, tallies])
            self.size += len(text)
        elif doc_id == link[1]:
            link[2] = _joined(link[2], tallies)
        elif doc_id > link[1]:
            return doc_id, tallies
        else:
            lost = (link[1], link[2])
            link[1:] = doc_id, tallies
            return lost
        return None

    def links(self) -> Iterator[tuple]:
        for key, chain in self.of.items():
            for text, doc_id, tallies in chain:
                yield key, text, doc_id, tallies


def _joined(x: tuple, y: tuple) -> tuple:
    """Tallies (value, number of rows), added up by value."""
    sums = dict(x)
    for value, n in y:
        sums[value] = sums.get(value, 0) + n
    return tuple(sums.items())


def _near(held: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of one input partition: (route, (text, id, tallies)) of texts to be routed, and the same without a text of rows
    that need no comparison: ``(None, True)`` for copies, ``(None, False)`` for rows without id."""
    chains = Chains()
    for at, (doc_id, value, text, key) in enumerate(rows):
        tallies = ((value, 1),)
        if doc_id is None:
            yield at, (False, None, tallies)
            continue
        lost = chains.meet(key, text, doc_id, tallies)
        if lost:
            yield at, (True, *lost)
        if chains.size > held:
            yield from ((k, rest) for k, *rest in chains.links())
            chains = Chains()
    yield from ((k, rest) for k, *rest in chains.links())


def _far(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of one routed partition: id, value, whether it is a copy, number of rows."""
    chains = Chains()

    def out(copy: bool, doc_id, tallies: tuple) -> Iterator[tuple]:
        return ((doc_id, *value, copy, n) for value, n in tallies)

    for key, (text, doc_id, tallies) in rows:
        if isinstance(text, bool):
            yield from out(text, doc_id, tallies)
        elif lost := chains.meet(key, text, doc_id, tallies):
            yield from out(True, *lost)
    for _, _, doc_id, tallies in chains.links():
        yield from out(False, doc_id, tallies)


def route(docs: DataFrame, *values: str) -> DataFrame:
    """``doc_id``, ``values``, ``copy`` (the text is that of a smaller id) and ``n`` (rows) of ``docs`` (which needs
    ``doc_id`` and ``text``); rows that agree in all can come together."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.struct(*values), text.alias("text"), F.xxhash64(text)).rdd.map(lambda r: (r[0], tuple(r[1]), r[2], r[3]))
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // SHARE)
    routed = rows.mapPartitions(functools.partial(_near, HELD)).partitionBy(parts, lambda key: key)
    schema = T.StructType([docs.schema["doc_id"], *(docs.schema[v] for v in values), T.StructField("copy", T.BooleanType()), T.StructField("n", T.LongType())])
    return spark.createDataFrame(routed.mapPartitions(_far), schema, verifySchema=False)


def exact_copies(docs: DataFrame) -> DataFrame:
    """``doc_id`` of each row whose text is that of a smaller id: what a dedup by exact text would remove."""
    return route(docs.select("doc_id", "text", F.lit(True).alias("all")), "all").where("copy").select(F.explode(F.array_repeat("doc_id", F.col("n").cast("int"))).alias("doc_id"))


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [F.size(words) < 50, F.size(F.array_distinct(words)) * 100 < F.size(words) * 65, capitals * 100 > F.length(text) * 5, text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def _orders() -> list[str]:
    return ["".join(p) for p in itertools.permutations(FILTERS)]


def _matrices() -> np.ndarray:
    """For each order and step, and each of (kept, removed, redundant, unique fails), which masks count."""
    mask = np.arange(MASKS)
    rows = []
    for order in _orders():
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails, gone = (mask & bit) > 0, (mask & before) > 0
            before |= bit
            rows.append([(mask & before) == 0, fails & ~gone, fails & gone, mask == bit])
    return np.array(rows, np.int64)


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """A row for each order and step, from the counts of a part: mask by (all, good, toxic)."""
    of = _matrices() @ counts
    steps = [(order, step, letter) for order in _orders() for step, letter in enumerate(order, 1)]
    shapley = dict.fromkeys(FILTERS, 0)
    for (_, _, letter), x in zip(steps, of):
        shapley[letter] += int(x[1, 0])
    for (order, step, letter), x in zip(steps, of):
        yield (part, order, step, *map(int, (*x[:, 0], x[1, 1], x[1, 2])), shapley[letter])


def _added(counts: np.ndarray, value: tuple) -> np.ndarray:
    mask, n, good, toxic = value
    counts[mask] += (n, n * good, n * toxic)
    return counts


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report (see the module) of ``docs`` (``doc_id``, ``text``, ``source``) with ``labels`` (``doc_id``,
    ``quality``, ``toxic``)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = route(rows.withColumn("mask", own_mask(F.col("text"))), "part", "mask")
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "bad"))))
    light = rows.join(own, "doc_id", "left").select("part", F.expr(f"mask + if(copy, {_COPY}, 0)").alias("mask"), "n", F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = light.rdd.map(lambda r: (r[0], tuple(r[1:])))
    vectors = pairs.combineByKey(lambda v: _added(np.zeros((MASKS, 3), np.int64), v), _added, lambda x, y: x + y, parts)
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return spark.createDataFrame(vectors.flatMap(lambda kv: report(*kv)), schema, verifySchema=False)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), f AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5
), s AS (
  SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o
), e AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM s
), d AS (
  SELECT part, filter_order, step, letter, n, good, bad, contains(fails, letter) AS hit, fails = letter AS alone,
         length(translate(fails, before, '')) < length(fails) AS gone
  FROM c, e
), g AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND hit THEN bad ELSE 0 END) AS toxic_lost
  FROM d GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM g
"""
