"""Any number of terms in any number of documents, by an index of the terms.

A term is found where its text stands, in any case of A-Z, with an edge of an ASCII word at either end: what the pattern
``\\bterm\\b`` finds.  So a term is a run of whole tokens, which are words and the whole stretches between words.  Terms of up to
``SHORT`` tokens are joined as they are: documents give their runs of each number of tokens that terms have, and a run that
is a term is a place of it.  Runs that a filter of all terms (some bits a term, 32 MB at most) hasn't are left out at once, and equal runs
of some megabytes of documents are one row with all places, so frequent terms cost little more than their places' numbers.

Longer terms are filed under one of their tokens, the one that the documents have least often; a document's tokens, with
their places and as much text around as the longest such term needs, meet the index in one join, and what stands there is
compared with the term.

Terms are broadcast if they are small by count and bytes (``BROADCAST_TERMS``, ``BROADCAST_BYTES``), so documents aren't
shuffled; beyond that runs and tokens are shuffled, with adaptive execution splitting those that are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import runs
from hushframe.functions.arrays import let, running
from hushframe.functions.dialect import SPACES
from hushframe.operators.detect import CAPITALISED, exploded, no_role

BROADCAST_TERMS, BROADCAST_BYTES = 500_000, 1 << 26
SHORT = 5
#: Bytes of documents whose equal runs are one row.
AT_ONCE = 1 << 23
_A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = "[a-z0-9_]+"


def folded(text: Column) -> Column:
    return F.translate(text, *_A_Z)


def normal(term: Column) -> Column:
    """A term as users' words are: without spaces around it, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(term, f"^[{SPACES}]+", ""), rf"[{SPACES}]+\z", ""))


def tokens(low: Column) -> Column:
    """Array of (token, at, end, i): words and the stretches between them, in order."""
    words, gaps = F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), F.split(low, _WORD, -1)

    def both(w: Column, g: Column) -> Column:
        pieces = F.flatten(F.transform(g, lambda x, i: F.filter(F.array(x, F.get(w, i)), lambda y: y.isNotNull())))
        placed = lambda p: let(running(F.transform(p, F.length)), lambda ends: F.transform(p, lambda x, i: F.struct(x.alias("token"), (F.get(ends, i) - F.length(x)).alias("at"), F.get(ends, i).alias("end"), i.alias("i"))))
        return let(pieces, placed)

    return let(words, lambda w: let(gaps, lambda g: both(w, g)))


def _is_word(c: Column) -> Column:
    return c.rlike("^[a-z0-9_]")


def _once(terms: DataFrame) -> DataFrame:
    return terms.select("term").distinct().select(normal(F.col("term")).alias("term")).distinct().where("term <> ''")


def index(terms: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``term`` (normal form, each once), ``token`` (its rarest in ``docs``), ``offset`` (where that begins in the term),
    ``own`` (whether the term can overlap itself) and what verification needs; terms without any character are left out."""
    once = _once(terms)
    parts = once.select("term", F.explode(tokens(F.col("term"))).alias("t")).select("term", F.col("t.token").alias("token"), F.col("t.at").alias("offset"))
    parts = parts.where("token <> ''").withColumn("word", _is_word(F.col("token")))
    # A term with a word is filed under a word; stretches between words count only for terms that have none.
    usable = parts.withColumn("words", F.max("word").over(Window.partitionBy("term"))).where("word = words").drop("word", "words")
    low = folded(F.col(text))
    seen = F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), F.filter(F.split(low, _WORD, -1), lambda g: g != "")))
    usable = usable.persist(StorageLevel.DISK_ONLY)
    wanted = usable.select("token").distinct()
    have = docs.select(F.explode(seen).alias("token")).join(_small(wanted), "token").groupBy("token").agg(F.count("*").alias("docs"))
    ranked = usable.join(have, "token", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), F.xxhash64("token").alias("h"), "token", "offset")).alias("m"))
    return ranked.where("m.docs > 0").select("term", F.col("m.token").alias("token"), F.col("m.offset").alias("offset"), _overlaps(F.col("term")).alias("own"))


def _overlaps(term: Column) -> Column:
    """Whether a term can begin within another place of itself."""
    n = F.length(term)
    return F.exists(F.sequence(F.lit(1), n), lambda k: (k < n) & (F.right(term, n - k) == F.left(term, n - k)))


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast if it is small, by count and by bytes of its strings."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_TERMS and total + 64 * n <= BROADCAST_BYTES else df


def _rows(docs: DataFrame, keys: list[str], text: str, most: int, longest: int, stretches: bool) -> DataFrame:
    """``docs``' ``keys`` with a row for each token: token, at, and the text before and after it, as far as a term of
    ``most`` tokens and ``longest`` characters can reach."""
    trimmed = lambda x: F.when(F.length(x) > 2 * longest + 2, F.concat(F.left(x, F.lit(longest + 1)), F.right(x, F.lit(longest + 1)))).otherwise(x)

    def around(t: Column) -> Column:
        short = F.transform(t, lambda x: trimmed(x["token"]))
        has = lambda x: F.lit(True) if stretches else _is_word(x["token"])
        joined = lambda p, a, n: F.array_join(F.slice(p, a, n), "")

        def one(x: Column, p: Column) -> Column:
            first = F.greatest(F.lit(0), x["i"] - most)
            return F.struct(x["token"].alias("token"), x["at"].alias("at"), F.right(joined(p, first + 1, x["i"] - first), F.lit(longest + 1)).alias("before"), F.left(joined(p, x["i"] + 2, F.lit(most)), F.lit(longest + 1)).alias("after"))

        return let(short, lambda p: F.transform(F.filter(t, has), lambda x: one(x, p)))

    low = folded(F.col(text))
    return exploded(docs.where(F.col(text).isNotNull()).select(*keys, let(tokens(low), around).alias("t")), "t").select(*keys, F.col("t.token").alias("token"), F.col("t.at").alias("at"), F.col("t.before").alias("before"), F.col("t.after").alias("after"))


def _verified(met: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows where a token met the index, those where the whole term stands, with its place."""
    n = F.length("term")
    around = met.withColumn("near", F.concat("before", "token", "after")).withColumn("from", F.length("before") - F.col("offset"))
    stands = (F.col("from") >= 0) & (F.substring(F.col("near"), F.col("from") + 1, n) == F.col("term"))
    edge = lambda left, right: _is_word(left) != _is_word(right)
    before = F.when(F.col("from") > 0, F.substring(F.col("near"), F.col("from"), F.lit(1))).otherwise("")
    after = F.substring(F.col("near"), F.col("from") + n + 1, F.lit(1))
    found = around.where(stands & edge(before, F.left("term", F.lit(1))) & edge(F.right("term", F.lit(1)), after))
    return found.select(*keys, "term", (F.col("at") - F.col("offset")).cast("int").alias("start"), (F.col("at") - F.col("offset") + n).cast("int").alias("end"), "own")


def _apart(found: DataFrame, keys: list[str]) -> DataFrame:
    """Places of one term don't overlap: from left to right, one that begins within the one before is left out.  Only
    terms whose end is also their beginning can, and only these are gathered, by document and term."""
    plain = found.where(~F.col("own")).drop("own")
    places = found.where("own").groupBy(*keys, "term").agg(F.sort_array(F.collect_list("start")).alias("at"), F.first(F.col("end") - F.col("start")).alias("n"))
    kept = F.aggregate("at", F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1) + F.col("n") <= x), F.concat(acc, F.array(x))).otherwise(acc))
    return plain.unionByName(places.select(*keys, "term", F.explode(kept).alias("start"), "n").select(*keys, "term", "start", (F.col("start") + F.col("n")).cast("int").alias("end")))


def _filter(terms: DataFrame, n: int) -> np.ndarray:
    """A filter that has the ``term`` of each of ``n`` rows, and few others: made in a few parts, merged by their pieces."""
    size = 1 << max(13, min(runs.MOST_BITS, runs.BITS * n).bit_length())
    size, piece = min(size, runs.MOST_BITS), 1 << 20

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size >> 3, np.uint8)
        for b in batches:
            runs.filter_of(b.column(0), bits)
        for at in range(0, len(bits), piece):
            if bits[at : at + piece].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([bits[at : at + piece].tobytes()])], ["at", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, bits in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(bits.as_buffer(), np.uint8)
                held[at] = held[at] | own if at in held else own
        for at, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([bits.tobytes()])], ["at", "bits"])

    kind = "at long, bits binary"
    out = np.zeros(size >> 3, np.uint8)
    for r in terms.coalesce(8).mapInArrow(part, kind).repartition("at").mapInArrow(merged, kind).collect():
        out[r["at"] : r["at"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _runs(docs: DataFrame, doc: str, text: str, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """``term``, ``docs`` and ``at`` of all runs of so many whole tokens that have an edge of a word at either end, and that a filter has: a
    row for a run and about ``AT_ONCE`` bytes of texts, with all places there, apart from each other."""
    known = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for terms, count, row, at in runs.runs(texts, sizes, known.value):
            ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (keys.take(pa.array(row)), pa.array(at.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([terms, *lists], ["term", "docs", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            size += b.nbytes
            held.append(b)
            if size > AT_ONCE:
                yield from rows(*(pa.concat_arrays([h.column(i) for h in held]) for i in (0, 1)))
                held, size = [], 0
        if held:
            yield from rows(*(pa.concat_arrays([h.column(i) for h in held]) for i in (0, 1)))

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, F.make_valid_utf8(text).alias(text)).where(F.col(text) != "").mapInArrow(run, f"term string, docs array<{kind}>, at array<int>")


def find_terms(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every place of every ``term`` of ``terms`` in ``docs``: ``doc``, ``term`` (normal form), ``start``, ``end``.

    Null terms and texts have none; terms that are equal in normal form are one; rows that repeat ``doc`` each give theirs.
    """
    docs = docs.select(doc, text)
    tokens_of = F.regexp_count(folded(F.col("term")), F.lit(f"{_WORD}|[^a-z0-9_]+"))
    sized = _once(terms).select("term", tokens_of.alias("size")).persist(StorageLevel.DISK_ONLY)
    counted = {r[0]: r[1] for r in sized.groupBy(F.least("size", F.lit(SHORT + 1)).alias("size")).count().collect()}
    found = docs.sparkSession.createDataFrame([], docs.select(doc, F.lit("").alias("term"), F.lit(0).alias("start"), F.lit(0).alias("end")).schema)
    if sizes := sorted(n for n in counted if n <= SHORT):
        short = sized.where(F.col("size") <= SHORT).select("term")
        met = _runs(docs, doc, text, sizes, _filter(short, sum(counted[n] for n in sizes))).join(_small(short), "term")
        at = met.select("term", F.inline(F.arrays_zip(F.col("docs").alias("doc"), "at")).alias(doc, "start"))
        found = at.select(doc, "term", "start", (F.col("start") + F.length("term")).alias("end"))
    if SHORT + 1 in counted:
        longer = sized.where(F.col("size") > SHORT)
        known = index(longer.select("term"), docs, text).persist(StorageLevel.DISK_ONLY)
        most, longest = longer.agg(F.max("size"), F.max(F.length("term"))).first()
        rows = _rows(docs, [doc], text, most, longest, False)  # a term of several tokens has a word
        found = found.unionByName(_apart(_verified(rows.join(_small(known), "token"), [doc]), [doc]))
    return found


def people(docs: DataFrame, first_names: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Persons by a dictionary of any size (``first_names``: ``name``): ``doc``, ``name``, ``start``, ``end``.

    Runs of two or three capitalised words whose first is in the dictionary, and none of which is a word that names don't
    have, are names; then every place of each of a document's names, in any case, is found by a second join, on document
    and the name's first word.
    """
    own = docs.select(doc, text)
    known = first_names.select(F.lower(F.trim("name")).alias("first")).where("first <> ''").distinct()
    runs = own.select(doc, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)))).alias("name")).where(no_role(F.col("name")))
    named = runs.withColumn("first", F.lower(F.substring_index("name", " ", 1))).join(_small(known), "first")
    named = named.select(F.col(doc).alias("in"), F.col("name"), folded(F.col("name")).alias("term"), folded(F.substring_index("name", " ", 1)).alias("token")).distinct()
    texts = own.join(named.select(F.col("in").alias(doc)).distinct(), doc, "left_semi")
    longest = named.agg(F.coalesce(F.max(F.length("term")), F.lit(1))).first()[0]
    rows = _rows(texts, [doc], text, 5, longest, False)
    met = rows.join(named, (F.col(doc) == F.col("in")) & (rows["token"] == named["token"])).select(doc, rows["token"], "at", "before", "after", "term", "name", F.lit(0).alias("offset"), _overlaps(F.col("term")).alias("own"))
    return _apart(_verified(met, [doc, "name"]).distinct(), [doc, "name"]).select(doc, "name", "start", "end")
