"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least ``num / den`` link.

Method: set-relation skipping.  Equal sets are one set from the start.  Each set enters index lists under its rarest
n-grams (as many as the threshold needs, in one order for all sets: by a count-min estimate of the corpus frequency,
then by hash).  Lists are cut into blocks by size, with a set in the block of its size and, under the fewer n-grams that
suffice for the smaller of two sets, in the next; all other blocks of a list are skipped.  Within a block, the position of
the n-gram in the order of either set skips entries, because the rest of either set bounds the overlap from there on.

Only n-grams of two documents or more have a list.  Which they are is counted where the n-grams are, by ranges of their
hashes: documents go into buckets of one Arrow batch, a bucket sends the sorted hashes of a range as one compressed row,
the task of a range adds up the buckets' counts and sends each of them its counts back.  So no sketch of all n-grams is
broadcast, and ranges and buckets keep their size when the input grows.  The sketch that orders n-grams has a fixed size:
it need only tell the frequent ones, and what it can't tell apart is ordered by hash.

Answers are derived from sets that are highly similar: each list has a pivot, its most central set (most of its n-grams
are frequent, as in the original of many copies), and every other entry is first compared with a pivot alone: the one
that most of the set's lists have.  Entries that the links found so far already connect need no comparison.  For the
others, overlaps with the common pivot bound the overlap of two sets from both sides,
|x and p| + |y and p| - |p| <= |x and y| <= |x and p| + |y| - |y and p|, and decide most pairs without looking at them.  A set
also has a profile, the numbers of its n-grams by ranges of their hashes: two sets share no more than the smaller numbers of
each range.  Sets are read and compared in full only for pairs that neither bound decides, so those that share a few rare
n-grams by chance, which a growing corpus has ever more of, cost a profile and not a set.  A list in which many sets are still unconnected after that is split: two of its
sets that can link share a further n-gram among the next ones of either, so they meet again in a list of both n-grams.
That goes on until lists are short, or until sets share as many n-grams as a link needs.  The result is exact: a pair is
left out only if it can't link or if its two sets are connected anyway.

A list isn't held by one task: entries know about how long their list is, those of long lists are dealt by salt, and
pivots come from aggregations with partial results.  For result rows there are ``component_id`` (smallest ``doc_id``
reachable, itself included) and the set's size; copies aren't expanded into pairs.  A set is named by 128 bits.

Defined cases: null or empty text, or text of white space, has an empty set and links with nothing, so its component is
itself; fewer words than ``words`` are one n-gram, the whole sequence; repeated rows give a row each; a null ``doc_id``
links as any other row, but names a component only if all ids in it are null (then null); an empty table gives an empty
result; further columns are carried along, except those named as a result column, which it replaces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm import countmin
from hushframe.llm.components import components
from hushframe.llm.scratch import bounded_batches, cut, drop, keep_only, scope
from hushframe.llm.words import U, grams, hashed_words, mix, trimmed

#: The sketch that tells frequent n-grams.
BITS = 20
#: Entries of a list that go into one salt; rows of a table of sets or pairs that is broadcast, at most.
SALTED, BROADCAST = 512, 500_000
_ROWS = 1 << 20
#: Ranges of a profile, as a binary logarithm.
PROFILE = 7
#: Rounds of comparisons with pivots before lists are split; lists with at most so many pairs of unconnected sets aren't,
#: and what is left after so many splits is compared pair by pair.
ROUNDS, FEW, SPLITS = 4, 1 << 22, 3
#: Rounds end when there are at most so many pairs of unconnected sets for each entry, or nearly as many as before.
LEFT = 64
_WHOLE, _OTHER = U(0xD6E8FEB86659FD93), U(0xA24BAED4963EE407)


def _sets(text: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes of each row with a word."""
    for lo, hi, h, at in hashed_words(text, fold=True):
        g = grams(h, words)
        for i in range(hi - lo):
            a, z = at[i], at[i + 1]
            if z - a >= words:
                yield lo + i, np.unique(g[a : z - words + 1])
            elif z > a:
                yield lo + i, mix(grams(h[a:z], int(z - a)) ^ _WHOLE)


def _name(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([np.sum(mix(s ^ _WHOLE), dtype=U) + U(len(s)), np.sum(mix(mix(s) ^ _OTHER), dtype=U)], U).tobytes()


def _profile(s: np.ndarray) -> bytes:
    """The numbers of a set's n-grams by ranges of hashes, a byte each; larger ones are 255, which leaves a bound a bound."""
    return np.minimum(np.bincount((s >> U(64 - PROFILE)).astype(np.int64), minlength=1 << PROFILE), 255).astype(np.uint8).tobytes()


def _order(level: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The places of a set's n-grams in the order that all sets share."""
    return np.lexsort((s, level))


def _need(x: Column, y: Column, num: int, den: int) -> Column:
    """The overlap that two sets of these sizes need."""
    return F.ceil((num * (x + y)) / F.lit(num + den) - F.lit(1e-9))


def _keys(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    held, size = [], 0
    for _, s in _sets(batch.column(0), words):
        held.append(s)
        size += len(s)
        if size > 1 << 18:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _buckets(docs: DataFrame, words: int, num: int, den: int, sketch) -> DataFrame:
    """One row for each batch: its documents with their sets' names, sizes, profiles and numbers (unique by row), and the
    rarest n-grams of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), 0
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            m, bucket, made = batch.num_rows, task.partitionId() << 22 | made, made + 1
            n, cent, kept, name, profile, tokens = np.zeros(m, np.int64), np.zeros(m, np.int32), np.zeros(m, np.int32), [None] * m, [None] * m, []
            for i, s in _sets(batch.column(1), words):
                level = countmin.frequency(sketch.value, BITS, s)
                n[i], cent[i], name[i], profile[i] = len(s), int(100 * level.mean()), _name(s), _profile(s)
                kept[i] = len(s) - -(-num * len(s) // den) + 1
                tokens.append(s[_order(level, s)[: kept[i]]])
            array = lambda x: pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), x)
            all_tokens = np.concatenate([np.zeros(0, U), *tokens])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket]), array(batch.column(0)), array(batch.column(2)), array(pa.array(name, pa.binary())), array(pa.array(profile, pa.binary())), array(pa.array((bucket << 20) + np.arange(m))), array(pa.array(n)), array(pa.array(cent)),
                    array(pa.array(kept)), pa.array([all_tokens.tobytes()], pa.binary()), pa.array([len(all_tokens)], pa.int64()),
                ],
                ["bucket", "doc_id", "text_key", "name", "profile", "sid", "n", "cent", "kept", "keys", "n_keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(trimmed(run), f"bucket long, doc_id array<{kind}>, text_key array<long>, name array<binary>, profile array<binary>, sid array<long>, n array<long>, cent array<int>, kept array<int>, keys binary, n_keys long")


def _entries(buckets: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The index, of one row of each set (``reps``): token (of a block of a list), sid, n (size), pos, cent (how frequent the set's n-grams are on the mean),
    need (least overlap with a partner in the block), and heat (binary logarithm of the list's length)."""
    step = np.log(den / num) * (1 + 1e-9)
    counted, bits = countmin.counted(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, n, cent, kept, tokens, levels, of in zip(*batch.columns):
                token = np.frombuffer(tokens.as_buffer(), U)
                level = countmin.levels_of(token, levels.as_py(), bits)
                size, most, few_of = (x.values.to_numpy(zero_copy_only=False) for x in (n, cent, kept))
                row = np.repeat(np.arange(len(few_of)), few_of)
                pos = np.arange(len(token)) - np.repeat(np.cumsum(few_of) - few_of, few_of)
                mine = np.isin(sid.values.to_numpy(), of.values.to_numpy())
                use = np.flatnonzero((level > 0) & mine[row])
                token, row, pos, level = token[use], row[use], pos[use].astype(np.int32), level[use]
                m = size[row]
                block = (np.log(np.maximum(m, 1)) / step).astype(np.int64)
                least, more = -(-num * m // den), -(-2 * num * m // (num + den))
                few = np.flatnonzero(pos < m - more + 1)
                own = mix(token ^ (block * 2 + 1).astype(U))
                nxt = mix(token[few] ^ (block[few] * 2 + 3).astype(U))
                both = lambda x, x2=None: np.concatenate([x, x[few] if x2 is None else x2[few]])
                names = sid.values.take(pa.array(both(row)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own, nxt]).view(np.int64)), names, pa.array(both(m)), pa.array(both(pos)),
                        pa.array(both(most[row])), pa.array(both(least, more)), pa.array(both(level).astype(np.int32)),
                    ],
                    ["token", "sid", "n", "pos", "cent", "need", "heat"],
                )

    of = reps.groupBy(F.shiftright("sid", 20).alias("bucket")).agg(F.collect_list("sid").alias("of"))  # rows of one bucket
    joined = buckets.where("n_keys > 0").join(counted, "bucket").join(of, "bucket").select("sid", "n", "cent", "kept", "keys", "levels", "of")
    return joined.mapInArrow(trimmed(run), "token long, sid long, n long, pos int, cent int, need long, heat int")


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``BROADCAST`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _members(docs: DataFrame, reps: DataFrame, sids: DataFrame, words: int, sketch) -> DataFrame:
    """``sid`` and ``grams``, in the order that all sets share, of these sets.

    A set's text is found by id and hash of the text, so rows without id, or with an id that repeats, meet those of equal
    text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            name, sid = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            held, size = [], 0
            for i, s in _sets(batch.column(0), words):
                if sid[i] not in seen and _name(s) == name[i]:  # not another text of the same id
                    seen.add(sid[i])
                    held.append((sid[i], s[_order(countmin.frequency(sketch.value, BITS, s), s)]))
                    size += len(s)
                if size > 1 << 17:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    def made(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        at = np.concatenate([[0], np.cumsum([len(s) for _, s in held])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([s for _, s in held]).view(np.int64)))], ["sid", "grams"])

    wanted = cut(reps.join(sids.distinct(), "sid").select(F.col("doc_id").alias("of"), "text_key", "name", "sid"))
    found = docs.select("doc_id", "text").join(_small(wanted), F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("text_key")))
    sets = cut(found.select("text", "name", "sid").mapInArrow(trimmed(run), "sid long, grams array<long>"))
    return cut(sets.dropDuplicates(["sid"])) if sets.count() > wanted.count() else sets  # rows that repeat id and text


def _bounded(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs`` (a, na, b, nb) with ``most``, the overlap that the two profiles leave room for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 1 << PROFILE).astype(np.int32) for i in (4, 5))
            most = (batch.column(1).to_numpy() + batch.column(3).to_numpy() - np.abs(x - y).sum(1)) // 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(most, pa.int64())], ["a", "na", "b", "nb", "most"])

    small = _small(pairs)
    one, two = (small.join(reps.select(F.col("sid").alias(s), F.col("profile").alias(f"profile_{s}")), s) for s in "ab")
    both = one.join(two.select("a", "b", "profile_b"), ["a", "b"])
    return cut(both.select("a", "na", "b", "nb", "profile_a", "profile_b").mapInArrow(run, "a long, na long, b long, nb long, most long"))


def _overlaps(members, reps: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (a, na, b, nb) with the overlap of the two sets (``both``; null if they can't link), what it is at most, and
    whether they link.  ``members`` gives the sets of a table of ``sid``."""
    with scope() as made:
        pairs = _bounded(cut(pairs), reps)
        need = _need(F.col("na"), F.col("nb"), num, den)
        near = cut(pairs.where(F.col("most") >= need).select("a", "b").distinct())
        sets, small = members(near.select(F.explode(F.array("a", "b")).alias("sid"))), _small(near)
        one, two = (small.join(sets.select(F.col("sid").alias(s), F.col("grams").alias(f"grams_{s}")), s) for s in "ab")
        got = one.join(two, ["a", "b"]).select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("both"))
        got = cut(got)  # numbers, so that the sets go before further tables are made
        out = pairs.join(_small(got), ["a", "b"], "left").select("a", "na", "b", "nb", "both", F.coalesce("both", "most").alias("most"))
        out = cut(out.dropDuplicates(["a", "b"]).withColumn("linked", F.coalesce(F.col("both") >= need, F.lit(False))))
        keep_only(made, out)
    return out


def near_copies(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """All columns of ``docs`` (which needs ``doc_id`` and ``text``), ``n_shingles`` and ``component_id``."""
    docs = docs.drop("n_shingles", "component_id")
    bounded_batches(docs.sparkSession)
    with scope() as made:
        named, of_set = _labelled(docs, words, num, den)
        of_set = cut(of_set)
        keep_only(made, named, of_set)
    result = named.join(of_set, "name", "left").withColumn("component_id", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    if docs.columns == ["doc_id", "text"]:
        return result.select("doc_id", "n_shingles", "component_id")
    per_id = result.groupBy(F.col("doc_id").alias("__hushframe_id"), F.col("name").alias("__hushframe_name")).agg(F.first("n_shingles").alias("n_shingles"), F.first("component_id").alias("component_id"))
    return _with_name(docs, words).join(per_id, F.col("doc_id").eqNullSafe(F.col("__hushframe_id")) & F.col("__hushframe_name_of").eqNullSafe(F.col("__hushframe_name"))).drop("__hushframe_id", "__hushframe_name", "__hushframe_name_of")


def _salts(heat: Column) -> Column:
    return F.greatest(F.lit(1), F.pow(F.lit(2.0), heat).cast("long") / F.lit(SALTED)).cast("int")


def _everywhere(by_token: DataFrame, heat: str) -> DataFrame:
    """A row of each list, for each of the list's parts."""
    return by_token.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col(heat)) - 1))).drop(heat)


def _join(at: DataFrame, by_token: DataFrame, *further: str) -> DataFrame:
    """Entries with what their lists have (from :func:`_everywhere`)."""
    return at.withColumn("salt", F.pmod(F.xxhash64("sid"), _salts(F.col("heat"))).cast("int")).join(by_token, ["token", "salt", *further]).drop("salt")


def _several(at: DataFrame, small: Column) -> DataFrame:
    """``token``, ``n`` (entries), ``pairs`` (of unconnected sets, one of which can be the smaller) and ``h`` of lists with any."""
    of_comp = at.groupBy("token", "comp").agg(F.count("*").alias("c"), F.count_if(small).alias("s"), F.max("heat").alias("h"))
    of_list = of_comp.groupBy("token").agg(F.sum("c").alias("n"), (F.sum("c") * F.sum("s") - F.sum(F.col("c") * F.col("s"))).alias("pairs"), F.max("h").alias("h"))
    return of_list.where("pairs > 0")


def _labelled(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and name of each row, and component_id of each name."""
    context = docs.sparkSession.sparkContext
    sketch = context.broadcast(countmin.frequencies(docs.select("text"), lambda batch: _keys(batch, words), BITS))
    buckets = cut(_buckets(docs, words, num, den, sketch))
    rows = buckets.select(F.inline(F.arrays_zip("doc_id", "text_key", "n", "name", "profile", "sid"))).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "name", "profile", "sid")
    named = cut(rows.drop("sid", "text_key", "profile"))
    # Of each set, the least id and a row that has it.
    reps = rows.where("name is not null").groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid", "text_key", "profile")).alias("r"))
    reps = cut(reps.select("name", F.col("r.doc_id").alias("doc_id"), F.col("r.sid").alias("sid"), F.col("r.text_key").alias("text_key"), F.col("r.profile").alias("profile")))
    with scope() as used:
        lists = cut(_entries(buckets, reps, num, den).withColumn("at", F.lit(1)))
        keep_only(used, lists)
    drop(buckets)
    small = F.col("pos") < F.col("n") - _need(F.col("n"), F.col("n"), num, den) + F.col("at")  # can be the smaller set of a pair
    fits = (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (F.col("at") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1 >= _need(F.col("na"), F.col("nb"), num, den))
    order = [F.least("x", "y").alias("a"), F.when(F.col("x") <= F.col("y"), F.col("nx")).otherwise(F.col("ny")).alias("na"), F.greatest("x", "y").alias("b"), F.when(F.col("x") <= F.col("y"), F.col("ny")).otherwise(F.col("nx")).alias("nb")]

    def star(at: DataFrame) -> DataFrame:
        """``at`` with the pivot of each list; lists without two sets or without one that can be a pair's smaller go."""
        pivot = at.groupBy("token").agg(F.min(F.struct(-F.col("cent"), "n", "sid", "pos")).alias("p"), F.count("*").alias("c"), F.count_if(small).alias("s"), F.max("heat").alias("h")).where("c > 1 and s > 0")
        return _join(at.drop("pivot", "np", "pp"), _everywhere(pivot.select("token", F.col("p.sid").alias("pivot"), F.col("p.n").alias("np"), F.col("p.pos").alias("pp"), "h"), "h"))

    def with_pivots(at: DataFrame) -> DataFrame:
        """Of each set, the pivot that most of its lists have and that can link, as a pair."""
        got = at.where("sid <> pivot").select(F.col("sid").alias("x"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("pivot").alias("y"), F.col("np").alias("nb"), F.col("pp").alias("pb"), "at").where(fits)
        got = got.groupBy("x", "na", "y", "nb").agg(F.count("*").alias("c")).groupBy("x", F.col("na").alias("nx")).agg(F.max(F.struct("c", "y", "nb")).alias("m"))
        return got.select("x", "nx", F.col("m.y").alias("y"), F.col("m.nb").alias("ny")).select(*order).distinct()

    at = cut(star(lists))
    drop(lists)
    members = lambda sids: _members(docs, reps, sids, words, sketch)
    known = _overlaps(members, reps, with_pivots(at), num, den)
    before = float("inf")
    for k in range(ROUNDS):
        # What is left of the lists whose sets aren't all connected; comp is a set's component so far.
        links = known.where("linked").select("a", "b")
        label = _small(components(links)).withColumnRenamed("v", "sid")
        at, now = at.drop("comp").join(label, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), at
        at = cut(_join(at, _everywhere(_several(at, small).select("token", "h"), "h")))
        drop(now)
        n = _several(at, small).agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).first()
        if k + 1 == ROUNDS or not n["n"] or n["pairs"] <= LEFT * n["n"] or n["pairs"] > 0.9 * before:
            break
        before = n["pairs"]
        # A list's entries that aren't connected with their pivot get a pivot of their own, the most central of them.
        of = at.where("sid = pivot").select("token", "pivot", F.col("comp").alias("of"), F.col("heat").alias("h"))
        apart = cut(star(_join(at, _everywhere(of, "h"), "pivot").where("comp <> of").drop("of")))
        more = _overlaps(members, reps, with_pivots(apart).join(known.select("a", "b"), ["a", "b"], "left_anti"), num, den)
        known = cut(known.unionByName(more))
        new = apart.select("token", "sid", F.col("pivot").alias("new"), F.col("np").alias("new_n"), F.col("pp").alias("new_p"))
        at = cut(at.join(new, ["token", "sid"], "left").withColumns({"pivot": F.coalesce("new", "pivot"), "np": F.coalesce("new_n", "np"), "pp": F.coalesce("new_p", "pp")}).drop("new", "new_n", "new_p"))

    at = at.drop("cent", "pp")
    done, ripe = [], []
    for k in range(SPLITS + 1):
        # Lists with few pairs are compared pair by pair, the others split by the next n-gram of their sets.
        pairs_of = _several(at, small).select("token", "pairs", "h")
        at = cut(_join(at, _everywhere(pairs_of, "h")))
        long = at.where(F.col("pairs") > FEW).drop("pairs")
        done.append(at.where((F.col("pairs") <= FEW) | F.lit(k == SPLITS)).drop("pairs"))
        if k == SPLITS or long.isEmpty():
            break
        # Sets that share as many n-grams by now as their sizes need all link with the smallest of them.
        full = long.where("at >= need")
        least = full.groupBy("token").agg(F.min(F.struct("n", "sid")).alias("m"), F.max("heat").alias("h"))
        linked = _join(full, _everywhere(least, "h")).where((F.col("sid") != F.col("m.sid")) & (F.col("at") >= _need(F.col("n"), F.col("m.n"), num, den)))
        ripe.append(linked.select(F.least("sid", "m.sid").alias("a"), F.greatest("sid", "m.sid").alias("b")))
        last = F.least(F.col("n") - F.col("need") + F.col("at"), F.col("n") - 1).cast("int")
        longer = long.join(members(long.select("sid")), "sid").withColumn("last", last).where("pos < last").select("*", F.explode(F.sequence(F.col("pos") + 1, F.col("last"))).alias("next"))
        at = longer.select(F.xxhash64("token", F.get("grams", F.col("next"))).alias("token"), "sid", "n", F.col("next").alias("pos"), "need", "heat", "comp", "pivot", "np", (F.col("at") + 1).alias("at"))

    at = functools.reduce(DataFrame.unionByName, done)
    with_pivot = cut(known.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "both", "most").union(known.select("b", "a", "both", "most")))
    at = at.join(_small(with_pivot), ["sid", "pivot"], "left").withColumns({k: F.when(F.col("sid") == F.col("pivot"), F.col("n")).otherwise(F.col(k)) for k in ("both", "most")})
    at = cut(at)
    x = at.where(small).select("token", F.col("pivot").alias("px"), "np", F.col("sid").alias("x"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"), F.col("both").alias("ba"), F.col("most").alias("ma"), "at")
    y = at.select("token", F.col("pivot").alias("py"), F.col("sid").alias("y"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"), F.col("both").alias("bb"), F.col("most").alias("mb"))
    pairs = x.join(y, "token").where((F.col("na") <= F.col("nb")) & (F.col("ca") != F.col("cb")) & fits)
    same = F.col("px") == F.col("py")
    at_most = F.coalesce(F.when(same, F.least(F.col("ma") + F.col("nb") - F.coalesce("bb", F.lit(0)), F.col("mb") + F.col("na") - F.coalesce("ba", F.lit(0)))), F.least("na", "nb"))
    at_least = F.coalesce(F.when(same, F.col("ba") + F.col("bb") - F.col("np")), F.lit(0))
    need = _need(F.col("na"), F.col("nb"), num, den)
    pairs = pairs.where(at_most >= need).select("x", F.col("na").alias("nx"), "y", F.col("nb").alias("ny"), (at_least >= need).alias("sure"))
    pairs = cut(pairs.select(*order, "sure").groupBy("a", "na", "b", "nb").agg(F.max("sure").alias("sure")).join(known.select("a", "b"), ["a", "b"], "left_anti"))
    last = _overlaps(members, reps, pairs.where("not sure").drop("sure"), num, den)
    label = components(functools.reduce(DataFrame.union, [links, pairs.where("sure").select("a", "b"), last.where("linked").select("a", "b"), *ripe]))

    of_set = reps.join(label.withColumnRenamed("v", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = of_set.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named, of_set.join(least, "comp").select("name", "component_id")


def _with_name(docs: DataFrame, words: int) -> DataFrame:
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = [None] * batch.num_rows
            for i, s in _sets(batch.column(place), words):
                name[i] = _name(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.binary())], [*batch.schema.names, "__hushframe_name_of"])

    return docs.mapInArrow(trimmed(run), docs.select("*", F.lit(None).cast("binary").alias("__hushframe_name_of")).schema)


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_copies(docs, words=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) FOR i IN range(1, len(ws) - 1)]) END AS s
  FROM w
), e AS (
  SELECT doc_id, unnest(s) AS t FROM g
), f AS (
  SELECT t FROM e GROUP BY t HAVING count(*) >= 2
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM e a JOIN f USING (t) JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM o JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y
  WHERE 100 * n >= 90 * (len(a.s) + len(b.s) - n)
), d AS (
  SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM documents
  UNION
  SELECT d.v, r.c FROM r JOIN d ON d.u = r.v WHERE r.c < d.v
)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
FROM g JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) c ON c.v = g.doc_id
"""
