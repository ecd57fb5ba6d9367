"""Toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihoods.

Method: the two classes, toxic and ordinary, have Kneser-Ney models of the bytes of a word given up to five bytes before
(from the word's start on).  Only the highest order has counts by class; rare expressions are smoothed through
continuation counts of the lower orders, which the classes share.  So what neither class has seen often is judged alike by
both, and the log-likelihood ratio of a word comes from what was seen.  A text is scored by its length-normalised
log-likelihood ratios alone: per byte over the whole text, and, since a few toxic words in a long text hardly move the
ratio of the whole, per word over its most toxic runs of each of ``SPANS`` words and over its ``TOP`` most toxic words
wherever they stand, and the shares of its words whose ratio is above each of ``SPEAKS``; a logistic function turns
these into a probability.  It is fitted to the labelled rows' values under models that have counted all rows but those of the row's
own third.

Bounds: the models count every labelled row for learning and every byte sequence, those seen once included.  Up to
``MAX_GRAMS`` sequences the models are made on the driver and broadcast.  Beyond that they are made and kept as shuffled
tables that grow with the input, and the documents, dealt into buckets of about ``BUCKET`` bytes of text, get the entries
that a bucket's texts need by a join; the scores are the same.  Only the logistic function, of eleven parameters, is fitted
to at most ``ROWS`` rows.  Counting and scoring run on the executors over whole texts; nothing else of a row than its text
enters a score.

Defined cases: null or empty text has no words and gets the score that the logistic function has for no evidence;
texts of any length are read whole; repeated rows give a row each; ids without a fold (null) are not held out and not
learnt from; without labels of both classes every score is the same; an empty table gives an empty result; further
columns are carried along, except those named as a result column, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushframe.llm.labelled import fit_logistic, fold, labelled, sample
from hushframe.llm.scratch import bounded_batches, cut, drop
from hushframe.llm.words import U, buffers, trimmed

ROWS, MAX_GRAMS, ORDER, PARTS = 60_000, 1_000_000, 6, 3
DISCOUNT, SPANS, TOP, SPEAKS = 0.75, (1, 2, 4, 8, 24), (3, 8), (1.5, 3.0)
THRESHOLD = 0.7
PIECE, BUCKET = 1 << 20, 8 << 20
_FEATURES = 1 + len(SPANS) + len(TOP) + len(SPEAKS)
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


class Model(NamedTuple):
    """Log-likelihood ratios: of known sequences, and of any other byte after a known context."""

    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    other: np.ndarray
    weights: np.ndarray
    intercept: float


class Tables(NamedTuple):
    """The same as shuffled ``key, ratio``: models without each part, by number, and the whole one (``PARTS``); see :func:`_keys`."""

    entries: DataFrame
    weights: np.ndarray
    intercept: float


def _grams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For plain bytes that begin and end with a space: the sequence of each byte of a word and of its end (up to
    ``ORDER`` bytes from the word's start on, with the space before it), where they are, and where words end."""
    space = b == 32
    at = np.arange(len(b))
    last = np.maximum.accumulate(np.where(space, at, 0))
    ends = np.zeros(len(b), bool)
    ends[1:] = space[1:] & ~space[:-1]
    use = np.flatnonzero(~space | ends)
    since = use - np.where(space[use], last[use - 1], last[use])
    g = b[use].astype(U)
    for k in range(1, ORDER):
        g |= np.where(since >= k, b[use - np.minimum(k, use)], 0).astype(U) << U(8 * k)
    return g, use, np.flatnonzero(ends[use])


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and plain bytes of pieces of texts, cut at spaces, each with a space before and after."""
    at, data = buffers(column)
    for i in range(len(at) - 1):
        a, end = int(at[i]), int(at[i + 1])
        while a < end:
            z = min(a + PIECE, end)
            b = _PLAIN[data[a:z]]
            while z < end and b[-1] != 32:
                more = _PLAIN[data[z : min(z + PIECE, end)]]
                stop = np.flatnonzero(more == 32)
                b = np.concatenate([b, more[: stop[0] + 1] if len(stop) else more])
                z += int(stop[0]) + 1 if len(stop) else len(more)
            yield i, np.concatenate([[32], b, [32]]).astype(np.uint8)
            a = z


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and bytes of several texts at once: each row's place of the first byte, and all bytes."""
    rows, parts, size = [], [], 0
    for i, b in _texts(column):
        rows.append((i, size))
        parts.append(b)
        size += len(b)
        if size > 1 << 19:
            yield np.array(rows), np.concatenate(parts)
            rows, parts, size = [], [], 0
    if rows:
        yield np.array(rows), np.concatenate(parts)


def count(train: DataFrame) -> DataFrame:
    """``gram`` and, by part, ``ordinary0``, ``toxic0`` and so on, of the texts of ``train`` (text, label, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            kind, gram = (key >> U(56)).astype(np.int32), (key & U((1 << 56) - 1)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(kind), pa.array(n)], ["gram", "kind", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), np.uint64) + U(2) * np.array(batch.column(2).to_pylist(), np.uint64)
            for rows, b in _groups(batch.column(0)):
                g, use, _ = _grams(b)
                of = rows[np.searchsorted(rows[:, 1], use, "right") - 1, 0]
                held.append(np.unique(g | label[of] << U(56), return_counts=True))
                if sum(len(k) for k, _ in held) > 1 << 20:
                    held = [_summed(held)]
                    if len(held[0][0]) > 1 << 19:
                        yield out(*held.pop())
        if held:
            yield out(*_summed(held))

    made = train.select("text", "label", "part").mapInArrow(trimmed(run), "gram long, kind int, n long")
    of = lambda kind, name: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(name)
    return made.groupBy("gram").agg(*(of(2 * k + toxic, f"{name}{k}") for k in range(PARTS) for toxic, name in enumerate(("ordinary", "toxic"))))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)


def _lower(g: np.ndarray) -> np.ndarray:
    """The sequence without its first byte; short ones (from a word's start) have none to lose but their zeros."""
    top = np.zeros(len(g), U)
    for k in range(1, ORDER):
        top = np.where(g >> U(8 * k) > 0, U(8 * k), top)
    return g & ((U(1) << top) - U(1))


def kneser_ney(gram: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Model:
    """The two models as ratios; weights are for the caller to fit."""
    order = np.argsort(gram)
    g, by_class = gram[order].astype(U), [ordinary[order].astype(float), toxic[order].astype(float)]

    def shared(seqs: np.ndarray) -> np.ndarray:
        """Probability of each sequence's last byte by the shared lower orders."""
        out = np.zeros(len(seqs))
        levels = []
        now = g
        for _ in range(ORDER - 1):
            now = np.unique(now[now >= U(256)])
            low, n = np.unique(_lower(now), return_counts=True)
            ctx, at = np.unique(low >> U(8), return_inverse=True)
            levels.append((low, n.astype(float), ctx, np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx)).astype(float)))
            now = low
        chain, s = [], seqs
        for _ in levels:
            s = np.where(s >= U(256), _lower(s), s)
            chain.append(s)
        p = np.full(len(seqs), 1 / 256)
        for (low, n, ctx, total, kinds), s in zip(reversed(levels), reversed(chain)):
            i, j = np.searchsorted(low, s), np.searchsorted(ctx, s >> U(8))
            own = np.where(low[np.minimum(i, len(low) - 1)] == s, n[np.minimum(i, len(low) - 1)], 0.0)
            known = ctx[np.minimum(j, len(ctx) - 1)] == s >> U(8)
            t, k = total[np.minimum(j, len(ctx) - 1)], kinds[np.minimum(j, len(ctx) - 1)]
            p = np.where(known, (np.maximum(own - DISCOUNT, 0) + DISCOUNT * k * p) / np.maximum(t, 1), p)
        out[:] = p
        return out

    if not len(g):
        none = np.zeros(0)
        return Model(none.astype(U), none, none.astype(U), none, np.zeros(_FEATURES), 0.0)
    low = shared(g)
    ctx, at = np.unique(g >> U(8), return_inverse=True)
    logs, others = [], []
    for n in by_class:
        total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, n > 0, len(ctx))
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.where(total[at] > 0, np.maximum(n - DISCOUNT, 0) / np.maximum(total[at], 1), 0) + back[at] * low + 1e-12))
        others.append(np.log(back))
    return Model(g, (logs[1] - logs[0]).astype(np.float32), ctx, (others[1] - others[0]).astype(np.float32), np.zeros(_FEATURES), 0.0)


def tables(counts: DataFrame) -> DataFrame:
    """The models of :func:`kneser_ney` as one table ``key, ratio``, from the table of :func:`count`."""
    s, model = F.col("s"), F.col("model")
    lower = F.lit(0).cast("long")
    for k in range(1, ORDER):
        lower = F.when(s >= F.lit(1 << 8 * k), s.bitwiseAND(F.lit((1 << 8 * k) - 1))).otherwise(lower)
    down, ctx = F.when(s >= 256, lower).otherwise(s), F.shiftright(s, 8)
    left = lambda name, k: sum((F.col(f"{name}{i}") for i in range(PARTS) if i != k), F.lit(0).cast("long"))
    models = F.array(*(F.struct(F.lit(k).alias("model"), left("ordinary", k).alias("n0"), left("toxic", k).alias("n1")) for k in range(PARTS + 1)))
    top = cut(counts.select(F.col("gram").alias("s"), F.inline(models)).where(F.col("n0") + F.col("n1") > 0))
    levels, now = [], top
    for _ in range(ORDER - 1):
        now = cut(now.groupBy("model", down.alias("s")).agg(F.sum((s >= 256).cast("long")).alias("n")))
        levels.append(now)
    of = Window.partitionBy("model", ctx)  # at most 256 rows each
    kinds = lambda n: F.sum((F.col(n) > 0).cast("long")).over(of)
    below = None
    for now in reversed(levels):
        now = now.withColumn("t", F.sum("n").over(of)).withColumn("k", kinds("n"))
        now = now.withColumn("p", F.lit(1 / 256)) if below is None else now.withColumn("down", down).join(below, ["model", "down"])
        p = F.when(F.col("t") > 0, (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("k") * F.col("p")) / F.col("t")).otherwise(F.col("p"))
        below = cut(now.select("model", s.alias("down"), p.alias("p")))
    now = top
    for c in "01":
        now = now.withColumn(f"t{c}", F.sum(f"n{c}").over(of)).withColumn(f"back{c}", F.when(F.col(f"t{c}") > 0, DISCOUNT * kinds(f"n{c}") / F.col(f"t{c}")).otherwise(1.0))
    log = lambda c: F.log(F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"t{c}"), F.lit(1)) + F.col(f"back{c}") * F.col("p") + 1e-12)
    own = lambda x: x.bitwiseOR(F.shiftleft(model.cast("long"), 56))
    known = now.withColumn("down", down).join(below, ["model", "down"]).select(own(s).alias("key"), (log("1") - log("0")).cast("float").alias("ratio"))
    other = now.groupBy("model", ctx.alias("s")).agg((F.log(F.first("back1")) - F.log(F.first("back0"))).cast("float").alias("ratio"))
    return cut(known.union(other.select(F.bitwise_not(own(s)), "ratio")))


def _keys(g: np.ndarray, model: int) -> np.ndarray:
    """Keys in the tables of what the sequences need: themselves and, as complements, their contexts."""
    own = U(model) << U(56)
    return np.concatenate([(g | own).view(np.int64), ~(np.unique(g >> U(8)) | own).view(np.int64)])


def _from_tables(rows: DataFrame, entries: DataFrame, made: str, what) -> DataFrame:
    """``row`` and what ``what`` makes of the features of ``rows`` (row, text, model), with the models in tables."""
    n = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row", "text"), F.lit(n))).repartition(int(n), "bucket")

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, model = (np.array(batch.column(i).to_pylist(), np.int64) for i in (2, 1))
            for b, k in {*zip(bucket.tolist(), model.tolist())}:
                some = batch.column(0).take(pa.array(np.flatnonzero((bucket == b) & (model == k))))
                for _, text in _groups(some):
                    keys = _keys(np.unique(_grams(text)[0]), k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b)), pa.array(keys)], ["bucket", "key"])

    needed = dealt.select("text", "model", "bucket").mapInArrow(trimmed(need), "bucket long, key long").distinct()
    schema = StructType([rows.schema["row"], *StructType.fromDDL(made)])

    def over(own: pa.Table, found: pa.Table) -> pa.Table:
        key, ratio = found.column("key").to_numpy(), found.column("ratio").to_numpy()
        model, x = own.column("model").to_numpy(), np.zeros((own.num_rows, _FEATURES))
        for k in np.unique(model):
            part = []
            for at, plain in ((key >= 0, key), (key < 0, ~key)):
                at &= plain >> 56 == k
                s, r = (plain[at] & ((1 << 56) - 1)).view(U), ratio[at]
                order = np.argsort(s)
                part += [s[order], r[order]]
            at = np.flatnonzero(model == k)
            x[at] = features(Model(*part, np.zeros(_FEATURES), 0.0), own.column("text").take(pa.array(at)))
        return pa.table([own.column("row"), *what(x)], names=schema.names)

    found = needed.join(entries, "key").select("bucket", "key", "ratio")
    return dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(over, schema)


def _ratios(m: Model, g: np.ndarray) -> np.ndarray:
    known, out = np.zeros(len(g), bool), np.zeros(len(g))
    if len(m.grams):
        i = np.minimum(np.searchsorted(m.grams, g), len(m.grams) - 1)
        known = m.grams[i] == g
        out = np.where(known, m.ratio[i], 0).astype(float)
    if not len(m.contexts):
        return out
    rest = np.flatnonzero(~known)
    c = g[rest] >> U(8)
    j = np.minimum(np.searchsorted(m.contexts, c), len(m.contexts) - 1)
    out[rest] = np.where(m.contexts[j] == c, m.other[j], 0)
    return out


class _Seen:
    """What the features of one text are made from, piece by piece."""

    __slots__ = ("best", "bytes", "speaks", "sum", "top", "words")

    def __init__(self) -> None:
        self.bytes = self.words = 0
        self.sum, self.best, self.speaks, self.top = 0.0, [-9.0] * len(SPANS), [0] * len(SPEAKS), np.zeros(0)

    def add(self, word: np.ndarray, size: int) -> None:
        self.bytes, self.words, self.sum = self.bytes + size, self.words + len(word), self.sum + float(word.sum())
        word = np.clip(word, -4, 12)
        total = np.concatenate([[0.0], np.cumsum(word)])
        for i, span in enumerate(SPANS):
            k = min(span, len(word))  # a shorter text is as a run with nothing around it
            self.best[i] = max(self.best[i], float((total[k:] - total[:-k]).max()) / span)
        most = max(TOP)
        self.top = np.sort(np.concatenate([self.top, np.partition(word, -most)[-most:] if len(word) > most else word]))[-most:]
        self.speaks = [n + int((word > least).sum()) for n, least in zip(self.speaks, SPEAKS)]

    def features(self) -> list[float]:
        if not self.words:
            return [0.0] * _FEATURES
        shares = [float(np.sqrt(n / self.words)) for n in self.speaks]
        return [float(np.clip(self.sum / self.bytes, -3, 3)), *self.best, *(float(self.top[-k:].sum()) / k for k in TOP), *shares]


def features(m: Model, column: pa.Array) -> np.ndarray:
    seen: dict[int, _Seen] = {}
    for rows, b in _groups(column):
        g, use, ends = _grams(b)
        if not len(g):
            continue
        total = np.concatenate([[0.0], np.cumsum(_ratios(m, g))])
        stop = np.concatenate([[0], ends + 1])
        word = np.diff(total[stop])
        cut = np.searchsorted(use[ends], np.append(rows[1:, 1], len(b)), "left")
        a = 0
        for (i, _), z in zip(rows, cut):
            if z > a:
                seen.setdefault(int(i), _Seen()).add(word[a:z], int(stop[z] - stop[a]))
            a = z
    none = [0.0] * _FEATURES
    return np.array([seen[i].features() if i in seen else none for i in range(len(column))]).reshape(-1, _FEATURES)


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = ROWS) -> Model | Tables:
    """A model from labelled rows (``labels``: doc_id, toxic) of ``docs``: all are counted, ``rows`` fit the weights."""
    bounded_batches(docs.sparkSession)
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(PARTS)).cast("int")
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    rows_of = texts.join(F.broadcast(sample(labels, "toxic", learn, rows)), "doc_id").withColumn("part", part)
    every = texts.join(labelled(labels, "toxic", learn).hint("shuffle_hash"), "doc_id").withColumn("part", part)
    counts = cut(count(every))
    if counts.count() > MAX_GRAMS:
        entries = tables(counts)
        of = rows_of.select(F.struct("label").alias("row"), "text", F.col("part").alias("model"))
        got = _from_tables(of, entries, "x array<double>", lambda x: [pa.array(list(x), pa.list_(pa.float64()))]).select("row.label", "x").toPandas()
        x = np.array(got["x"].tolist()).reshape(-1, _FEATURES)
        return Tables(entries, *fit_logistic(x, got["label"].to_numpy(float)))
    names = [[f"{name}{k}" for k in range(PARTS)] for name in ("ordinary", "toxic")]
    table = counts.toPandas()
    drop(counts)
    gram, by_part = table["gram"].to_numpy(), [[table[c].to_numpy() for c in own] for own in names]
    whole = [sum(own) for own in by_part]
    m = kneser_ney(gram, *whole)
    without = []
    for k in range(PARTS):
        left = [w - own[k] for w, own in zip(whole, by_part)]
        some = left[0] + left[1] > 0
        without.append(kneser_ney(gram[some], left[0][some], left[1][some]))
    shared = docs.sparkSession.sparkContext.broadcast(without)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.array(batch.column(2).to_pylist())
            x = np.zeros((batch.num_rows, _FEATURES))
            for k in range(PARTS):
                if len(own := np.flatnonzero(part == k)):
                    x[own] = features(shared.value[k], batch.column(0).take(pa.array(own)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    got = rows_of.select("text", "label", "part").mapInArrow(trimmed(run), "label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, _FEATURES)
    weights, intercept = fit_logistic(x, got["label"].to_numpy(float))
    return m._replace(weights=weights, intercept=intercept)


def score(docs: DataFrame, m: Model | Tables, threshold: float = THRESHOLD, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (which needs ``text``; without it if not ``with_text``) and ``score``, ``predicted``."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    place, rest = docs.columns.index("text"), [i for i, c in enumerate(docs.columns) if with_text or c != "text"]
    if isinstance(m, Tables):
        weights, intercept = m.weights, m.intercept

        def judged(x: np.ndarray) -> list[pa.Array]:
            p = 1 / (1 + np.exp(-np.clip(x @ weights + intercept, -30, 30)))
            return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

        of = docs.select(F.struct(*(docs.columns[i] for i in rest)).alias("row"), "text", F.lit(PARTS).alias("model"))
        return _from_tables(of, m.entries, "score double, predicted int", judged).select("row.*", "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value
            p = 1 / (1 + np.exp(-np.clip(features(own, batch.column(place)) @ own.weights + own.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*(batch.schema.names[i] for i in rest), "score", "predicted"])

    return docs.mapInArrow(trimmed(run), docs.select(*(docs.columns[i] for i in rest), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = fold(F.col("doc_id"), 3) == 1
    scored = score(docs, train(docs, labels, ~held_out), with_text=False)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
