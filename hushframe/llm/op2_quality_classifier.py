"""Quality classifier: a byte-level convolutional network in numpy.

Method: bytes are embedded; learned filters of ``WIDTH`` bytes, every ``WIDTH // 2``, run over the whole document; each
chunk of ``CHUNK`` bytes keeps the largest answer of each filter; chunks overlap by a quarter and the last one ends
with the document.  A hidden layer turns a chunk's maxima into features, and their mean and maximum over all chunks
of a document make one probability.  Training is by stochastic gradients with Adam on the driver, on a bounded sample
of labelled rows: ``ROWS`` rows and ``BYTES`` bytes at most, whole texts, chosen by a hash of the id (a text larger
than a fiftieth of ``BYTES`` isn't learnt from; of rows that repeat an id, the shortest text is, then the least hash).  Scoring is on the executors, a slice of bytes at a time, and nothing of
a row but its text enters a score.

Defined cases: null or empty text is one chunk of zeros and gets the score that has; texts of any length are read whole,
in slices; repeated rows give a row each; ids without a fold (null) are not held out and not learnt from; without labels
every score is 0.5; an empty table gives an empty result; further columns are carried along, except those named as a
result column, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.labelled import fold, sample
from hushframe.llm.scratch import bounded_batches
from hushframe.llm.words import buffers, trimmed

ROWS, BYTES = 3_000, 8_000_000
WIDTH, CHUNK, BLOCK = 8, 256, 64
EMBED, FILTERS, HIDDEN = 6, 24, 12
STEPS, BATCH, RATE, SEED = 450, 16, 0.006, 7
#: Slope below zero, so that no unit stops learning; largest length of a batch's gradient.
LEAK, CLIP = 0.1, 2.0
THRESHOLD = 0.3
SLICE = 1 << 19
_HALF, _PER = WIDTH // 2, CHUNK // BLOCK
_STRIDE = _PER - 1

Weights = dict[str, np.ndarray]


def start() -> Weights:
    r = np.random.default_rng(SEED)
    n = lambda *s, k: (r.standard_normal(s) / np.sqrt(k)).astype(np.float32)
    return {
        "embed": n(256, EMBED, k=1), "filter": n(WIDTH * EMBED, FILTERS, k=WIDTH * EMBED), "bias": np.zeros(FILTERS, np.float32),
        "hidden": n(FILTERS, HIDDEN, k=FILTERS), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": n(2 * HIDDEN, k=2 * HIDDEN), "out_bias": np.zeros(1, np.float32),
    }


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text with zeros up to whole blocks and at least half a filter, and each text's first block."""
    sizes = [-(-(len(t) + _HALF) // BLOCK) * BLOCK for t in texts]
    at = np.concatenate([[0], np.cumsum(sizes)])
    b = np.zeros(at[-1], np.uint8)
    for t, a in zip(texts, at):
        b[a : a + len(t)] = t
    return b, at // BLOCK


def _answers(w: Weights, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each filter's answer at each step, before the bias.  The last step of a text (``ends``: where the next begins) has
    nothing of it but zeros and would see the next text, so it has no answer."""
    x = w["embed"][b].reshape(-1, _HALF * EMBED)
    cut = _HALF * EMBED
    y = x @ w["filter"][:cut]
    y[:-1] += x[1:] @ w["filter"][cut:]
    y[ends // _HALF - 1] = -1e30
    return y


def _chunks(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts that begin at these blocks (the last entry is the end): the blocks of each chunk, and each text's chunks."""
    n = np.diff(block)
    k = np.maximum(1, -(-(n - 1) // _STRIDE))
    first = np.concatenate([[0], np.cumsum(k)])
    own = np.arange(first[-1]) - np.repeat(first[:-1], k)
    begin = np.repeat(block[:-1], k) + np.maximum(0, np.minimum(own * _STRIDE, np.repeat(n, k) - _PER))
    return np.minimum(begin[:, None] + np.arange(_PER), np.repeat(block[1:], k)[:, None] - 1), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _step(w: Weights, texts: list[np.ndarray], y: np.ndarray) -> tuple[float, Weights]:
    """Loss and gradients of one batch; a maximum passes its gradient on to where it was."""
    b, block = _padded(texts)
    answers = _answers(w, b, block[1:] * BLOCK).reshape(-1, BLOCK // _HALF, FILTERS)
    best = answers.argmax(1)
    top = np.take_along_axis(answers, best[:, None], 1)[:, 0]
    of, first = _chunks(block)
    which = top[of].argmax(1)
    raw = np.take_along_axis(top[of], which[:, None], 1)[:, 0] + w["bias"]
    c = np.maximum(raw, LEAK * raw)
    pre = c @ w["hidden"] + w["hidden_bias"]
    h = np.maximum(pre, LEAK * pre)
    n = len(texts)
    mean, most, at = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), int)
    for i in range(n):
        own = h[first[i] : first[i + 1]]
        mean[i], most[i], at[i] = own.mean(0), own.max(0), own.argmax(0) + first[i]
    v = np.concatenate([mean, most], 1)
    p = _sigmoid(v @ w["out"] + w["out_bias"])
    loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
    d = ((p - y) / n).astype(np.float32)
    g = {"out": v.T @ d, "out_bias": d.sum(keepdims=True)}
    dv = d[:, None] * w["out"]
    k = np.diff(first)
    dh = np.repeat(dv[:, :HIDDEN] / k[:, None], k, 0)
    np.add.at(dh, (at, np.arange(HIDDEN)[None]), dv[:, HIDDEN:])
    dh *= np.where(pre > 0, 1, LEAK).astype(np.float32)
    g["hidden"], g["hidden_bias"] = c.T @ dh, dh.sum(0)
    dc = (dh @ w["hidden"].T) * np.where(raw > 0, 1, LEAK).astype(np.float32)
    g["bias"] = dc.sum(0)
    where = np.take_along_axis(of, which, 1)
    place = (where * (BLOCK // _HALF) + best[where, np.arange(FILTERS)[None]]) * _HALF
    chunk, f = np.nonzero(dc)
    grad = dc[chunk, f]
    seen = np.minimum(place[chunk, f][:, None] + np.arange(WIDTH), len(b) - 1)
    patch = w["embed"][b[seen]].reshape(len(grad), WIDTH * EMBED)
    g["filter"] = np.zeros_like(w["filter"])
    g["embed"] = np.zeros_like(w["embed"])
    for j in range(FILTERS):
        own = np.flatnonzero(f == j)
        if len(own):
            g["filter"][:, j] = patch[own].T @ grad[own]
    back = (grad[:, None] * w["filter"].T[f]).reshape(-1, EMBED)
    code = b[seen].ravel()
    for e in range(EMBED):
        g["embed"][:, e] = np.bincount(code, back[:, e], 256)
    return loss, g


def fit(texts: list[np.ndarray], y: np.ndarray, steps: int = STEPS) -> Weights | None:
    """Weights after ``steps`` batches, half of each batch from either label."""
    kinds = [np.flatnonzero(y == k) for k in (0, 1)]
    if not len(kinds[0]) or not len(kinds[1]):
        return None
    w, r = start(), np.random.default_rng(SEED)
    m, s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        pick = np.concatenate([r.choice(k, BATCH // 2) for k in kinds])
        _, g = _step(w, [texts[i] for i in pick], y[pick].astype(np.float32))
        rate = RATE * min(1.0, t / 20, 2 * (1 - t / (steps + 1)))
        long = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        if long > CLIP:
            g = {k: x * (CLIP / long) for k, x in g.items()}
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return w | {"prior": np.float32(np.log(len(kinds[1]) / len(kinds[0])))}


def probabilities(w: Weights | None, column: pa.Array) -> np.ndarray:
    """The probability of each text of a column."""
    at, data = buffers(column)
    n = len(at) - 1
    if w is None:
        return np.full(n, 0.5)
    out, i = np.zeros(n), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        tops = []
        if at[j] - at[i] > SLICE:  # one long text: slices of whole blocks, each with what its last filter still needs
            size, a = int(at[j] - at[i]), int(at[i])
            total = -(-(size + _HALF) // BLOCK) * BLOCK
            for z in range(0, total, SLICE):
                b = np.zeros(min(SLICE, total - z) + BLOCK, np.uint8)
                part = data[a + z : min(a + z + len(b), a + size)]
                b[: len(part)] = part
                ends = np.array([total - z] if z + SLICE >= total else [], int)
                tops.append(_answers(w, b, ends).reshape(-1, BLOCK // _HALF, FILTERS).max(1)[:-1])
            block = np.array([0, total // BLOCK])
        else:
            b, block = _padded([data[at[k] : at[k + 1]] for k in range(i, j)])
            tops.append(_answers(w, b, block[1:] * BLOCK).reshape(-1, BLOCK // _HALF, FILTERS).max(1))
        top = np.concatenate(tops) + w["bias"]
        of, first = _chunks(block)
        c = top[of[:, 0]]
        for k in range(1, _PER):
            c = np.maximum(c, top[of[:, k]])
        pre = np.maximum(c, LEAK * c) @ w["hidden"] + w["hidden_bias"]
        h = np.maximum(pre, LEAK * pre)
        v = np.concatenate([np.add.reduceat(h, first[:-1]) / np.diff(first)[:, None], np.maximum.reduceat(h, first[:-1])], 1)
        out[i:j] = _sigmoid(v @ w["out"] + w["out_bias"] + w["prior"])
        i = j
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Weights | None:
    """Weights from a bounded sample of labelled rows (``labels``: doc_id, quality) of ``docs``."""
    chosen = F.broadcast(sample(labels, "quality", learn, ROWS))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)), "t": F.xxhash64("text")})
    rows = rows.where(F.col("size") <= BYTES // 50)
    one = lambda *more: rows.groupBy("doc_id", "label").agg(F.min(F.struct("size", "t", *more)).alias("one"))
    sizes = one().select("doc_id", "one.size", F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id"])
    last = int((sizes["size"].cumsum() <= BYTES).sum())
    if not last:
        return None
    most = int(sizes["h"].iloc[last - 1])
    got = one("text").where(F.xxhash64("doc_id") <= most).select("doc_id", F.coalesce("one.text", F.lit("")).alias("text"), "label").toPandas().sort_values("doc_id")
    return fit([np.frombuffer(t.encode(), np.uint8) for t in got["text"]], got["label"].to_numpy())


def score(docs: DataFrame, w: Weights | None, threshold: float = THRESHOLD, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (which needs ``text``; without it if not ``with_text``) and ``score``, ``predicted``."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    place, rest = docs.columns.index("text"), [i for i, c in enumerate(docs.columns) if with_text or c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(shared.value, batch.column(place))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(p.astype(float)), pa.array((p >= threshold).astype(np.int32))], [*(batch.schema.names[i] for i in rest), "score", "predicted"])

    return docs.mapInArrow(trimmed(run), docs.select(*(docs.columns[i] for i in rest), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = fold(F.col("doc_id"), 5) == 0
    scored = score(docs, train(docs, labels, ~held_out), with_text=False)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
