"""Mixing sources to target weights by iterative proportional fitting, by DataFrame functions only.

Method: token weights of the cells source x language x topic are raked: in turn, the cells of each source, each
language and each topic are scaled to that margin's target, until ``ROUNDS`` rounds are done.  A cell's ratio of raked to
present tokens, times a common factor, is its documents' probability to be taken, one at most; the factor is calibrated so
that the expected tokens are ``budget`` of all.  A document is taken if a hash of its id falls below its probability, so
a run again, a lost executor or another partitioning take the same documents.

Targets: each margin's present share to the power of ``flatten``, normalised, or shares given by value (values without
a given share keep their flattened one, scaled to what is left).  A share given to a value that no token has goes to the
others in proportion.  A cell is never taken more than whole, so a target above what ``budget`` leaves room for is met as
far as it can be.  Only the table of cells is raked, by aggregations joined back; documents are summed up by cell where
they are and get their cell's probability by a join.

The topic is a rule on the text (``TOPICS``, the first pattern that occurs, else ``prose``) unless there is a column
``topic``.  Tokens are words.

Defined cases: null or empty text has no tokens and the topic ``prose``; cells without tokens are taken whole; null
sources, languages and topics are values of their own; rows with one id are taken or left together; a null id is treated
as one id; an empty table gives an empty result.  Further columns are carried along, except those named as a result
column, which it replaces.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.scratch import cut

MARGINS = ("source", "lang", "topic")
ROUNDS, FLATTEN, BUDGET, SEED = 6, 0.8, 0.8, "mix-1"
#: Steps of the calibration: each takes out cells that are at a probability of one.
STEPS = 4
#: Topic and the pattern that tells it, in this order.
TOPICS = [
    ("licence", "(?i)licen[cs]ed under|all rights reserved|copyright"),
    ("contact", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"),
    ("tabular", " \\| [^\\n]* \\| "),
    ("numeric", "[0-9]{6,}"),
]
#: What a text with the topic has in any case, in lower case: the pattern runs on those texts alone.
_NEEDS = {"licence": ("licen", "all rights", "copyright"), "contact": ("@",), "tabular": (" | ",)}
_RESULT = ["n_tokens", "topic", "weight", "probability", "draw", "taken"]


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        fits = text.rlike(pattern)
        if own := _NEEDS.get(name):
            of = F.lower(text) if name == "licence" else text
            fits = functools.reduce(Column.__or__, (of.contains(x) for x in own)) & fits
        out = F.when(fits, name).otherwise(out)
    return out


def _with_sums(cells: DataFrame, margin: str, **sums: Column) -> DataFrame:
    """``cells`` with sums over the cells of each value of a margin, from an aggregation joined back."""
    by = cells.groupBy(F.col(margin).alias("__value")).agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    return cells.join(by, cells[margin].eqNullSafe(by["__value"])).drop("__value")


def _targets(cells: DataFrame, margin: str, given: dict[str, float], flatten: float, total: float) -> DataFrame:
    """``cells`` and ``t_<margin>``, the tokens that the cell's value of the margin shall have."""
    name = f"t_{margin}"
    share = F.when(F.col("own") > 0, F.pow(F.col("own") / F.lit(total), F.lit(flatten))).otherwise(0.0)
    by = cut(cells.groupBy(F.col(margin).alias("__value")).agg(F.sum("tokens").alias("own")).withColumn("share", share))
    named = F.coalesce(F.col("__value").isin(*given), F.lit(False)) if given else F.lit(False)
    there = {r[0] for r in by.where(named & (F.col("own") > 0)).select("__value").collect()}  # no more than are given
    given = {v: w for v, w in given.items() if v in there}
    rest = by.where(~named).agg(F.sum("share")).first()[0] or 0.0
    left = max(0.0, 1.0 - sum(given.values())) if rest else 0.0
    scale = 1 / (sum(given.values()) + left) if sum(given.values()) + left > 0 else 0.0
    target = F.when(named, F.lit(0.0)).otherwise(F.col("share") / F.lit(rest or 1.0) * left)
    for value, want in given.items():
        target = F.when(F.col("__value") == value, F.lit(float(want))).otherwise(target)
    by = by.select("__value", (target * scale * F.lit(total)).alias(name))
    return cells.join(by, cells[margin].eqNullSafe(by["__value"])).drop("__value")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS, flatten: float = FLATTEN) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) and ``weight``, the raked tokens; their sum is that of the tokens."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    for m in MARGINS:
        cells = _targets(cells, m, dict((targets or {}).get(m, {})), flatten, total)
    cells = cut(cells.withColumn("weight", F.col("tokens").cast("double")))
    for _ in range(rounds):
        for m in MARGINS:
            cells = _with_sums(cells, m, own=F.col("weight"))
            cells = cells.withColumn("weight", F.when(F.col("own") > 0, F.col("weight") * F.col(f"t_{m}") / F.col("own")).otherwise(F.col("weight"))).drop("own")
        cells = cut(cells)
    return cells.drop(*(f"t_{m}" for m in MARGINS))


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``probability`` of each cell, at most one, such that the expected tokens are ``budget`` of all."""
    want = float(cells.agg(F.sum("tokens")).first()[0] or 0) * budget
    ratio, full = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")), F.lit(False)
    for _ in range(STEPS):
        # Cells at a probability of one leave the rest of the budget to the others.
        sums = cells.agg(F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("rest"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("taken")).first()
        factor = (want - (sums["taken"] or 0)) / sums["rest"] if sums["rest"] else 0.0
        full = full | F.coalesce(ratio * F.lit(factor) >= 1, F.lit(True))
    p = F.when(full, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio * F.lit(factor))))
    return cells.select(*MARGINS, "weight", p.alias("probability"))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, flatten: float = FLATTEN, seed: str = SEED, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (which needs ``doc_id``, ``text``, ``source``, ``lang``; without ``text`` if not
    ``with_text``) and ``n_tokens``, ``topic``, ``weight`` (the cell's raked tokens), ``probability``, ``draw`` (0 to 1, by
    id) and ``taken``.  Texts are looked at once; what is known of them is written, and read by both steps."""
    topic = F.col("topic") if "topic" in docs.columns else topic_of(F.coalesce("text", F.lit("")))
    columns = [c for c in docs.columns if c not in _RESULT and (with_text or c != "text")]
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/" + seed))), 1, 8), 16, 10).cast("double") / 2.0**32
    known = cut(docs.select(*columns, words.alias("n_tokens"), topic.alias("topic"), draw.alias("draw")))
    of_cell = cut(known.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    cells = cut(calibrate(rake(of_cell, targets, flatten=flatten), budget)).select(*(F.col(m).alias(f"__{m}") for m in MARGINS), "weight", "probability")
    on = [known[m].eqNullSafe(cells[f"__{m}"]) for m in MARGINS]
    joined = known.join(cells, on[0] & on[1] & on[2], "left").drop(*(f"__{m}" for m in MARGINS))
    return joined.select(*columns, "n_tokens", "topic", "weight", "probability", "draw", (F.col("draw") < F.col("probability")).alias("taken"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix(docs, with_text=False).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 3).alias("weight"), F.round("probability", 9).alias("probability"), "taken")


def _sql() -> str:
    topic = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    out = f"""
WITH d AS (
  SELECT doc_id, source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
         CASE {topic} ELSE 'prose' END AS topic,
         CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/{SEED}'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM documents
), c AS (
  SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), {", ".join(f"m_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM c), {FLATTEN}::DOUBLE) AS s FROM c GROUP BY {m})" for m in MARGINS)}, w0 AS (
  SELECT c.*, c.tokens::DOUBLE AS weight, {", ".join(f"m_{m}.s / (SELECT sum(s) FROM m_{m}) * (SELECT sum(tokens) FROM c) AS t_{m}" for m in MARGINS)}
  FROM c {" ".join(f"JOIN m_{m} ON c.{m} IS NOT DISTINCT FROM m_{m}.{m}" for m in MARGINS)}
)"""
    n = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            out += f", w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, {', '.join(f't_{x}' for x in MARGINS)}, weight * t_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight FROM w{n})"
            n += 1
    out += f", p0 AS MATERIALIZED (SELECT source, lang, topic, tokens, weight, weight / nullif(tokens, 0) AS ratio, false AS filled, sum(tokens) OVER () * {BUDGET}::DOUBLE AS want, 0.0::DOUBLE AS factor FROM w{n})"
    for k in range(STEPS):
        out += f", q{k} AS MATERIALIZED (SELECT * EXCLUDE factor, (want - sum(CASE WHEN filled THEN tokens ELSE 0 END) OVER ()) / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER () AS factor FROM p{k}), p{k + 1} AS MATERIALIZED (SELECT * EXCLUDE filled, filled OR coalesce(ratio * factor >= 1, true) AS filled FROM q{k})"
    out += f""", r AS (
  SELECT source, lang, topic, weight, CASE WHEN filled THEN 1.0::DOUBLE ELSE greatest(0.0, least(1.0, ratio * factor)) END AS probability FROM p{STEPS}
)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(r.weight, 3) AS weight, round(r.probability, 9) AS probability, d.draw < r.probability AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic
"""
    return out


ORACLE_SQL = _sql()
