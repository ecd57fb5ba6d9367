"""Quality rules: base rules on counts of a text, then robust multivariate outliers, by DataFrame functions only.

Method: minimum covariance determinant per language and source.  The statistics of a text become a vector of
transformed values.  For each group, concentration steps from several starts (medians with fixed scales, medians with
the group's own spreads, mean and covariance of all its rows) give the mean and covariance of the three quarters of its
rows that lie closest together; of these, the one with the smallest determinant is the group's estimate.  Rows whose
Mahalanobis distance exceeds ``CUTOFF``, a quantile of the chi-square distribution, are rejected; distances are scaled so
that the group's median is that distribution's.  Variances aren't taken below a floor (``SCALES``), since most texts have
no symbols or repeats at all and a single one isn't an outlier.  Groups under ``LEAST`` rows take the estimate of their
language, and languages under it that of all rows.

Only rows that pass the base rules take part in the estimates.  Quantiles come from counts by bin, so a group that holds
a third of all rows is summed up where its rows are; nothing but group estimates is joined back.

Defined cases: null text counts as empty; an empty or short text fails the base rules; null languages and sources are
groups of their own; repeated rows count and are judged each; an empty table gives an empty result.  Columns of the
input other than ``text`` are carried along, except those named as a result column, which it replaces.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.llm.scratch import cut

MIN_WORDS, MAX_REPEAT = 50, 50
#: Share of a group's rows in the estimate, concentration steps, rows that a group needs for one of its own.
SHARE, STEPS, LEAST = 0.75, 3, 60
#: Smallest standard deviation of each transformed value.
SCALES = (0.7, 0.5, 1.0, 1.2, 1.5)
#: How much correlations are shrunk, so that statistics that go together have an inverse.
SHRINK = 0.02
#: Squared scaled distance above which a row is rejected, the chi-square quantile for five values at 1 - 10**-9, and the
#: median for five values.
CUTOFF, MEDIAN = 52.65, 4.351
_P = len(SCALES)
_X = [f"x{i}" for i in range(_P)]
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_SPACE = "[\\x20\\x09-\\x0D]+"
_GROUP = ["g_level", "g_lang", "g_source"]
_START = [*_GROUP, "start"]
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_statistics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    docs = docs.drop(*_STATS, "kept", "distance")
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.select(*rest, F.array_remove(F.split(text, _SPACE), "").alias("__w"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("__l"))
    w = F.col("__w")
    own = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    df = df.select(*rest, F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), "n_symbols", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), own.alias("__h"))
    # Most texts repeat no window, which a set of hashes tells; only the others are sorted.
    at = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), at)).drop("__h")
    s = F.col("__s")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    df = df.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__s")
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return df.select(*rest, *_STATS[:-1], failed.alias("base_failed"))


def _vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(words + 1), F.col("word_chars") / words, F.log(1 + 1000 * F.col("n_symbols") / chars),
        F.log(F.col("n_dup_lines") + 1), F.log(1 + 100 * F.col("n_repeat_words") / words),
    ]


def _quantile(df: DataFrame, keys: list[str], value: Column, width: float, share: float) -> DataFrame:
    """By keys, the upper edge of the bin of ``width`` that holds the quantile."""
    bins = df.select(*keys, F.floor(value / width).alias("bin")).groupBy(*keys, "bin").count()
    order = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumn("below", F.sum("count").over(order)).withColumn("all", F.sum("count").over(Window.partitionBy(*keys)))
    return bins.where(F.col("below") >= share * F.col("all")).groupBy(*keys).agg(((F.min("bin") + 1) * width).alias("q"))


def _join(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    keys = [c for c in _START if c in df.columns and c in other.columns]
    named = other.select(*(F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in other.columns))
    return df.join(named, functools.reduce(Column.__and__, (df[c].eqNullSafe(named[f"__{c}"]) for c in keys)), how).drop(*(f"__{c}" for c in keys))


def _distance(x: list[Column], of=F.col) -> Column:
    z = [v - of(f"m{i}") for i, v in enumerate(x)]
    return sum(((1 if i == j else 2) * of(f"p{i}{j}") * z[i] * z[j] for i, j in _PAIRS), F.lit(0.0))


def _estimate(near: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: mean m, and p, the inverse of the covariance with floored variances (by sweeping), and the covariance's
    log_det."""
    a = near.groupBy(*keys).agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)), *(F.covar_pop(_X[i], _X[j]).alias(f"p{i}{j}") for i, j in _PAIRS))
    regular = {f"p{i}{j}": F.greatest(f"p{i}{i}", F.lit(SCALES[i] ** 2)) if i == j else F.col(f"p{i}{j}") * (1 - SHRINK) for i, j in _PAIRS}
    a = cut(a.withColumns(regular).withColumn("log_det", F.lit(0.0)))
    at = lambda i, j: F.col(f"p{min(i, j)}{max(i, j)}")
    for k in range(_P):
        new = {"log_det": F.col("log_det") + F.log(at(k, k))}
        for i, j in _PAIRS:
            if i == j == k:
                new[f"p{i}{j}"] = -1 / at(k, k)
            elif k in (i, j):
                new[f"p{i}{j}"] = at(i, j) / at(k, k)
            else:
                new[f"p{i}{j}"] = at(i, j) - at(i, k) * at(k, j) / at(k, k)
        a = a.withColumns(new)
    return cut(a.withColumns({f"p{i}{j}": -at(i, j) for i, j in _PAIRS}))


def robust_estimates(stats: DataFrame) -> DataFrame:
    """By g_level (0 all, 1 language, 2 language and source), g_lang, g_source: rows, mean, precision, and the factor
    that scales squared distances."""
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("l"), (F.col("lang") if k else F.lit(None)).cast("string").alias("a"), (F.col("source") if k > 1 else F.lit(None)).cast("string").alias("s")) for k in range(3))))
    rows = stats.where("not base_failed").select(*(v.alias(x) for v, x in zip(_vector(), _X)), level.alias("g"))
    rows = cut(rows.select(*_X, F.col("g.l").alias("g_level"), F.col("g.a").alias("g_lang"), F.col("g.s").alias("g_source")))
    long = rows.select(*_GROUP, F.posexplode(F.array(*_X)).alias("k", "x"))
    wide = lambda df, name: df.groupBy(*_GROUP).agg(*(F.max(F.when(F.col("k") == i, F.col("q"))).alias(f"{name}{i}") for i in range(_P)))
    medians = cut(wide(_quantile(long, [*_GROUP, "k"], F.col("x"), 0.01, 0.5), "m"))
    middle = F.array(*(F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(_X)))
    spreads = wide(_quantile(_join(rows, medians).select(*_GROUP, F.posexplode(middle).alias("k", "x")), [*_GROUP, "k"], F.col("x"), 0.01, 0.5), "d")
    params = [*(f"m{i}" for i in range(_P)), *(f"p{i}{j}" for i, j in _PAIRS)]
    fixed = medians.withColumns({f"p{i}{j}": F.lit(1 / SCALES[i] ** 2 if i == j else 0.0) for i, j in _PAIRS})
    # The median absolute deviation of a normal distribution is 0.6745 of its standard deviation.
    own = _join(medians, spreads).withColumns({f"p{i}{j}": F.pow(F.greatest(F.col(f"d{i}") / 0.6745, F.lit(SCALES[i])), F.lit(-2.0)) if i == j else F.lit(0.0) for i, j in _PAIRS})
    every = _estimate(rows, _GROUP)
    starts = [df.select(*_GROUP, F.lit(k).alias("start"), *params) for k, df in enumerate((fixed, own, every))]
    of = cut(functools.reduce(DataFrame.unionByName, starts))
    # Squared distances are binned by their logarithm.
    binned = F.log(_distance([F.col(x) for x in _X]) + 1e-6)
    for _ in range(STEPS):
        d = _join(rows, of)
        limit = _quantile(d, _START, binned, 0.02, SHARE)
        of = _estimate(_join(d, limit).where(binned <= F.col("q")).select(*_X, *_START), _START)
    best = of.groupBy(*_GROUP).agg(F.min(F.struct("log_det", "start", *params)).alias("b"))
    of = cut(best.select(*_GROUP, "b.*").drop("start", "log_det"))
    middle = _quantile(_join(rows, of), _GROUP, binned, 0.02, 0.5).select(*_GROUP, (MEDIAN / F.exp("q")).alias("factor"))
    n = rows.groupBy(*_GROUP).agg(F.count("*").alias("n"))
    return cut(_join(_join(of, middle), n))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (which needs ``text``, ``lang``, ``source``) but ``text``, the statistics, ``base_failed``,
    ``distance`` (scaled and squared) and ``kept``."""
    stats = cut(base_statistics(docs))
    of = robust_estimates(stats)
    params = F.struct("n", "factor", *(f"m{i}" for i in range(_P)), *(f"p{i}{j}" for i, j in _PAIRS))
    own = lambda k: of.where((F.col("g_level") == k) & (F.col("n") >= LEAST)).select(F.col("g_lang").alias("__a"), F.col("g_source").alias("__s"), params.alias(f"of{k}"))
    groups = stats.select(F.col("lang").alias("__lang"), F.col("source").alias("__source")).distinct()
    for k in (1, 2):
        by = own(k)
        on = groups["__lang"].eqNullSafe(by["__a"])
        groups = groups.join(by, on & groups["__source"].eqNullSafe(by["__s"]) if k == 2 else on, "left").drop("__a", "__s")
    # The estimate of all rows is one row, so its numbers go into the expression.
    if every := of.where("g_level = 0").select(params.alias("p")).first():
        kinds = of.select(params.alias("p")).schema["p"].dataType
        of0 = F.struct(*(F.lit(every.p[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields))
    else:
        of0 = F.lit(None)
    groups = cut(groups.select("__lang", "__source", F.coalesce("of2", "of1", of0).alias("__of")))
    both = stats.join(groups, stats["lang"].eqNullSafe(groups["__lang"]) & stats["source"].eqNullSafe(groups["__source"]), "left")
    distance = _distance(_vector(), lambda name: F.col("__of")[name]) * F.col("__of")["factor"]
    kept = ~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))
    return both.select(*stats.columns, distance.alias("distance"), kept.alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", *_STATS, "kept")
