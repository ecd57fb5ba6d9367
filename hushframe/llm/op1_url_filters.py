"""URL filters: allow and block rules for URLs, by DataFrame functions only.

Method: pattern rules are indexed by their rarest literal token.  A rule is a regular expression on ``host + path`` with
the literal tokens that any match must contain as whole tokens (runs of ASCII letters and digits).  One pass over the
table counts only tokens that rules have; each rule is filed under the one that the corpus has least often.  The tokens
of an URL fetch the rules filed under them, and only those rules' expressions run on it.  Distinct URLs are judged once.

Two kinds of rules: host rules (``example.org/es/`` fits the host and all its subdomains if the path starts with the
rule's; the longest fitting one decides) come first, then pattern rules (the first in their order decides), then
``allow``.  A rule without a whole literal token is filed under the empty token and runs on every URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated rows
and repeated URLs give a row each; an empty table gives an empty result; further columns are carried along, except
those named as a result column, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is broadcast, above it is joined by shuffle.
BROADCAST_RULES = 50_000
_TOKEN = "[A-Za-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: Words that, as a whole token of the host, block an URL.
BLOCKED_WORDS = ["casino", "poker", "jackpot", "pills", "viagra", "porn", "xxx", "spam", "warez", "torrent", "phishing"]
#: Path parts that block an URL.
BLOCKED_PATHS = ["/ads/", "/adserver/", "/tracking/", "/popup/", "/wp-login.php"]


def host_rule(rule: str, verdict: str, order: int) -> tuple:
    """(rule, kind, verdict, weight, pattern, whole literal tokens) of a rule such as ``example.org/es/``."""
    host, path = rule[: rule.index("/")], rule[rule.index("/") :]
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return rule, "host", verdict, len(rule), pattern, re.findall(_TOKEN, host) + re.findall(rf"{_TOKEN}(?=[^A-Za-z0-9])", path)


def word_rule(word: str, verdict: str, order: int) -> tuple:
    return word, "pattern", verdict, -order, rf"^[^/]*(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])[^/]*(/|$)", [word]


def path_rule(path: str, verdict: str, order: int) -> tuple:
    """A part of the path; one that begins with a slash begins at one."""
    whole = re.findall(rf"(?<=[^A-Za-z0-9]){_TOKEN}(?=[^A-Za-z0-9])", path)
    return path, "pattern", verdict, -order, rf"(?s)^[^/]*(?:/.*)?{re.escape(path)}" if path.startswith("/") else rf"(?s)^[^/]*/.*{re.escape(path)}", whole


def default_rules() -> list[tuple]:
    rules = [host_rule(r, v, i) for i, (r, v) in enumerate(HOST_RULES)]
    rules += [word_rule(w, "block", i) for i, w in enumerate(BLOCKED_WORDS)]
    return rules + [path_rule(p, "block", len(BLOCKED_WORDS) + i) for i, p in enumerate(BLOCKED_PATHS)]


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "/", 1)).otherwise("")
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    path = F.when((F.instr(url, "://") > 0) & (F.instr(rest, "/") > 0), F.substring(rest, F.instr(rest, "/"), F.length(rest))).otherwise("")
    return F.coalesce(path, F.lit(""))


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def judge_urls(pages: DataFrame, rules: Sequence[tuple] | None = None) -> DataFrame:
    """All columns of ``pages`` (which needs ``url``) and ``host``, ``path``, ``rule``, ``verdict``, ``method_rule``.

    ``rule`` and ``method_rule`` are the host rule and the pattern rule that decide, if any.
    """
    spark, rules = pages.sparkSession, default_rules() if rules is None else rules
    pages = pages.drop("host", "path", "rule", "verdict", "method_rule")
    urls = pages.select("url").where("url is not null").distinct()
    urls = urls.select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("at"))
    tokens = urls.select("url", "at", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("at", F.lit(_TOKEN), F.lit(0))))).alias("token"))

    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "id int, rule string, kind string, verdict string, weight int, pattern string, tokens array<string>")
    literal = table.select("id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    counts = tokens.join(hint(literal.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = literal.join(counts, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r"))
    index = table.drop("tokens").join(rarest.select("id", F.col("r.token").alias("token")), "id")

    # The expression comes from the row, so only rules that a token fetched run.
    fitting = tokens.join(hint(index), "token").where(F.expr("rlike(at, pattern)"))
    best = fitting.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "host", F.struct("weight", "rule", "verdict"))).alias("h"),
        F.max(F.when(F.col("kind") == "pattern", F.struct("weight", "rule", "verdict"))).alias("m"),
    )
    best = best.select(F.col("url").alias("__hushframe_url"), F.col("h.rule").alias("rule"), F.coalesce("h.verdict", "m.verdict").alias("verdict"), F.col("m.rule").alias("method_rule"))
    url = F.col("url")
    # Rows without url don't meet in one key of the join: each looks for a number of its own, which no url has.
    key = F.coalesce(url, F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))
    judged = pages.withColumn("__hushframe_key", key).join(best, F.col("__hushframe_key") == best["__hushframe_url"], "left").drop("__hushframe_url", "__hushframe_key").withColumns({"host": host_of(url), "path": path_of(url)})
    return judged.select(*pages.columns, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "method_rule")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "method_rule")


def _sql() -> str:
    host = [(r, v, r[: r.index("/")], r[r.index("/") :]) for r, v in sorted(HOST_RULES, key=lambda x: -len(x[0]))]
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{r}'" for r, _, h, p in host)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for _, v, h, p in host)
    method = " ".join(f"WHEN regexp_matches(host, '(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])') THEN '{w}'" for w in BLOCKED_WORDS)
    method += " " + " ".join(f"WHEN contains(path, '{p}') THEN '{p}'" for p in BLOCKED_PATHS)
    return f"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(regexp_extract(coalesce(rest, ''), '^[^?#]*'), '/(.|\\n|\\r)*$') AS path
  FROM a
), c AS (
  SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS host_verdict, CASE {method} END AS method_rule FROM b
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN host_verdict WHEN method_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, method_rule
FROM c
"""


ORACLE_SQL = _sql()
