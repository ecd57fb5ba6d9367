"""Engine A and masking in SQL, to hold the expressions against: each pattern a subquery, checks as conditions, and the
first of equal spans by window functions."""

from __future__ import annotations

import re

from hushframe.functions import fixed_values as V
from hushframe.functions.dialect import SPACES, rewritten
from hushframe.functions.native import Rule, built_in


def re2(pattern: str, flags: str = "") -> str:
    """The pattern for DuckDB's matcher, as an SQL string."""
    return (("(?i)" if "i" in flags else "") + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", rewritten(pattern, r"\b", r"\z"))).replace("'", "''")


_S = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", SPACES)
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = "(len(d) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INTEGER) WHEN CAST(reverse(d)[i] AS INTEGER) > 4 THEN 2 * CAST(reverse(d)[i] AS INTEGER) - 9 ELSE 2 * CAST(reverse(d)[i] AS INTEGER) END FOR i IN range(1, len(d) + 1)]) % 10 = 0)"
_MADA = "(d[1:4] IN (" + ", ".join(f"'{p}'" for p in V.MADA_PREFIXES) + "))"
_COMPACT = "upper(regexp_replace(v, '\\s', '', 'g'))"
_GULF = f"regexp_matches({_COMPACT}, '{re2(V.GULF_IBAN)}')"
_VALUES = f"[CASE WHEN ascii(x) >= 65 THEN ascii(x) - 55 ELSE ascii(x) - 48 END FOR x IN string_split({_COMPACT}[5:] || {_COMPACT}[1:4], '')]"
_MOD97 = f"(len({_COMPACT}) BETWEEN 15 AND 34 AND regexp_full_match({_COMPACT}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') AND list_reduce({_VALUES}, lambda a, x: (a * CASE WHEN x >= 10 THEN 100 ELSE 10 END + x) % 97) % 97 = 1)"
_BEFORE = "substr(text, greatest(s - 65, 0) + 1, s - greatest(s - 65, 0))"
_LETTER_AND_DIGIT = "regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')"
_BARE = lambda x: f"regexp_replace(regexp_replace({x}, '^[{_S}]+', ''), '[{_S}]+$', '')"
_TAIL = f"(?is)[{_S}]+(?:phone|tel|fax|email|contact|mobile).*$"
_LINE = f"regexp_replace(regexp_replace({_BARE('v')}, '[,;.]+$', ''), '{_TAIL}', '')"
#: By type: value and start in place of v and s.
_CHANGE = {
    "person": (_BARE("v"), f"s + len(v) - len(regexp_replace(v, '^[{_S}]+', ''))"),
    "ip": ("CASE WHEN NOT contains(v, '.') AND contains(v, '::1') THEN '::1' ELSE v END", "CASE WHEN NOT contains(v, '.') AND contains(v, '::1') THEN s + instr(v, '::1') - 1 ELSE s END"),
    "url": ("rtrim(v, '.,;:!?)')", "s"),
    "address": (_BARE(_LINE), f"s + len(v) - len(regexp_replace(v, '^[{_S}]+', '')) + len({_LINE}) - len(regexp_replace({_LINE}, '^[{_S}]+', ''))"),
}
#: By type: what a span must be, over v (changed), s, d (its digits) and text.
_KEEP = {
    "person": f"len(v) >= 5 AND len(regexp_split_to_array(v, '[{_S}]+')) > 1",
    "credit_card": f"({_MADA} OR ({_LUHN} AND regexp_matches(d, '{V.NETWORK_PREFIX}')))",
    "iban": f"({_GULF} OR {_MOD97})",
    "ip": "(contains(v, ':') OR len([x FOR x IN string_split(v, '.') IF coalesce(TRY_CAST(x AS INTEGER), 0) >= 10]) > 0)",
    "phone": "len(d) BETWEEN 7 AND 15",
    "email": "len(string_split(v, '@')[1]) BETWEEN 1 AND 64 AND len(string_split(v, '@')[2]) BETWEEN 1 AND 253 AND NOT starts_with(v, '.') AND NOT contains(v, '.@') AND NOT regexp_matches(v, '@[.-]')",
    "domain": f"NOT regexp_matches({_BEFORE}, '@[^ ]*$') AND NOT contains(right({_BEFORE}, 10), '://')",
    "saudi_id": "(s = 0 OR substr(text, s, 1) <> '+')",
    "ssn": "d[1:3] NOT IN ('000', '666') AND d[1:1] <> '9' AND d[4:5] <> '00' AND d[6:9] <> '0000'",
    "passport": "len(v) BETWEEN 6 AND 12",
    "license_plate": _LETTER_AND_DIGIT,
    "vin": _LETTER_AND_DIGIT,
    "address": f"len(v) >= 10 AND (regexp_matches(v, '[0-9]') OR len(regexp_split_to_array(v, '[{_S}]+')) >= 3)",
}
#: What stands for a look behind or ahead, which this matcher doesn't have: another pattern, the text to search, and a condition.
_WWW = "regexp_replace({0}, '(?i)(^|[^A-Za-z0-9_-])(-*www)\\.', '\\1\\2 ', 'g')"


def _matches(of: str, rule: Rule, pattern: str, flags: str) -> str:
    """doc_id, text, hit, part and s of all matches of a pattern."""
    searched, also = "text", "true"
    if pattern.startswith(r"\b(?!www\.)"):
        pattern, searched = pattern.replace(r"(?!www\.)", "", 1), _WWW.format(_WWW.format("text"))  # twice, for those side by side
    if pattern.endswith("(?=.*passport)"):
        pattern, also = pattern.removesuffix("(?=.*passport)"), "regexp_matches(substr(text, s + len(hit) + 1), '(?i)^[^\\n\\r\\x{2028}\\x{2029}]*passport')"
    own = re2(pattern, flags)
    both = f"((?s:.*?))({own})"
    all_of = lambda i: f"regexp_extract_all({searched}, '{both}', {i})"
    part = all_of(3) if (rule.group or rule.once) and re.search(r"(?<!\\)\((?!\?)", pattern) else f"list_transform({all_of(2)}, lambda x: '')"
    return f"""SELECT doc_id, text, hit, part, s FROM (SELECT doc_id, text, unnest(hits) AS hit, unnest(parts) AS part,
        unnest([CAST(list_sum([len(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([len(x) FOR x IN hits[1:i - 1]]), 0) AS BIGINT) FOR i IN range(1, len(hits) + 1)]) AS s
      FROM (SELECT doc_id, text, {all_of(1)} AS gaps, {all_of(2)} AS hits, {part} AS parts FROM {of} WHERE regexp_matches({searched}, '{own}'))) WHERE {also}"""


def entities(of: str) -> str:
    """doc_id, text (of the document), v, s, e, type, confidence and emission of engine A over ``of`` (doc_id, text)."""
    every = []
    for r, rule in enumerate(built_in()):
        each = " UNION ALL ".join(f"SELECT {p} AS p, * FROM ({_matches(of, rule, *pattern)})" for p, pattern in enumerate(rule.patterns))
        at = "s + CASE WHEN part = '' THEN 0 ELSE instr(hit, part) - 1 END"
        once = f"QUALIFY row_number() OVER (PARTITION BY doc_id, {at}, len(CASE WHEN part = '' THEN hit ELSE part END) ORDER BY p, s) = 1" if rule.once else ""
        value = ("CASE WHEN part = '' THEN hit ELSE part END", at) if rule.group else ("hit", "s")
        change = _CHANGE.get(rule.type, ("v", "s"))
        sure = f"CASE WHEN {_GULF} THEN 90 ELSE 95 END" if rule.type == "iban" else rule.confidence
        every.append(f"""SELECT {r} AS r, p, pos, doc_id, text, v, s, '{rule.type}' AS type, {sure} AS confidence FROM (
          SELECT p, pos, doc_id, text, v, s, {_DIGITS} AS d FROM (SELECT p, pos, doc_id, text, {change[0]} AS v, {change[1]} AS s FROM (
            SELECT p, s AS pos, doc_id, text, {value[0]} AS v, {value[1]} AS s FROM ({each}) {once}))) WHERE v <> '' AND {_KEEP.get(rule.type, "true")}""")
    return f"""SELECT doc_id, text, v, CAST(s AS INTEGER) AS s, CAST(s + len(v) AS INTEGER) AS e, type, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY r, p, pos) - 1 AS emission
      FROM (SELECT * FROM ({" UNION ALL ".join(every)}) QUALIFY row_number() OVER (PARTITION BY doc_id, s, len(v) ORDER BY r, p, pos) = 1)"""


_PREFIX = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.PREFIX_OF_TYPE.items()) + " ELSE 'REDACTED' END"


def masked(of: str, mode: str, kept: int | None) -> str:
    """doc_id, n (spans) and SHA-256 of the masked text of all documents of ``of``."""
    placed = f"""e0 AS MATERIALIZED ({entities(of)}), e1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, emission) - 1 AS o FROM e0),
      e2 AS (SELECT doc_id, o, s, e, '[' || {_PREFIX} || '_' || (o + 1) || ']' AS ph FROM e1 {f"WHERE o < {kept}" if kept else ""}),
      n AS (SELECT doc_id, count(*) AS n FROM e2 GROUP BY doc_id)"""
    if mode == "safe":
        steps = """h AS (SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS head FROM e2),
      r AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY s, o) AS run FROM h),
      p AS (SELECT doc_id, run, min(s) AS s, max(e) AS e, first(ph ORDER BY e - s DESC, s, o) AS ph FROM r GROUP BY doc_id, run),
      q AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM p),
      t AS (SELECT doc_id, string_agg(substr(text, before + 1, s - before) || ph, '' ORDER BY run) || substr(any_value(text), max(e) + 1) AS masked FROM q JOIN d USING (doc_id) GROUP BY doc_id)"""
    else:
        steps = """k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) AS k FROM e2),
      f(doc_id, k, masked) AS (SELECT doc_id, 0, text FROM d UNION ALL
        SELECT f.doc_id, f.k + 1, substr(masked, 1, s) || ph || substr(masked, e + 1) FROM f JOIN k ON k.doc_id = f.doc_id AND k.k = f.k + 1),
      t AS (SELECT doc_id, first(masked ORDER BY k DESC) AS masked FROM f GROUP BY doc_id)"""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM {of}), {placed}, {steps}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS INTEGER) AS n, sha256(coalesce(t.masked, d.text)) AS masked_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
