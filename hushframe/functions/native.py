"""Many patterns over one text as one Spark expression, and the checks of engine A.

Matches are found for a batch of texts at once (:mod:`hushframe.functions.batch`).  Spans come in order of the rules and their
patterns, then of places: the order in which the first of two equal spans stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions import batch
from hushframe.functions import checks as C
from hushframe.functions import fixed_values as V
from hushframe.functions.batch import to_re2
from hushframe.functions.dialect import SPACES, needs

ENTITY = "struct<text:string,type:string,start:int,end:int,confidence:int,emission:int>"
_FOUND = "array<struct<rule:int,text:string,start:int,end:int,part:string>>"


class Patterns(NamedTuple):
    """The patterns of one rule.  ``group``: the first group, if it has matched, is looked at as well.  ``dotted``: patterns of
    which a full stop is all that is known have it between two letters or digits."""

    patterns: list[tuple[str, str]]
    group: bool = False
    dotted: bool = False


def patterns_of(rules: Iterable[Patterns]) -> list[batch.Pattern]:
    return [batch.Pattern(i, p, flags, rule.group, rule.dotted and needs(p, flags).literals == (".",)) for i, rule in enumerate(rules) for p, flags in rule.patterns]


def scan(text: Column, rules: Iterable[Patterns]) -> Column:
    """Array of (rule, text, start, end, part) of all matches; null for a null text."""
    patterns = patterns_of(rules)

    def run(texts: pa.Array) -> pa.Array:
        return batch.find(texts, patterns)

    return F.arrow_udf(run, _FOUND)(F.make_valid_utf8(text))


# Engine A


class Spans(NamedTuple):
    """Spans of a batch: the number of each one's text, the span's text and where it starts; and all texts."""

    row: np.ndarray
    text: pa.Array
    start: np.ndarray
    of: list[str | None]

    def where(self, keep: np.ndarray) -> Spans:
        return self if keep.all() else Spans(self.row[keep], self.text.filter(pa.array(keep)), self.start[keep], self.of)


class Rule(NamedTuple):
    """A type with its patterns.  ``once``: a place of the group counts once in a rule.  ``change`` makes of spans others;
    ``keep`` says which of them stay, ``confidence`` may differ by span: functions of a batch's spans."""

    type: str
    confidence: int | Callable[[Spans], np.ndarray]
    patterns: list[tuple[str, str]]
    group: bool = False
    once: bool = False
    dotted: bool = False
    change: Callable[[Spans], Spans] | None = None
    keep: Callable[[Spans], np.ndarray] | None = None


BLANK = "".join(c for c in map(chr, range(1 << 16)) if re.match(f"[{SPACES}]", c))
_BLANKS = to_re2(r"\s+")


def length(text: pa.Array) -> np.ndarray:
    return pc.utf8_length(text).to_numpy()


def _has(text: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)


def _each(check: Callable[[str], bool]) -> Callable[[Spans], np.ndarray]:
    return lambda x: np.fromiter(map(check, x.text.to_pylist()), bool, len(x.text))


def _stripped(x: Spans) -> Spans:
    """Without spaces around."""
    left = pc.utf8_ltrim(x.text, characters=BLANK)
    return x._replace(text=pc.utf8_rtrim(left, characters=BLANK), start=x.start + length(x.text) - length(left))


def _parts(text: pa.Array) -> np.ndarray:
    return pc.count_substring_regex(text, _BLANKS).to_numpy() + 1


def _ip(x: Spans) -> Spans:
    local = _has(x.text, "^[^.]*::1")
    at = np.array([t.find("::1") for t in x.text.to_pylist()])
    return x._replace(text=pc.if_else(pa.array(local), "::1", x.text), start=np.where(local, x.start + at, x.start))


def _no_version(text: str) -> bool:
    """Four numbers under ten look like a version."""
    return ":" in text or any(p.isdigit() and int(p) >= 10 for p in text.split("."))


def _url(x: Spans) -> Spans:
    return x._replace(text=pc.utf8_rtrim(x.text, characters=".,;:!?)"))


def _before(x: Spans, n: int) -> list[str]:
    return [x.of[i][max(0, s - n) : s] for i, s in zip(x.row.tolist(), x.start.tolist())]


def _alone(x: Spans) -> np.ndarray:
    """Domains that belong to neither a mail address nor a web address."""
    return np.array(["@" not in b[b.rfind(" ") + 1 :] and "://" not in b[-10:] for b in _before(x, 65)], bool)


def _address(x: Spans) -> Spans:
    x = _stripped(x)
    cut = pc.replace_substring_regex(x.text, r"[,;.]+\z", "")
    return _stripped(x._replace(text=pc.replace_substring_regex(cut, "(?is)" + to_re2(V.ADDRESS_TAIL.replace(r"[\S\s]*", "")) + r".*\z", "")))


def _compact(x: Spans) -> list[str]:
    return pc.utf8_upper(pc.replace_substring_regex(x.text, r"\s", "")).to_pylist()


def _gulf(x: Spans) -> np.ndarray:
    return np.array([c.isascii() and C.gulf(c) for c in _compact(x)], bool)


def _iban(x: Spans) -> np.ndarray:
    return np.array([c.isascii() and (C.gulf(c) or C.mod97(c)) for c in _compact(x)], bool)


def _names() -> dict[str, str]:
    return {"FIRST": "|".join([*V.ARABIC_FIRST, *V.ARABIC_FIRST_FEMALE]), "FAMILY": "|".join(V.ARABIC_FAMILY)}


def filled(patterns: Iterable[tuple[str, str]], parts: dict[str, str]) -> list[tuple[str, str]]:
    out = []
    for p, flags in patterns:
        for name, value in parts.items():
            p = p.replace("{" + name + "}", value)
        out.append((p, flags))
    return out


def _letter_and_digit(x: Spans) -> np.ndarray:
    return _has(x.text, "[A-Za-z]") & _has(x.text, "[0-9]")


def _between(n: np.ndarray, least: int, most: int) -> np.ndarray:
    return (n >= least) & (n <= most)


def built_in() -> list[Rule]:
    """The types in their order, without terms of a user and names by a dictionary."""
    return [
        Rule("person", 85, filled(V.ARABIC_NAMES, _names()), change=_stripped, keep=lambda x: (length(x.text) >= 5) & (_parts(x.text) > 1)),
        Rule("financial", 95, filled(V.FINANCIAL, V.AMOUNT_PARTS)),
        Rule("credit_card", 95, V.CARDS, keep=_each(C.card)),
        Rule("iban", lambda x: np.where(_gulf(x), 90, 95), V.IBANS, keep=_iban),
        Rule("ip", 95, filled(V.IPS, V.IP_PARTS), dotted=True, change=_ip, keep=_each(_no_version)),
        Rule("phone", 85, V.PHONES, keep=lambda x: _between(pc.count_substring_regex(x.text, "[0-9]").to_numpy(), 7, 15)),
        Rule("email", 95, V.EMAILS, keep=_each(C.email_parts)),
        Rule("url", 95, V.URLS, change=_url),
        Rule("domain", 90, filled(V.DOMAINS, {"TLDS": "|".join(V.TLDS)}), dotted=True, keep=_alone),
        Rule("saudi_id", 90, V.SAUDI_IDS, keep=lambda x: np.array([b != "+" for b in _before(x, 1)], bool)),
        Rule("ssn", 95, V.SSNS, keep=_each(C.ssn)),
        Rule("passport", 85, V.PASSPORTS, group=True, keep=lambda x: _between(length(x.text), 6, 12)),
        Rule("dob", 85, filled(V.BIRTH_DATES, V.DATE_PARTS), once=True),
        Rule("mac_address", 95, V.MACS, dotted=True),
        Rule("api_key", 95, V.API_KEYS),
        Rule("license_plate", 85, V.PLATES, group=True, once=True, keep=_letter_and_digit),
        Rule("medical_record", 90, V.MEDICAL),
        Rule("drivers_license", 85, V.DRIVING, group=True),
        Rule("gps", 90, V.GPS, dotted=True),
        Rule("vin", 85, V.VINS, keep=_letter_and_digit),
        Rule("company_code", 90, V.COMPANY_CODES),
        Rule("address", 90, V.ADDRESSES, group=True, change=_address, keep=lambda x: (length(x.text) >= 10) & (_has(x.text, "[0-9]") | (_parts(x.text) >= 3))),
    ]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Places of the first element of each value of the keys, in order."""
    order = np.lexsort(keys)  # stable
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    return np.sort(order[np.concatenate([np.ones(min(1, len(order)), bool), ~same])])


def _spans_of(rule: Rule, hits: batch.Hits, of: list[str | None]) -> tuple[Spans, np.ndarray]:
    """A rule's spans that stay, and their confidence."""
    row, start, _, text, part = hits
    if rule.group or rule.once:
        at = start + np.array([t.find(p) if p else 0 for t, p in zip(text.to_pylist(), part.to_pylist())])
        own = pc.if_else(pc.equal(part, ""), text, part)
        if rule.once:
            first = firsts(length(own), at, row)
            row, start, at, text, own = row[first], start[first], at[first], text.take(pa.array(first)), own.take(pa.array(first))
        if rule.group:
            text, start = own, at
    x = Spans(row, text, start, of)
    if rule.change:
        x = rule.change(x)
    x = x.where(length(x.text) > 0)
    if rule.keep and len(x.row):
        x = x.where(rule.keep(x))
    return x, rule.confidence(x) if callable(rule.confidence) else np.full(len(x.row), rule.confidence)


People = Callable[[str], list[tuple[str, int, int, int]]]
_ENTITY = pa.struct([("text", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.int32()), ("emission", pa.int32())])


def _entities(texts: pa.Array, people: People | None, rules: list[Rule], patterns: list[batch.Pattern], alone: bool) -> pa.Array:
    of, hits = texts.to_pylist(), {}
    for rule, h in batch.matches(texts, patterns):
        hits.setdefault(rule, []).append(h)
    made = [(r, *_spans_of(rules[r], batch.joined(h), of)) for r, h in sorted(hits.items())]
    kinds = [r.type for r in rules]
    if people is not None:
        sure = lambda m: kinds[m[0]] == "person" and rules[m[0]].confidence == 100
        own = [(i, *x) for i, t in enumerate(of) if t for x in people(t)]
        row, start, confidence = (np.array([x[k] for x in own], int) for k in (0, 2, 4))
        own = (len(rules), Spans(row, pa.array([x[1] for x in own], pa.string()), start, of), confidence)
        made, kinds = [*filter(sure, made), own, *(m for m in made if not sure(m))], [*kinds, "person"]
    if not made:
        return batch.listed(len(texts), np.zeros(0, int), pa.array([], _ENTITY))
    rule = np.repeat([m[0] for m in made], [len(m[1].row) for m in made])
    row, start, sure = (np.concatenate(c) for c in zip(*((m[1].row, m[1].start, m[2]) for m in made)))
    text = pa.concat_arrays([m[1].text for m in made])
    end = start + length(text)
    types = pa.array(kinds).dictionary_encode()
    names = types.indices.to_numpy()[rule]
    seq = firsts(end, start, row, *[names] * alone)
    seq = seq[np.argsort(row[seq], kind="stable")]
    emission = np.arange(len(seq)) - np.searchsorted(row[seq], row[seq])
    order = np.lexsort((emission, start[seq], row[seq]))
    at = seq[order]
    values = batch.struct(_ENTITY, text.take(pa.array(at)), types.dictionary.take(pa.array(names[at])), start[at], end[at], sure[at], emission[order])
    return batch.listed(len(texts), row[at], values)


def entities(text: Column, rules: list[Rule], people: People | None = None, alone: bool = False) -> Column:
    """Array of ENTITY: of equal spans the first in order of the rules stays;
    by start, then by emission.  ``people`` gives spans (text, start, end, confidence) of persons that come after the rules
    of type person with a confidence of 100.  ``alone``: each type stands on its own, so equal spans of different types stay."""
    patterns = patterns_of(Patterns(r.patterns, r.group or r.once, r.dotted) for r in rules)

    def run(texts: pa.Array) -> pa.Array:
        return batch.sliced(lambda x: _entities(x, people, rules, patterns, alone), texts)

    return F.arrow_udf(run, f"array<{ENTITY}>")(F.make_valid_utf8(text))
