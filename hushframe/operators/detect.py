"""Detection over a table of documents: both engines as expressions of one row, over batches of texts in Arrow.

Each document is read once, in one stage and without a shuffle, so detection scales with the input's partitions and runs
the same on a stream.  A user's terms are patterns among the others here, which suits the hundreds that a configuration
holds; :mod:`hushframe.operators.terms` finds any number of them by an index.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import batch
from hushframe.functions import checks as C
from hushframe.functions import fixed_values as V
from hushframe.functions import native as N
from hushframe.plans.config import Config

ENTITY = N.ENTITY
DETECTION = "struct<text:string,category:string,subcategory:string,confidence:int,start:int,end:int,placeholder:string,context:string,approved:boolean,emission:int>"
#: Spans of a document that the application keeps, to be given as ``kept``; the default None keeps all.
KEPT = 1000
AROUND = 50

_EXTRA: list[N.Rule] = []


def register_rule(rule: N.Rule) -> None:
    """A rule of the user's own, after the built-in ones; spans that a built-in rule has found stay as they are."""
    _EXTRA.append(rule)


def term_patterns(words: Iterable[str]) -> list[tuple[str, str]]:
    """Patterns of a user's words: lower-cased, trimmed, each once."""
    return [(rf"\b{re.escape(w)}\b", "i") for w in dict.fromkeys(w.strip().lower() for w in words) if w]


#: Two or three capitalised words in a row, without a possessive.
CAPITALISED = r"(?<!\w)[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}(?!\w|'s)"


def people(first_names: Iterable[str]) -> Callable[[str], list[tuple[str, int, int, int]]]:
    """Persons (text, start, end, confidence) of a text by a dictionary: a known first name with one or two capitalised words
    after it, none of which is a word that names don't have; then every place of each such name, in any case.  No language model is used,
    so this finds other names than one would."""
    first, others = frozenset(n.lower() for n in first_names), frozenset(V.NOT_A_NAME)

    def known(name: str) -> bool:
        words = name.lower().split(" ")
        return words[0] in first and others.isdisjoint(words)

    def found(text: str) -> list[tuple[str, int, int, int]]:
        names = [n for n in dict.fromkeys(re.findall(CAPITALISED, text, re.ASCII)) if known(n)]
        return [(m[0], *m.span(), 85) for n in names for m in re.finditer(rf"(?<!\w){n}(?!\w)", text, re.ASCII | re.IGNORECASE)]

    return found


def no_role(name: Column) -> Column:
    return ~F.arrays_overlap(F.split(F.lower(name), " "), F.array(*map(F.lit, V.NOT_A_NAME)))


def detect(df: DataFrame, text: str = "text", names: Iterable[str] = (), first_names: Iterable[str] = (), kept: int | None = None) -> DataFrame:
    """``df`` with ``entities`` of engine A: user's names first, names by a dictionary, then all built-in types.

    Null or empty text has none.  ``kept`` cuts after sorting by place.
    """
    known = list(first_names)
    own = N.Rule("person", 100, term_patterns(names))
    found = N.entities(F.col(text), [own, *N.built_in(), *_EXTRA], people(known) if known else None)
    return df.withColumn("entities", found if kept is None else F.slice(found, 1, kept))


def person_names(df: DataFrame, names: Iterable[str], text: str = "text") -> DataFrame:
    """``df`` with ``persons``: every place of the user's names, without removing equal spans."""
    found = N.scan(F.col(text), [N.Patterns(term_patterns(names))])
    one = lambda x, i: F.struct(x["text"].alias("text"), F.lit("person").alias("type"), x["start"].alias("start"), x["end"].alias("end"), F.lit(100).alias("confidence"), i.alias("emission"))
    return df.withColumn("persons", F.coalesce(F.transform(found, one), F.array().cast(f"array<{ENTITY}>")))


#: The types of engine A, in their order.
NATIVE = [
    "person", "financial", "credit_card", "iban", "ip", "phone", "email", "url", "domain", "saudi_id", "ssn", "passport", "dob", "mac_address", "api_key",
    "license_plate", "medical_record", "drivers_license", "gps", "vin", "company_code", "address",
]


def native_spans(text: Column, *kinds: str) -> Column:
    """Spans (start, end, text, type, confidence) of types as an expression: each type on its own, each span once, by place."""
    found = N.entities(text, [r for r in N.built_in() if r.type in kinds], alone=True)
    return F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "end", "text", "type", "confidence"))))


def detect_native(df: DataFrame, kinds: Iterable[str], text: str = "text") -> DataFrame:
    """``df`` with one row for each span of the given types, each type on its own: start, end, span_text, type, confidence."""
    found = df.withColumn("__s", native_spans(F.col(text), *kinds))
    return exploded(found, "__s").select(*df.columns, F.col("__s.start").alias("start"), F.col("__s.end").alias("end"), F.col("__s.text").alias("span_text"), F.col("__s.type").alias("type"), F.col("__s.confidence").alias("confidence"))


def exploded(df: DataFrame, array: str) -> DataFrame:
    """A row for each element of an array column, in its place.

    The outer form is taken and its null rows left out: for the inner one the optimizer asks in advance whether the array
    has elements, which would find everything twice.
    """
    return df.select(*(F.explode_outer(array).alias(c) if c == array else F.col(c) for c in df.columns)).where(F.col(array).isNotNull())


# Engine B


class Step(NamedTuple):
    """One pattern of engine B with all that its spans get; ``name`` is numbered in place of the value, if there is one."""

    category: str
    subcategory: str
    confidence: int
    template: str
    check: str
    approved: bool
    pattern: str
    flags: str
    name: str | None = None
    dotted: bool = False


def steps_of(config: Config, names: Iterable[str] = ()) -> list[Step]:
    """What a configuration turns on, in order: the rule table, persons, company names, domains, keywords, clients, projects."""
    s, on = config.detection, set(config.detection.categories)
    word = lambda w: rf"\b{re.escape(w)}\b"
    auto, out = s.auto_mask, []
    for rule, category, sub, confidence, template, check, flags, pattern in V.RULES:
        if category in on and confidence >= s.min_confidence:
            out.append(Step(category, sub, confidence, template, check, auto and confidence >= 90, pattern, flags, dotted=rule in ("tech-ipv4", "tech-domain")))
    if "pii" in on:
        out += [Step("pii", "person_name", 75, "<PERSON_{n}>", "", False, p, f) for p, f in term_patterns(names)]
    if config.company.name and "company" in on:
        out += [Step("company", "company_name", 100, "<COMPANY_NAME>", "", auto, word(w), "i") for w in [config.company.name, *config.company.aliases] if w]
    if "technical" in on:
        out += [Step("technical", "internal_url", 95, "<INTERNAL_URL_{n}>", "", auto, rf"https?://[^\s]*{(d := re.escape(x))}[^\s]*|\b[a-zA-Z0-9.-]*\.{d}\b", "i") for x in config.company.domains if x]
    if "custom" in on:
        out += [Step("custom", "keyword", 100, "<KEYWORD_{n}>", "", auto, word(w), "i") for w in config.custom.keywords if w]
        for sub, template, group in (("client", "<CLIENT_{n}>", config.custom.clients), ("project", "<PROJECT_{n}>", config.custom.projects)):
            out += [Step("custom", sub, 100, template, "", auto, word(w), "i", e.name) for e in group for w in [e.name, *e.aliases] if w]
    return out


_DETECTION = pa.struct([(name, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[kind]) for name, kind in (x.split(":") for x in DETECTION[7:-1].split(","))])


def _numbers(row: list[int], kind: list[str], value: list[str]) -> list[int]:
    """The rank of each value's first place among the values of its text and kind; texts' values are in order."""
    seen: dict[tuple[int, str], dict[str, int]] = {}
    out = []
    for i, k, v in zip(row, kind, value):
        known = seen.setdefault((i, k), {})
        out.append(known.setdefault(v, len(known) + 1))
    return out


def _context(text: str, start: int, end: int) -> str:
    a, z = max(0, start - AROUND), min(len(text), end + AROUND)
    return ("..." if a else "") + text[a:z] + ("..." if z < len(text) else "")


def _detections(texts: pa.Array, steps: list[Step], patterns: list[batch.Pattern]) -> pa.Array:
    own = batch.without(texts, pc.less(pc.utf8_length(texts), 3).fill_null(True).to_numpy(zero_copy_only=False))
    found = []
    for i, (row, start, end, text, _) in batch.matches(own, patterns):
        right = C.BY_NAME.get(steps[i].check, bool)
        stays = np.fromiter((bool(t) and right(t) for t in text.to_pylist()), bool, len(row))
        found.append((row[stays], start[stays], end[stays], text.filter(pa.array(stays)), np.full(stays.sum(), i)))
    if not sum(len(f[0]) for f in found):
        return batch.listed(len(texts), np.zeros(0, int), pa.array([], _DETECTION))
    row, start, end = (np.concatenate(c) for c in list(zip(*found))[:3])
    seq = N.firsts(end, start, row)
    seq = seq[np.argsort(row[seq], kind="stable")]
    row, start, end, rule = row[seq], start[seq], end[seq], np.concatenate([f[4] for f in found])[seq]
    emission = np.arange(len(row)) - np.searchsorted(row, row)
    words, of = pa.concat_arrays([f[3] for f in found]).take(pa.array(seq)).to_pylist(), texts.to_pylist()
    step = [steps[i] for i in rule.tolist()]
    value = [(w if s.name is None else s.name).lower().strip(N.BLANK) for w, s in zip(words, step)]
    number = _numbers(row.tolist(), [s.template.replace("_{n}", "") for s in step], value)
    placeholder = [s.template.replace("{n}", str(n)) for s, n in zip(step, number)]
    context = [_context(of[i], a, z) for i, a, z in zip(row.tolist(), start.tolist(), end.tolist())]
    of_step = lambda name: pa.array([getattr(s, name) for s in steps]).take(pa.array(rule))
    values = batch.struct(_DETECTION, pa.array(words), *map(of_step, ("category", "subcategory")), of_step("confidence").to_numpy(), start, end, pa.array(placeholder), pa.array(context), of_step("approved"), emission)
    order = np.lexsort((emission, start, row))
    return batch.listed(len(texts), row[order], values.take(pa.array(order)))


def rule_detections(text: Column, steps: list[Step]) -> Column:
    """Array of DETECTION."""
    patterns = N.patterns_of(N.Patterns([(s.pattern, s.flags)], dotted=s.dotted) for s in steps)

    def run(texts: pa.Array) -> pa.Array:
        return batch.sliced(lambda x: _detections(x, steps, patterns), texts)

    return F.arrow_udf(run, f"array<{DETECTION}>")(F.make_valid_utf8(text))


def detect_rules(df: DataFrame, config: Config, text: str = "text", names: Iterable[str] = ()) -> DataFrame:
    """``df`` with ``detections`` of engine B: the rules and terms that ``config`` turns on, with placeholders numbered by
    first place in order of emission, within the document."""
    steps = steps_of(config, names)
    return df.withColumn("detections", rule_detections(F.col(text), steps) if steps else F.array().cast(f"array<{DETECTION}>"))
