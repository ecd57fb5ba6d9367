"""A plain matcher, to hold the expressions against: both engines over one text, by Python's ``re``.

Engine A has types with several patterns each, in an order that decides which of two equal spans stays.  Engine B has a
table of rules with category, confidence and placeholder template, and terms from a configuration.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from hushframe.functions import checks as C
from hushframe.functions import fixed_values as V
from hushframe.functions.dialect import SPACES, requirements, to_python
from hushframe.plans.config import Config

Found = tuple[str, int, int]  # value, start, confidence
_SPACE = re.compile(f"[{SPACES}]+")


class Rule(NamedTuple):
    """``group``: the first group is the span, if it has matched.  ``once``: a place of the group counts once in a rule.
    ``words``: lower-case words of which a match has one, as a whole word; none if any text can match."""

    type: str
    confidence: int
    patterns: list[tuple[str, str]]
    group: bool = False
    once: bool = False
    words: frozenset[str] = frozenset()
    accept: Callable[[str, str, int], Found | None] | None = None


def _if(check: Callable[[str], bool]) -> Callable[[str, str, int], Found | None]:
    return lambda text, value, start: (value, start, 0) if check(value) else None


def _iban(text: str, value: str, start: int) -> Found | None:
    return (value, start, 90) if C.gulf(value) else (value, start, 0) if C.mod97(value) else None


def _ip(text: str, value: str, start: int) -> Found | None:
    if "." not in value and (at := value.find("::1")) >= 0:
        return "::1", start + at, 0
    return None if ":" not in value and C.version_like(value) else (value, start, 0)


def _url(text: str, value: str, start: int) -> Found | None:
    return value.rstrip(".,;:!?)"), start, 0


def _domain(text: str, value: str, start: int) -> Found | None:
    before = text[max(0, start - 65) : start]
    inside_mail = before.endswith("@") or before.rfind("@") > before.rfind(" ")
    return None if inside_mail or "://" in before[-10:] else (value, start, 0)


def _saudi_id(text: str, value: str, start: int) -> Found | None:
    return None if text[start - 1 : start] == "+" else (value, start, 0)


_TAIL = to_python(V.ADDRESS_TAIL, "i")


def _strip(s: str) -> tuple[str, int]:
    left = _SPACE.match(s)
    cut = left.end() if left else 0
    return re.sub(f"[{SPACES}]+\\Z", "", s[cut:]), cut


def _address(text: str, value: str, start: int) -> Found | None:
    own, cut = _strip(value)
    own, more = _strip(_TAIL.sub("", own.rstrip(",;."), count=1))
    if len(own) < 10 or not re.search("[0-9]", own) and len(_SPACE.split(own)) < 3:
        return None
    return own, start + cut + more, 0


def _arabic(text: str, value: str, start: int) -> Found | None:
    own, cut = _strip(value)
    return (own, start, 0) if len(own) >= 5 and len(_SPACE.split(own)) > 1 else None


def _filled(patterns: Iterable[tuple[str, str]], parts: dict[str, str]) -> list[tuple[str, str]]:
    out = []
    for p, flags in patterns:
        for name, value in parts.items():
            p = p.replace("{" + name + "}", value)
        out.append((p, flags))
    return out


def _phone(value: str) -> bool:
    return 7 <= len(C.digits(value)) <= 15


def built_in() -> list[Rule]:
    """Engine A in the order of emission, without terms of a user and without names by heuristics."""
    names = {"FIRST": "|".join([*V.ARABIC_FIRST, *V.ARABIC_FIRST_FEMALE]), "FAMILY": "|".join(V.ARABIC_FAMILY)}
    return [
        Rule("person", 85, _filled(V.ARABIC_NAMES, names), words=frozenset([*V.ARABIC_FIRST, *V.ARABIC_FIRST_FEMALE]), accept=_arabic),
        Rule("financial", 95, _filled(V.FINANCIAL, V.AMOUNT_PARTS)),
        Rule("credit_card", 95, V.CARDS, accept=_if(C.card)),
        Rule("iban", 95, V.IBANS, accept=_iban),
        Rule("ip", 95, _filled(V.IPS, V.IP_PARTS), accept=_ip),
        Rule("phone", 85, V.PHONES, accept=_if(_phone)),
        Rule("email", 95, V.EMAILS, accept=_if(C.email_parts)),
        Rule("url", 95, V.URLS, accept=_url),
        Rule("domain", 90, _filled(V.DOMAINS, {"TLDS": "|".join(V.TLDS)}), accept=_domain),
        Rule("saudi_id", 90, V.SAUDI_IDS, accept=_saudi_id),
        Rule("ssn", 95, V.SSNS, accept=_if(C.ssn)),
        Rule("passport", 85, V.PASSPORTS, group=True, accept=_if(lambda v: 6 <= len(v) <= 12)),
        Rule("dob", 85, _filled(V.BIRTH_DATES, V.DATE_PARTS), once=True),
        Rule("mac_address", 95, V.MACS),
        Rule("api_key", 95, V.API_KEYS),
        Rule("license_plate", 85, V.PLATES, group=True, once=True, accept=_if(C.has_letter_and_digit)),
        Rule("medical_record", 90, V.MEDICAL),
        Rule("drivers_license", 85, V.DRIVING, group=True),
        Rule("gps", 90, V.GPS),
        Rule("vin", 85, V.VINS, accept=_if(C.has_letter_and_digit)),
        Rule("company_code", 90, V.COMPANY_CODES),
        Rule("address", 90, V.ADDRESSES, group=True, accept=_address),
    ]


@functools.lru_cache(4096)
def _compiled(pattern: str, flags: str) -> re.Pattern[str]:
    return to_python(pattern, flags)


class _Text:
    """What a text has, looked at once for all rules."""

    def __init__(self, text: str) -> None:
        self.text, self.chars, self._words = text, frozenset(text), None

    def may_have(self, rule: Rule) -> bool:
        if rule.words and self._words is None:
            self._words = frozenset(re.findall(r"\w+", self.text.lower(), re.ASCII))
        return not rule.words or not rule.words.isdisjoint(self._words)


def matches(rule: Rule, text: str, has: _Text | None = None) -> Iterator[Found]:
    """Spans of one rule, in order of its patterns, then of places."""
    has = has or _Text(text)
    if not has.may_have(rule):
        return
    seen: set[tuple[int, int]] = set()
    for pattern, flags in rule.patterns:
        if any(need.isdisjoint(has.chars) for need in requirements(pattern, flags)):
            continue
        for m in _compiled(pattern, flags).finditer(text):
            whole, at = m[0], m.start()
            part = m[1] if m.re.groups and m[1] else whole
            place = at + whole.index(part)
            if rule.once:
                if (place, place + len(part)) in seen:
                    continue
                seen.add((place, place + len(part)))
            value, start = (part, place) if rule.group else (whole, at)
            got = rule.accept(text, value, start) if rule.accept else (value, start, 0)
            if got:
                yield got[0], got[1], got[2] or rule.confidence


def terms(words: Iterable[str]) -> list[tuple[str, str]]:
    """Patterns of a user's words: lower-cased, trimmed, each once."""
    return [(rf"\b{re.escape(w)}\b", "i") for w in dict.fromkeys(w.strip().lower() for w in words) if w]


class Entity(NamedTuple):
    text: str
    type: str
    start: int
    end: int
    confidence: int
    emission: int


def detect(text: str, rules: Iterable[Rule]) -> list[Entity]:
    """All rules over one text; of equal spans the first stays; by start, then by emission."""
    out: dict[tuple[int, int], Entity] = {}
    has = _Text(text)
    for rule in rules:
        for value, start, confidence in matches(rule, text, has):
            if value and (key := (start, start + len(value))) not in out:
                out[key] = Entity(value, rule.type, *key, confidence, len(out))
    return sorted(out.values(), key=lambda e: (e.start, e.emission))


def people(text: str, first_names: frozenset[str]) -> Iterator[Found]:
    """Names by a heuristic: a known first name and one or two capitalised words after it.  No language model is used,
    so this finds other names than one would."""
    refused = frozenset(V.NOT_A_NAME)
    found: dict[str, None] = {}
    for m in re.finditer(r"(?<!\w)([A-Z][a-z]+)((?: [A-Z][a-z]+){1,2})(?!\w|'s)", text, re.ASCII):
        parts = m[0].split()
        if parts[0].lower() in first_names and not any(p.lower() in refused for p in parts):
            found[m[0]] = None
    for name in found:
        for m in re.finditer(rf"\b{re.escape(name)}\b", text, re.ASCII | re.IGNORECASE):
            yield m[0], m.start(), 85


def with_people(text: str, rules: list[Rule], known: frozenset[str]) -> list[Entity]:
    """Engine A with names by a dictionary, after the user's own (the first rule)."""
    out: dict[tuple[int, int], Entity] = {}
    for found, kind in [(matches(rules[0], text), rules[0].type), (people(text, known), "person"), *((matches(r, text), r.type) for r in rules[1:])]:
        for value, start, confidence in found:
            if value and (key := (start, start + len(value))) not in out:
                out[key] = Entity(value, kind, *key, confidence, len(out))
    return sorted(out.values(), key=lambda e: (e.start, e.emission))


# Engine B


def _context(text: str, start: int, end: int, around: int = 50) -> str:
    a, z = max(0, start - around), min(len(text), end + around)
    return ("..." if a else "") + text[a:z] + ("..." if z < len(text) else "")


class _Steps:
    """The parts of engine B that a configuration turns on, in their order."""

    def __init__(self, config: Config) -> None:
        s, self.config = config.detection, config
        on = set(s.categories)
        self.steps = []
        for _, category, sub, confidence, template, check, flags, pattern in V.RULES:
            if category in on and confidence >= s.min_confidence:
                self.steps.append((category, sub, confidence, template, C.BY_NAME.get(check), s.auto_mask and confidence >= 90, [(pattern, flags, None)]))
        word = lambda w: rf"\b{re.escape(w)}\b"
        auto = s.auto_mask
        if config.company.name and "company" in on:
            self.steps.append(("company", "company_name", 100, "<COMPANY_NAME>", None, auto, [(word(w), "i", None) for w in [config.company.name, *config.company.aliases] if w]))
        if "technical" in on:
            self.steps.append(("technical", "internal_url", 95, "<INTERNAL_URL_{n}>", None, auto, [(rf"https?://[^\s]*{(d := re.escape(x))}[^\s]*|\b[a-zA-Z0-9.-]*\.{d}\b", "i", None) for x in config.company.domains if x]))
        if "custom" in on:
            self.steps.append(("custom", "keyword", 100, "<KEYWORD_{n}>", None, auto, [(word(w), "i", None) for w in config.custom.keywords if w]))
            for sub, template, group in (("client", "<CLIENT_{n}>", config.custom.clients), ("project", "<PROJECT_{n}>", config.custom.projects)):
                self.steps.append(("custom", sub, 100, template, None, auto, [(word(w), "i", e.name) for e in group for w in [e.name, *e.aliases] if w]))

    def run(self, text: str | None, persons: Iterable[tuple[str, int]] = ()) -> list[dict]:
        if not text or len(text) < 3:
            return []
        seen: set[tuple[int, int]] = set()
        chars = frozenset(text)
        numbers: dict[str, dict[str, int]] = {}
        out: list[dict] = []

        def add(category, sub, confidence, template, approved, value, start, name) -> None:
            own = numbers.setdefault(template.replace("_{n}", ""), {})
            n = own.setdefault((name or value).lower().strip(), len(own) + 1)
            out.append({"text": value, "category": category, "subcategory": sub, "confidence": confidence, "start": start, "end": start + len(value), "placeholder": template.replace("{n}", str(n)), "context": _context(text, start, start + len(value)), "approved": approved, "emission": len(out)})

        def step(category, sub, confidence, template, check, approved, patterns) -> None:
            for pattern, flags, name in patterns:
                if any(need.isdisjoint(chars) for need in requirements(pattern, flags)):
                    continue
                for m in _compiled(pattern, flags).finditer(text):
                    if m.span() in seen or not m[0] or check and not check(m[0]):
                        continue
                    seen.add(m.span())
                    add(category, sub, confidence, template, approved, m[0], m.start(), name)

        built_in = [s for s in self.steps if s[1] not in ("company_name", "internal_url", "keyword", "client", "project")]
        for s in built_in:
            step(*s)
        if "pii" in self.config.detection.categories:
            for value, start in persons:
                if (start, start + len(value)) not in seen:
                    seen.add((start, start + len(value)))
                    add("pii", "person_name", 75, "<PERSON_{n}>", False, value, start, None)
        for s in self.steps[len(built_in) :]:
            step(*s)
        return sorted(out, key=lambda d: (d["start"], d["emission"]))
