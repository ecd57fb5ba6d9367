"""One pattern dialect for two matchers: Java's, inside Spark expressions, and Python's ``re``, in the vectorised function.

``\\b``, ``\\d`` and ``\\w`` are ASCII, ``\\s`` has the Unicode spaces, ``.`` stops at line ends, ``\\z`` is the end of the text.
"""

from __future__ import annotations

import functools
import re
import re._constants as K
import re._parser as P
from typing import NamedTuple

#: What ``\s`` stands for, inside a class.
SPACES = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_JAVA_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_TOKEN = re.compile(r"\\.|\[\^?\]?|\]|\.|.", re.S)


_WORD_ATOM = re.compile(r"(?:[A-Za-z0-9_]|\\[dw]|\[(?:[A-Za-z0-9_]-[A-Za-z0-9_]|[A-Za-z0-9_]|\\[dw])+\])(?![?*]|\{0)")


def rewritten(pattern: str, edge: str, end: str, before_word: str | None = None) -> str:
    """``before_word`` is the edge where a word character follows in any case."""
    out, inside, at = [], False, 0
    for t in _TOKEN.findall(pattern):
        at += len(t)
        if inside:
            if t == "\\s":
                t = SPACES
            elif t == "\\S":
                raise ValueError("\\S within a class")
            elif t == "[":
                t = "\\["
            elif t == "]":
                inside = False
        elif t.startswith("["):
            inside = True
        elif t == "\\s":
            t = f"[{SPACES}]"
        elif t == "\\S":
            t = f"[^{SPACES}]"
        elif t == "\\b":
            t = before_word if before_word and _WORD_ATOM.match(pattern, at) else edge
        elif t == "\\z":
            t = end
        elif t == ".":
            t = r"[^\n\r\u2028\u2029]"
        out.append(t)
    return "".join(out)


def to_java(pattern: str, flags: str = "") -> str:
    """For ``rlike`` and the ``regexp_`` functions; Java's own ``\\b`` isn't ASCII."""
    made = rewritten(pattern.replace(r"[\S\s]*", r"(?:[^\n]|\n)*"), _JAVA_EDGE, r"\z", r"(?<!\w)")
    return ("(?i)" if "i" in flags else "") + made


def to_python(pattern: str, flags: str = "") -> re.Pattern[str]:
    made = rewritten(pattern.replace(r"[\S\s]*", r"(?:[^\n]|\n)*"), r"\b", r"\Z")
    return re.compile(made, re.ASCII | (re.IGNORECASE if "i" in flags else 0))


_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
#: First characters of a pattern aren't told if they are more.
_MOST_FIRST = 150


@functools.lru_cache(4096)
def first_characters(pattern: str, flags: str = "") -> frozenset[str] | None:
    """Characters with one of which every match begins; None if they aren't known or a match can be empty."""
    compiled = to_python(pattern, flags)
    fold = bool(compiled.flags & re.IGNORECASE)

    def own(op: object, arg: object) -> frozenset[str] | None:
        if op is K.LITERAL:
            return frozenset(chr(arg))
        if op is not K.IN:
            return None
        out: set[str] = set()
        for kind, x in arg:
            if kind is K.LITERAL:
                out.add(chr(x))
            elif kind is K.RANGE and x[1] - x[0] < _MOST_FIRST:
                out |= set(map(chr, range(x[0], x[1] + 1)))
            elif kind is K.CATEGORY and x in (K.CATEGORY_DIGIT, K.CATEGORY_WORD):
                out |= set("0123456789") if x is K.CATEGORY_DIGIT else _WORD
            else:
                return None
        return frozenset(out)

    def of(seq: object) -> tuple[frozenset[str] | None, bool]:
        """The characters, and whether the sequence can be empty."""
        out: frozenset[str] = frozenset()
        for op, arg in seq:
            if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
                continue
            empty = False
            if op is K.SUBPATTERN:
                found, empty = of(arg[-1])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                found, empty = of(arg[2])
                empty = empty or arg[0] == 0
            elif op is K.BRANCH:
                each = [of(b) for b in arg[1]]
                found, empty = None if any(f is None for f, _ in each) else frozenset().union(*(f for f, _ in each)), any(e for _, e in each)
            else:
                found = own(op, arg)
            if found is None:
                return None, True
            out |= found
            if not empty:
                return out, False
        return out, True

    found, empty = of(P.parse(compiled.pattern, compiled.flags & ~re.DEBUG))
    if found is None or empty or len(found) > _MOST_FIRST:
        return None
    return frozenset(x for c in found for x in ({c.lower(), c.upper()} if fold and c.isascii() else {c}))


@functools.lru_cache(4096)
def to_search(pattern: str, flags: str = "") -> str:
    """:func:`to_java` for finding all matches in long texts: a place where no match can begin is left after a look at one
    character, and an edge before a word is tested on one side."""
    first = first_characters(pattern, flags)
    if first is None:
        return to_java(pattern, flags)
    if pattern.startswith(r"\b") and "|" not in re.sub(r"\\.|\[[^]]*\]|\([^()]*\)", "", pattern):
        own = to_java(pattern[2:])
        edge = r"(?<!\w)" if first <= _WORD else r"(?<=\w)" if not first & _WORD else _JAVA_EDGE
        own = edge + own
    else:
        own = to_java(pattern)
    return "(?=[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(first)) + "])" + ("(?i:" if "i" in flags else "(?:") + own + ")"


@functools.lru_cache(4096)
def requirements(pattern: str, flags: str = "") -> frozenset[frozenset[str]]:
    """Sets of characters, of each of which every match has at least one.

    A text without a digit can't have what needs one; looking at the text's set of characters first saves most of the
    matching there is.  Only sets of up to twelve characters are told.
    """
    compiled = to_python(pattern, flags)
    fold = bool(compiled.flags & re.IGNORECASE)

    def one(op: object, arg: object) -> frozenset[str] | None:
        if op is K.LITERAL:
            c = chr(arg)
            return frozenset({c.lower(), c.upper()} if fold and c.isascii() else {c})
        if op is K.IN:
            out: set[str] = set()
            for kind, x in arg:
                if kind is K.LITERAL:
                    out |= one(kind, x)
                elif kind is K.RANGE and x[1] - x[0] < 12:
                    out |= set(map(chr, range(x[0], x[1] + 1)))
                elif kind is K.CATEGORY and x is K.CATEGORY_DIGIT:
                    out |= set("0123456789")
                else:
                    return None
            return frozenset(out) if 0 < len(out) <= 12 else None
        return None

    def of(seq: object) -> frozenset[frozenset[str]]:
        out: set[frozenset[str]] = set()
        for op, arg in seq:
            if op is K.SUBPATTERN:
                out |= of(arg[-1])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                if arg[0] > 0:
                    out |= of(arg[2])
            elif op is K.BRANCH:
                each = [of(b) for b in arg[1]]
                out |= frozenset.intersection(*each)
            elif r := one(op, arg):
                out.add(r)
        return frozenset(out)

    return of(P.parse(compiled.pattern, compiled.flags & ~re.DEBUG))


#: Literals that stand for a branch of more than so many aren't told.
_MOST_LITERALS = 300


class Needs(NamedTuple):
    """What every match has: one of ``literals`` (in lower case; none if nothing is known), a run of so many ``digits``,
    and one of so many of the characters that keys and words are made of (``run``)."""

    literals: tuple[str, ...]
    digits: int
    run: int


_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-")
#: The class of :class:`Needs`' runs.
RUN_CLASS = "[A-Za-z0-9_+/=-]"


@functools.lru_cache(4096)
def needs(pattern: str, flags: str = "") -> Needs:
    """What a text must have for a pattern to match, to be looked at before matching: a few plain searches tell which of
    many patterns a text can have."""
    compiled = to_python(pattern, flags)

    def chars(op: object, arg: object) -> frozenset[str] | None:
        """The characters that one atom can be, if they are few."""
        if op is K.LITERAL:
            return frozenset(chr(arg))
        if op is K.IN:
            out: set[str] = set()
            for kind, x in arg:
                if kind is K.LITERAL:
                    out.add(chr(x))
                elif kind is K.RANGE and x[1] - x[0] < 64:
                    out |= set(map(chr, range(x[0], x[1] + 1)))
                elif kind is K.CATEGORY and x is K.CATEGORY_DIGIT:
                    out |= set("0123456789")
                else:
                    return None
            return frozenset(out)
        return None

    def longest(seq: object, of: frozenset[str]) -> int:
        """The longest run of characters of a set that every match has."""
        best = now = 0
        for op, arg in seq:
            if op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):
                continue
            repeat = op in (K.MAX_REPEAT, K.MIN_REPEAT)
            atom = arg[2][0] if repeat and len(arg[2]) == 1 else (op, arg)
            own = chars(*atom)
            if own and own <= of:
                now += arg[0] if repeat else 1
                best = max(best, now)
                continue
            now = 0
            inner = [arg[-1]] if op is K.SUBPATTERN else [arg[2]] if repeat and arg[0] > 0 else arg[1] if op is K.BRANCH else []
            if inner:
                best = max(best, min(longest(x, of) for x in inner))
        return best

    def literals(seq: object) -> frozenset[str]:
        """The rarest of what every match has one of; empty if nothing is known."""
        found, now = [], ""
        for op, arg in [*seq, (None, None)]:
            if op is K.LITERAL:
                now += chr(arg).lower()
                continue
            if op is K.AT:
                continue
            if now:
                found.append(frozenset([now]))
                now = ""
            if op is K.SUBPATTERN:
                found.append(literals(arg[-1]))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                found.append(literals(arg[2]))
            elif op is K.BRANCH:
                each = [literals(b) for b in arg[1]]
                if all(each):
                    found.append(frozenset().union(*each))
            elif op is K.IN and len(own := chars(op, arg) or ()) in range(1, 13) and not any(c.isalnum() for c in own):
                found.append(own)
        worth = lambda x: (min(len(w) + (not w.isalnum()) for w in x), -len(x))
        return max((x for x in found if x and len(x) <= _MOST_LITERALS), key=worth, default=frozenset())

    tree = list(P.parse(compiled.pattern, compiled.flags & ~re.DEBUG))
    return Needs(tuple(sorted(literals(tree))), longest(tree, frozenset("0123456789")), longest(tree, _RUN))
