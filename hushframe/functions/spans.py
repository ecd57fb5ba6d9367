"""Spans of all matches of a pattern, as Spark expressions: texts and positions, which are running sums of lengths.

Positions are 0-based code points; the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.arrays import let, running
from hushframe.functions.dialect import requirements, to_java

SPAN = "array<struct<text:string,start:int,end:int>>"


def possible(text: Column, pattern: str, flags: str = "") -> Column:
    """False for texts that lack a character which every match has: cheaper than matching, and mostly the answer."""
    out = F.lit(True)
    for need in sorted(requirements(pattern, flags), key=sorted):
        if need == frozenset("0123456789"):
            out = out & text.rlike("[0-9]")
        elif len(need) == 1 and not (c := min(need)).isalpha() and c != " ":
            out = out & F.contains(text, F.lit(c))
    return out


#: Marks that are put around matches: code points that Unicode never gives to a character.
_BEGIN, _END, _PART = "\ufdd0", "\ufdd1", "\ufdd2"
PLACE = "struct<text:string,start:int,end:int,part:string>"


def marked(text: Column, java: Column, group: bool | Column = False) -> Column:
    """``text`` with marks around all matches of a Java pattern, made in one pass.

    Spark keeps the compiled pattern only while it stays the same from row to row, so a pattern that is known beforehand
    should be a literal of its own: compiling takes far longer than searching a text.
    """
    plain, with_part = F.lit(_BEGIN + "$1" + _END), F.lit(_BEGIN + "$1" + _PART + "$2" + _END)
    to = (with_part if group else plain) if isinstance(group, bool) else F.when(group, with_part).otherwise(plain)
    return F.regexp_replace(text, F.concat(F.lit("("), java, F.lit("())")), to)


def has_match(m: Column) -> Column:
    """Whether a text from :func:`marked` has a match."""
    return F.contains(m, F.lit(_BEGIN))


def has_marks(text: Column) -> Column:
    """Whether a text has marks of its own, so that :func:`marked` can't be used."""
    return text.rlike(f"[{_BEGIN}{_END}{_PART}]")


def unmarked(m: Column) -> Column:
    """Array of (text, start, end, part) of the matches in a text from :func:`marked`."""

    def made(pieces: Column) -> Column:
        hits = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.substring_index(p, _END, 1))
        has = lambda h: F.contains(h, F.lit(_PART))
        part = lambda h: F.when(has(h), F.substring_index(h, _PART, -1)).otherwise("")
        steps = F.transform(pieces, lambda p, i: F.length(p) - F.when(i == 0, 0).otherwise(1 + let(F.substring_index(p, _END, 1), lambda h: F.when(has(h), 1 + F.length(part(h))).otherwise(0))))

        def placed(starts: Column) -> Column:
            whole = lambda h: F.substring_index(h, _PART, 1)
            return F.transform(hits, lambda h, i: F.struct(whole(h).alias("text"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(whole(h))).alias("end"), part(h).alias("part")))

        return let(running(steps), placed)

    return F.when(has_match(m), let(F.split(m, _BEGIN), made)).otherwise(F.array().cast(f"array<{PLACE}>"))


def places(text: Column, java: Column, group: Column | None = None) -> Column:
    """Array of (text, start, end, part) of a Java pattern, which may be a column; ``part`` is the pattern's first group,
    if it has one and ``group`` is true, else empty.

    One pass puts marks around all matches, and the text is split at the marks.  A text that has such marks itself goes
    the longer way.
    """
    short = let(marked(text, java, False if group is None else group), unmarked)
    return F.when(has_marks(text), _long_way(text, java, group)).otherwise(short)


def _long_way(text: Column, java: Column, group: Column | None) -> Column:
    """Anchored by ``\\G``, a pattern that takes the gap before each match as well gives texts and lengths of both.  The anchor
    keeps the unmatched rest from being tried again from each position."""
    both = F.concat(F.lit(r"\G((?s:.*?))("), java, F.lit("())"))
    all_of = lambda i: F.regexp_extract_all(text, both, F.lit(i))

    def made(hits: Column, ends: Column, parts: Column) -> Column:
        return F.transform(hits, lambda h, i: F.struct(h.alias("text"), (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), F.coalesce(F.get(parts, i), F.lit("")).alias("part")))

    parts = F.array().cast("array<string>") if group is None else F.when(group, all_of(3)).otherwise(F.array().cast("array<string>"))
    return let(all_of(2), lambda hits: let(running(F.transform(all_of(0), F.length)), lambda ends: let(parts, lambda p: made(hits, ends, p))))


def spans(text: Column, pattern: str, flags: str = "") -> Column:
    """Array of (text, start, end); empty for null or without a match.  Groups of the pattern must not be referred to."""
    java = to_java(pattern, flags)
    found = F.transform(places(text, F.lit(java)), lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")))
    # The plain test runs first: most texts have no match, and it is the cheaper one.
    return F.when(possible(text, pattern, flags) & text.rlike(java), found).otherwise(F.array().cast(SPAN))


def count_matches(text: Column, pattern: str, flags: str = "") -> Column:
    return F.when(possible(text, pattern, flags), F.regexp_count(text, F.lit(to_java(pattern, flags)))).otherwise(0)
