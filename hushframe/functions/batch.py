"""All matches of many patterns in a batch of texts, by Arrow's matcher (RE2), which takes no step back.

A pattern is searched in all texts at once; marks are put around its matches, and the texts are split at the marks, so places are
sums of the pieces' lengths, without a step of Python for a text or a match.  What this matcher can't say (looks around, non-ASCII
letters in any case, matches of nothing), and texts that have the mark or a letter that it takes for an ASCII one, go to Python's ``re``.
"""

from __future__ import annotations

import functools
import re
import re._parser as P
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hushframe.functions.dialect import needs, rewritten, to_python

#: Put around matches: a code point that Unicode never gives to a character.
_MARK = "\ufdd0"
#: The mark, and letters that are equal to s and k in any case.
_ODD = f"[{_MARK}\u017f\u212a]"
#: Bytes of texts that are searched at once; several copies are held.
AT_ONCE = 1 << 22
FOUND = pa.struct([("rule", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("part", pa.string())])


class Pattern(NamedTuple):
    """A pattern of a rule.  ``group``: its first group is told as well.  ``dotted``: a match has a full stop between
    two letters or digits."""

    rule: int
    pattern: str
    flags: str
    group: bool
    dotted: bool


def to_re2(pattern: str, flags: str = "") -> str:
    made = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", rewritten(pattern.replace(r"[\S\s]*", r"(?:[^\n]|\n)*"), r"\b", r"\z"))
    return ("(?i:" if "i" in flags else "(?:") + made + ")"


@functools.lru_cache(4096)
def searched(pattern: str, flags: str = "") -> str | None:
    """The pattern for Arrow's matcher; None if it can't be said there or might mean something else."""

    def plain(x: object) -> bool:
        if isinstance(x, (list, tuple, P.SubPattern)):
            return all(map(plain, x))
        return str(x) not in ("ASSERT", "ASSERT_NOT", "GROUPREF", "GROUPREF_EXISTS", "ATOMIC_GROUP", "POSSESSIVE_REPEAT")

    compiled = to_python(pattern, flags)
    tree = P.parse(compiled.pattern, compiled.flags & ~re.DEBUG)
    cased = compiled.flags & re.IGNORECASE and any(c.lower() != c.upper() for c in pattern if not c.isascii())
    if cased or tree.getwidth()[0] == 0 or not plain(list(tree)):
        return None
    own = to_re2(pattern, flags)
    try:
        pc.match_substring_regex(pa.array([""]), own)
    except pa.ArrowInvalid:
        return None
    return own


def without(texts: pa.Array, gone: np.ndarray) -> pa.Array:
    """Texts with nulls in some places (``if_else`` gives wrong offsets for a slice of strings)."""
    return texts.take(pa.array(np.arange(len(texts)), mask=gone))


Hits = tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]


def _rows(mask: pa.Array) -> np.ndarray:
    return np.flatnonzero(mask.fill_null(False).to_numpy(zero_copy_only=False))


def _quick(texts: pa.Array, own: str, group: bool) -> Hits | None:
    """Rows, starts, ends, texts and parts of all matches."""
    if 2 * len(_rows(pc.match_substring_regex(texts.slice(0, 256), own))) > min(256, len(texts)):  # most have one, so all are marked at once
        rows, searched_in = np.arange(len(texts)), texts.fill_null("")
    else:
        rows = _rows(pc.match_substring_regex(texts, own))
        searched_in = texts.take(pa.array(rows))
    if not len(rows):
        return None
    marked = pc.replace_substring_regex(searched_in, f"({own}())", rf"{_MARK}\1{_MARK}{chr(92) + '2' if group else ''}{_MARK}")
    pieces = pc.split_pattern(marked, _MARK)  # what is before, a match, its part, what is between, and so on
    begins, flat = pieces.offsets.to_numpy(), pieces.flatten()
    sizes = np.diff(begins)
    begins = begins[:-1] - begins[0]
    kind = (np.arange(len(flat)) - np.repeat(begins, sizes)) % 3
    length = pc.utf8_length(flat).to_numpy().astype(np.int64)
    before = np.cumsum(np.where(kind == 2, 0, length))
    hit = np.flatnonzero((kind == 1) & (np.arange(len(flat)) < np.repeat(begins + sizes, sizes) - 2))
    base = np.repeat(before[begins] - length[begins], sizes)[hit]
    end = before[hit] - base
    return np.repeat(rows, sizes)[hit], end - length[hit], end, flat.take(pa.array(hit)), flat.take(pa.array(hit + 1))


def _slow(texts: pa.Array, rows: np.ndarray, pattern: re.Pattern[str], group: bool) -> Hits | None:
    found = [(i, *m.span(), m[0], (m[1] or "") if group and pattern.groups else "") for i in rows.tolist() for m in pattern.finditer(texts[i].as_py())]
    if not found:
        return None
    row, start, end, text, part = zip(*found)
    return np.array(row), np.array(start), np.array(end), pa.array(text, pa.string()), pa.array(part, pa.string())


def _guard(p: Pattern) -> str:
    """What texts have in which a pattern is searched that Arrow's matcher can't say."""
    if p.dotted:
        return r"[A-Za-z0-9]\.[A-Za-z0-9]"
    need = needs(p.pattern, p.flags)
    return "(?i)" + "|".join(map(re.escape, need.literals)) if all(x.isascii() for x in need.literals) else ""


def matches(texts: pa.Array, patterns: list[Pattern]) -> Iterator[tuple[int, Hits]]:
    """A pattern's rule and its matches, in order of the patterns; those of a text are in order of places."""
    odd = _rows(pc.match_substring_regex(texts, _ODD))
    plain = texts if not len(odd) else without(texts, np.isin(np.arange(len(texts)), odd))
    for p in patterns:
        own = searched(p.pattern, p.flags)
        rows = odd if own else np.concatenate([odd, _rows(pc.match_substring_regex(plain, _guard(p)))])
        each = [_quick(plain, own, p.group) if own else None, _slow(texts, rows, to_python(p.pattern, p.flags), p.group) if len(rows) else None]
        yield from ((p.rule, h) for h in each if h)


def joined(hits: list[Hits]) -> Hits:
    return tuple(np.concatenate(c) if i < 3 else pa.concat_arrays(c) for i, c in enumerate(zip(*hits)))


def listed(n: int, row: np.ndarray, values: pa.StructArray, missing: pa.Array | None = None) -> pa.ListArray:
    """A list for each of ``n`` texts of the values that are of its row; rows are in order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=missing)


def struct(kind: pa.StructType, *columns: np.ndarray | pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(f.type) for c, f in zip(columns, kind)], fields=list(kind))


def _found(texts: pa.Array, patterns: list[Pattern]) -> pa.Array:
    """A list of FOUND for each text: in order of the patterns, then of places."""
    each = list(matches(texts, patterns))
    missing = pc.is_null(texts)
    if not each:
        return listed(len(texts), np.zeros(0, int), pa.array([], FOUND), missing)
    row, start, end, text, part = joined([h for _, h in each])
    order = np.argsort(row, kind="stable")
    rule = np.repeat([r for r, _ in each], [len(h[0]) for _, h in each])
    return listed(len(texts), row[order], struct(FOUND, rule, text, start, end, part).take(pa.array(order)), missing)


def sliced(over: Callable[[pa.Array], pa.Array], texts: pa.Array) -> pa.Array:
    """``over`` of slices of texts of about ``AT_ONCE`` bytes each, or of one text."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    at, out = 0, []
    while at < len(texts) or not out:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, "right")))
        out.append(over(texts.take(pa.array(np.arange(at, min(end, len(texts)))))))
        at = end
    return pa.concat_arrays(out)


def find(texts: pa.Array, patterns: list[Pattern]) -> pa.Array:
    return sliced(lambda x: _found(x, patterns), texts)
