"""Array expressions whose work grows with the array, not with its square.

A fold that appends to an array copies it at each step.  Sums over an array are therefore made in pieces of about the
square root of its length, so the copies stay short; texts are cut into blocks, so a part of a text is found without
walking there from its beginning.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 9
_PIECE = 16
BLOCK = 1 << _SHIFT


def let(value: Column, over: Callable[[Column], Column]) -> Column:
    """``over`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), over), 1)


def running(values: Column, op: Callable[[Column, Column], Column] = operator.add) -> Column:
    """Sums (or what ``op`` gives) of an int array's values up to each place, that one included, beginning with 0."""

    def fold(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def over(v: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        last = F.floor((F.greatest(F.lit(1), F.size(v)) - 1) / step).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: fold(F.slice(v, i * step + 1, step)))

        def joined(p: Column) -> Column:
            heads = fold(F.transform(p, lambda a: F.element_at(a, -1)))
            return let(heads, lambda h: F.flatten(F.transform(p, lambda a, i: F.transform(F.slice(a, 2, F.size(a)), lambda x: op(F.get(h, i), x)))))

        return let(parts, joined)

    # A short array is one piece, as most are.
    return let(values, lambda v: F.when(F.size(v) <= _PIECE, F.slice(fold(v), 2, F.size(v))).otherwise(over(v)))


def firsts(ordered: Column, key: Callable[[Column], Column]) -> Column:
    """Elements of a sorted array whose key differs from the one before."""
    return let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | ~key(x).eqNullSafe(key(F.get(s, i - 1)))))


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(of: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` up to ``end`` of the text whose :func:`blocks` these are; both lie within the text."""
    first = F.shiftright(start, _SHIFT)
    n = F.shiftright(end, _SHIFT) - first + 1
    return F.substring(F.array_join(F.slice(of, first + 1, n), ""), start.bitwiseAND(F.lit(BLOCK - 1)) + 1, end - start)
