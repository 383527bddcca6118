"""Small text expressions shared by all operators.

Patterns follow Python's regular expressions: ``(?U)`` gives Unicode classes, ``(?d)`` makes
only ``\\n`` a line end, ``(?iu)`` ignores case beyond ASCII.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def contains_any(lowered: Column, words: list[str]) -> Column:
    """True when any of the lower-case ``words`` occurs."""
    return reduce(or_, [F.contains(lowered, F.lit(w.lower())) for w in words])


def count_present(c: Column, words: list[str]) -> Column:
    """How many different ``words`` occur (each counts once)."""
    return reduce(add, [F.contains(c, F.lit(w)).cast("int") for w in words])


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def cut(c: Column, n: int) -> Column:
    """First ``n`` characters (the display lengths the prompts ask for)."""
    return F.substring(c, 1, n)


def join_lines(parts: list[Column]) -> Column:
    return F.concat_ws("\n", *parts)


def _round_scaled(x: Column, digits: int, bits: int) -> Column:
    scale = 10 ** digits
    whole = (x * float(2 ** bits)).cast("bigint")
    mask, rest_bits = (1 << 30) - 1, bits - 30
    low = whole.bitwiseAND(F.lit(mask)) * scale
    high = F.shiftright(whole, 30) * scale + F.shiftright(low, 30)
    quotient = F.shiftright(high, rest_bits)
    rest = F.shiftleft(high.bitwiseAND(F.lit((1 << rest_bits) - 1)), 30) + low.bitwiseAND(F.lit(mask))
    half = 1 << (bits - 1)
    up = (rest > half) | ((rest == half) & (quotient % 2 == 1))
    return (quotient + up.cast("bigint")) / F.lit(float(scale))


def round_exact(x: Column, digits: int = 3, below: float = 4.0) -> Column:
    """Round a double half-even on its binary value, as Python's round() does.

    A double times a power of two is exact, so the remainder of the scaled whole number decides
    without a second rounding error. Exact for values from 2**-8 up to ``below``, which is 4 or
    16384; larger ones are rounded on their decimal form.
    """
    unit = _round_scaled(x, digits, 60)
    if below <= 4:
        return unit
    return (
        F.when(x < 4, unit)
        .when(x < 64, _round_scaled(x, digits, 56))
        .when(x < 1024, _round_scaled(x, digits, 52))
        .when(x < 16384, _round_scaled(x, digits, 48))
        .otherwise(F.bround(x, digits))
    )


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", round_exact(x, 1, 16384))
