"""Sums of doubles that no order of the rows changes: exact until one rounding at the end.

A double is a whole number times a power of two. Values are dealt into bins of ``SPAN`` exponents and added there as whole numbers,
in three pieces of 20 bits, so partial sums merge without loss. The few bins of a group then become
doubles again, whose exact sum is rounded once (two-sums without overlap, as in Shewchuk's adaptive sums).
A bin takes up to 2^41 values before a piece leaves 64 bits, which raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN, PIECE_BITS = 8, 20
#: What a group adds up for each bin, and beside the bins.
PIECES, SPECIAL = ("high", "mid", "low"), ("nans", "rises", "falls")
_MASK = (1 << PIECE_BITS) - 1


def is_finite(x: Column) -> Column:
    return F.abs(x) < F.lit(float("inf"))  # NaN counts as greater


def exponent_bin(x: Column) -> Column:
    """The bin of a finite double; null for others. The logarithm may be one too high or low, two spare bits allow for that."""
    power = F.coalesce(F.floor(F.log2(F.abs(x))), F.lit(0))
    return F.when(is_finite(x), F.floor((power - 53) / SPAN)).cast("int")


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def scaled(x: Column, exponent_bin: Column) -> Column:
    """The whole number that a double is in its bin, below 2^62. Scaling by halves keeps the powers in range."""
    half = _power(exponent_bin * F.lit(-SPAN // 2))
    return (x * half * half).cast("bigint")


def piece_sums(whole: Column, x: Column) -> list[Column]:
    """The aggregates of one bin: three pieces of the whole numbers, and how many values are not finite."""
    pieces = (F.shiftright(whole, 2 * PIECE_BITS), F.shiftright(whole, PIECE_BITS).bitwiseAND(F.lit(_MASK)), whole.bitwiseAND(F.lit(_MASK)))
    special = (F.isnan(x), x == F.lit(float("inf")), x == F.lit(float("-inf")))
    return [F.coalesce(F.sum(p), F.lit(0)).alias(n) for p, n in zip(pieces, PIECES, strict=True)] + [F.count_if(s).alias(n) for s, n in zip(special, SPECIAL, strict=True)]


def merged_sums() -> list[Column]:
    """The same of several partial sums of one bin."""
    return [F.sum(name).alias(name) for name in (*PIECES, *SPECIAL)]


def _terms(b: Column) -> Column:
    """A bin's pieces as doubles that are exact: pieces of more than 53 bits in two."""
    half, out = _power(b["bin"] * (SPAN // 2)), []
    for k, name in enumerate(PIECES):
        piece = b[name]
        low = F.when(F.abs(piece) >= F.lit(1 << 53), piece.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0).cast("bigint"))
        for part in (piece - low, low):
            out.append(part.cast("double") * F.lit(float(1 << (PIECE_BITS * (2 - k)))) * half * half)
    return F.array(*out)


def _added(partials: Column, x: Column) -> Column:
    """One more term: its two-sum with every partial leaves the errors as partials and the sum as the last."""
    none = F.array().cast("array<double>")

    def two_sum(a: Column, y: Column) -> Column:
        high = a["x"] + y
        back = high - a["x"]
        low = (a["x"] - (high - back)) + (y - back)
        return F.struct(high.alias("x"), F.when(low != 0, F.array_append(a["low"], low)).otherwise(a["low"]).alias("low"))

    return F.aggregate(partials, F.struct(x.alias("x"), none.alias("low")), two_sum, lambda a: F.array_append(a["low"], a["x"]))


def _rounded(partials: Column) -> Column:
    """The sum of partials that do not overlap, greatest first: the first sum that leaves an error decides, and of a tie what comes below."""
    start = F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("low"), F.lit(0.0).alias("below"))

    def down(a: Column, y: Column) -> Column:
        high = a["high"] + y
        going = a["low"] == 0
        return F.struct(
            F.when(going, high).otherwise(a["high"]).alias("high"), F.when(going, y - (high - a["high"])).otherwise(a["low"]).alias("low"),
            F.when(going | (a["below"] != 0), a["below"]).otherwise(y).alias("below"),
        )

    def tie(a: Column) -> Column:
        up = a["high"] + a["low"] * 2
        return F.when((a["low"] != 0) & (F.signum(a["low"]) == F.signum(a["below"])) & (up - a["high"] == a["low"] * 2), up).otherwise(a["high"])

    return F.aggregate(F.reverse(partials), start, down, tie)


def exact_total(bins: Column) -> Column:
    """The sum of a group from its bins, an array of (bin, high, mid, low, nans, rises, falls), rounded to the nearest double.

    Null for no bins. NaN and infinities sum as in IEEE arithmetic: NaN, or both infinities, make NaN. A sum
    whose terms leave the range of doubles is infinite.
    """
    finite = F.filter(bins, lambda b: b["bin"].isNotNull())
    terms = F.filter(F.flatten(F.transform(finite, _terms)), lambda t: t != 0)
    total = _rounded(F.aggregate(terms, F.array().cast("array<double>"), _added))
    plain = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    nan, up, down = (F.exists(bins[name], lambda n: n > 0) for name in SPECIAL)
    return (
        F.when(F.size(bins) == 0, F.lit(None).cast("double"))
        .when(nan | (up & down), F.lit(float("nan")))
        .when(up, F.lit(float("inf"))).when(down, F.lit(float("-inf")))
        .when(~is_finite(plain), plain).otherwise(total)
    )
