"""Column builders for Unicode text: trimming, width folding, key and number parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The full-width forms sit at a constant offset from ASCII, so the tables follow from it.
_WIDE = 0xFEE0
DIGITS = "0123456789"
ALNUM = DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz"
# The full-width yen sign stands where the backslash would be; U+3000 is the wide space.
SYMBOLS = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _widened(chars: str) -> str:
    special = {" ": "　", "\\": "￥"}
    return "".join(special.get(c) or chr(ord(c) + _WIDE) for c in chars)


WIDE_DIGITS = _widened(DIGITS)
WIDE_ALNUM = _widened(ALNUM)
WIDE_SYMBOLS = _widened(SYMBOLS)
CIRCLED = "".join(chr(0x2460 + i) for i in range(9))


def utrim(c: Column) -> Column:
    """Strip Unicode white space, the ideographic space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold_digits(c: Column) -> Column:
    return F.translate(c, WIDE_DIGITS, DIGITS)


def fold_alnum(c: Column) -> Column:
    return F.translate(c, WIDE_ALNUM, ALNUM)


def fold_width(c: Column, circled: bool = False) -> Column:
    """Full-width digits, letters and symbols to ASCII; circled 1-9 on request."""
    wide, narrow = WIDE_ALNUM + WIDE_SYMBOLS, ALNUM + SYMBOLS
    if circled:
        wide, narrow = wide + CIRCLED, narrow + DIGITS[1:]
    return F.translate(c, wide, narrow)


def widen_alnum(c: Column) -> Column:
    return F.translate(c, ALNUM, WIDE_ALNUM)


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalize_key(c: Column) -> Column:
    """Comparison form of a field name: lower case, no white space, no brackets."""
    return F.regexp_replace(F.lower(c), r"(?U)[\s（）()【】\[\]「」]+", "")


def normalize_key_text(s: str) -> str:
    """Driver-side twin of `normalize_key`, for rule literals."""
    return "".join(ch for ch in s.lower() if not ch.isspace() and ch not in "（）()【】[]「」")


def num(c: Column) -> Column:
    """Number or null, accepting exactly plain and scientific decimal notation."""
    shape = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return let(
        fold_digits(utrim(c)), lambda t: F.when(t.rlike(shape), t.try_cast("double")))


def plain_number_text(c: Column) -> Column:
    """A double as decimal text with at least one decimal place (10000000.0, 2.5)."""
    size = F.abs(c)
    whole = F.concat(c.try_cast("bigint").cast("string"), F.lit(".0"))
    digits = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    return (
        F.when((c == F.floor(c)) & (size < 1e16), whole)
        .when((size >= 1e-4) & (size < 1e16), digits)
        .otherwise(c.cast("string"))
    )


def money(c: Column) -> Column:
    """Amount as totals and line cells write it: separators and currency signs dropped."""
    return num(F.translate(c, ",￥¥$", ""))


def truthy(c: Column, kind: str = "string") -> Column:
    """False for null, the empty string and zero."""
    empty = F.lit(0.0) if kind == "double" else F.lit("")
    return c.isNotNull() & (c != empty)


def substrings(c: Column, length: int) -> Column:
    """All substrings of one length in order, null for a shorter text."""
    last = F.length(c) - length + 1
    return F.when(last >= 1, F.transform(
        F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(length))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value computed once. Inside a lambda an expression over outer columns is
    evaluated for every element, so what does not change goes into a one-element array."""
    return F.get(F.transform(F.array(value), body), 0)


def listed(items: list[tuple[Column, Column]], kind: str) -> Column:
    """The values whose condition holds, in order, as an array of a type.

    Parts are joined instead of dropping nulls from one array of all values: that would go through a lambda, and
    Spark interprets a lambda together with all that is computed for it.
    """
    none = F.array().cast(kind)
    parts = [F.when(condition, F.array(value)).otherwise(none) for condition, value in items]
    return F.concat(*parts).cast(kind) if parts else none


def sql_text(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fence(c: Column) -> Column:
    """The same value, from below which no filter is pushed.

    A filter on a stage's result would otherwise be moved under the stage, with the whole
    expression copied into it once per reference, stage after stage.
    """
    return F.when(F.spark_partition_id() >= 0, c)
