"""Date columns: Japanese era notation, numeric notation and strptime-style formats."""

from __future__ import annotations

import re
import string
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGITS, fold_digits, let, utrim

# The year before year 1 of each era.
ERA_BASE_YEAR = {"令和": 2018, "平成": 1988, "昭和": 1925, "大正": 1911, "明治": 1867}

_DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s",
    "%B": "MMMM", "%b": "MMM", "%%": "%",
}

# Layouts of dates without a format. The shape of a text (0 for each digit, a for each letter) has one of them
# at most, so a parser only sees texts that it may read: a failed parse costs an exception. Dates that begin with
# the year and have - or / are found by `japanese_date`, whatever follows them.
FREE_LAYOUTS = (
    "yyyy.M.d", "yyyyMMdd", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy",
)
_WIDTHS = {
    "yyyy": ["0000"], "MM": ["00"], "dd": ["00"], "M": ["0", "00"], "d": ["0", "00"],
    "MMM": ["aaa"], "MMMM": ["a" * n for n in range(4, 10)],
}


def shapes(layout: str) -> list[str]:
    """All shapes of texts that a layout may read."""
    parts = [m.group() for m in re.finditer(r"([yMd])\1*|.", layout)]
    return ["".join(p) for p in product(*[_WIDTHS.get(part, [part]) for part in parts])]


_LAYOUT_OF = {shape: layout for layout in FREE_LAYOUTS for shape in shapes(layout)}


def free_date(c: Column) -> Column:
    """ISO date text by the layout of the text's shape, null where it has none or is no day."""
    letters = string.ascii_letters
    shape = F.translate(c, DIGITS + letters, "0" * len(DIGITS) + "a" * len(letters))
    layouts = F.create_map(*[F.lit(x) for pair in _LAYOUT_OF.items() for x in pair])
    # Spark keeps the parser of a literal layout; one that differs by row is built for every row.
    chosen = F.when(F.length(c) <= max(map(len, _LAYOUT_OF)), F.try_element_at(layouts, shape))
    return let(chosen, lambda layout: F.coalesce(*[
        F.when(layout == own, F.try_to_date(c, own).cast("string")) for own in FREE_LAYOUTS]))


def japanese_date(c: Column, strict: bool = False) -> Column:
    """First era date, else 年月日, else Y/M/D or Y-M-D found in the text; null if none.

    The calendar is not checked unless `strict`.
    """
    base = F.create_map(*[F.lit(x) for pair in ERA_BASE_YEAR.items() for x in pair])

    def search(text: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))

    def first(d: Column) -> Column:
        # Plain substring tests keep the patterns off values that can not match.
        eras = [F.when(d.contains(era), search(d, era + r"\d+年\d+月\d+日")) for era in ERA_BASE_YEAR]
        named = F.coalesce(*eras, search(d, r"\d{4}年\d{1,2}月\d{1,2}日"))
        return F.coalesce(F.when(d.contains("年"), named), search(d, r"\d{4}[/-]\d{1,2}[/-]\d{1,2}"))

    def padded(n: Column, width: int) -> Column:
        digits = n.cast("string")
        return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))

    def iso(hit: Column) -> Column:
        def joined(numbers: Column) -> Column:
            year, month, day = (F.get(numbers, i).try_cast("bigint") for i in range(3))
            year = F.try_add(year, F.coalesce(F.try_element_at(base, F.left(hit, F.lit(2))), F.lit(0)))
            return F.concat(padded(year, 4), F.lit("-"), padded(month, 2), F.lit("-"), padded(day, 2))

        return F.when(hit.isNotNull(), let(F.regexp_extract_all(hit, F.lit(r"\d+"), F.lit(0)), joined))

    found = let(let(fold_digits(c), first), iso)
    if strict:
        found = F.when(F.try_to_date(found, "yyyy-M-d").isNotNull(), found)
    return found


def spark_layout(fmt: str) -> str | None:
    """Spark datetime pattern for a strptime format, None if a directive has no twin."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            part = _DIRECTIVES.get(fmt[i:i + 2])
            if part is None:
                return None
            out.append(part)
            i += 2
        else:
            out.append("'" + fmt[i] + "'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def to_date_text(c: Column, fmt: str | None = None) -> Column:
    """ISO date text; '' gives null, an unreadable value is returned unchanged."""

    def read(t: Column) -> Column:
        if fmt == "%Y-%m-%d":
            # Whatever this format reads, the substring search reads to the same date.
            return japanese_date(t)
        if fmt:
            layout = spark_layout(fmt)
            if layout is None:
                return japanese_date(t)
            return F.coalesce(F.try_to_date(t, layout).cast("string"), japanese_date(t))
        # No text of these shapes has an era, a 年 or a year before - or /, so the order does not matter.
        return F.coalesce(free_date(t), japanese_date(t))

    return let(utrim(c), lambda t: F.when(c != "", F.coalesce(read(t), t)))


def iso_date(c: Column) -> Column:
    """DATE of YYYY-MM-DD text (one-digit month and day allowed), null if not a real day."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d"))
