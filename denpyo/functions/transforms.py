"""Named column transforms and chains of them (`name[:parameter]`).

A chain compiles on the driver to one native expression. A step that cannot be applied to a
value leaves that value as it was; null input skips the chain; unknown names are reported at
compile time and skipped.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import dates
from .text import (
    fold_alnum, fold_digits, fold_width, let, num, plain_number_text, squeeze_spaces, truthy, utrim, widen_alnum,
)

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Typed:
    """A column with the type the chain has reached: string, double or strings (array)."""

    col: Column
    kind: str = "string"

    def text(self) -> Column:
        if self.kind == "double":
            return plain_number_text(self.col)
        if self.kind == "strings":
            return F.concat(F.lit("['"), F.array_join(self.col, "', '"), F.lit("']"))
        return self.col


Step = Callable[[Typed, str | None], Typed]
_REGISTRY: dict[str, Step] = {}


def _step(name: str):
    def keep(fn: Step) -> Step:
        _REGISTRY[name] = fn
        return fn
    return keep


def register_transform(
    name: str, fn: Callable[[Column, str | None], Column], returns: str = "string"
) -> None:
    """Add a transform: `fn` gets the text form of the value and the parameter."""
    _REGISTRY[name] = lambda v, p: Typed(fn(v.text(), p), returns)


def transform_names() -> list[str]:
    return sorted(_REGISTRY)


# Text -----------------------------------------------------------------------------------

# Currency marks, removed one after the other in this order.
CURRENCY_MARKS = ["¥", "￥", "$", "€", "£", "円", "yen", "jpy", "USD", "EUR", "GBP"]


def strip_currency(c: Column) -> Column:
    # Single characters cannot form one another, so they go in one pass; the words follow.
    signs = "".join(m for m in CURRENCY_MARKS if len(m) == 1)
    out = F.translate(c, signs, "")
    for word in (m for m in CURRENCY_MARKS if len(m) > 1):
        out = F.replace(out, F.lit(word), F.lit(""))
    return utrim(F.translate(out, ",，、", ""))


def normalize_japanese(c: Column) -> Column:
    return utrim(squeeze_spaces(fold_alnum(c)))


def extract_number(c: Column) -> Column:
    return F.translate(F.regexp_extract(fold_width(c), r"[\d,.-]+", 0), ",", "")


def normalize_phone(c: Column) -> Column:
    kept = F.regexp_replace(fold_width(utrim(c)), r"[^\d+-]", "")
    return F.regexp_replace(kept, r"-+", "-")


def normalize_postal_code(c: Column) -> Column:
    kept = F.regexp_replace(fold_width(utrim(c)), r"[^\d-]", "")
    return F.regexp_replace(kept, r"^(\d{3})(\d{4})$", "$1-$2")


def extract_postal_code(c: Column) -> Column:
    """First seven-digit code in the text as NNN-NNNN, '' if there is none."""
    found = F.regexp_extract(fold_width(c), r"(?<!\d)\d{3}-?\d{4}(?!\d)", 0)
    return F.regexp_replace(found, r"^(\d{3})(\d{4})$", "$1-$2")


def final_amount(c: Column) -> Column:
    """The amount after the equals sign of a composite text, else the text without marks."""
    pattern = r"(?U)=\s*[¥￥]?([0-9,]+)"
    return F.when(
        c.rlike(pattern), F.translate(F.regexp_extract(c, pattern, 1), ",", "")
    ).otherwise(strip_currency(c))


register_transform("trim", lambda c, p: utrim(c))
register_transform("upper", lambda c, p: F.upper(c))
register_transform("lower", lambda c, p: F.lower(c))
register_transform("strip_currency", lambda c, p: strip_currency(c))
register_transform("normalize_japanese", lambda c, p: normalize_japanese(c))
register_transform("extract_number", lambda c, p: extract_number(c))
register_transform("remove_spaces", lambda c, p: F.regexp_replace(c, r"(?U)\s+", ""))
register_transform("zenkaku_to_hankaku", lambda c, p: fold_alnum(c) if p else fold_width(c))
register_transform("hankaku_to_zenkaku", lambda c, p: widen_alnum(c))
register_transform("normalize_phone", lambda c, p: normalize_phone(c))
register_transform("normalize_postal_code", lambda c, p: normalize_postal_code(c))
register_transform("extract_postal_code", lambda c, p: extract_postal_code(c))
register_transform("fold_circled", lambda c, p: fold_width(c, circled=True))
register_transform("final_amount", lambda c, p: final_amount(c))
register_transform("parse_japanese_date", lambda c, p: dates.japanese_date(utrim(c)))


@_step("to_date")
def _to_date(v: Typed, p: str | None) -> Typed:
    out = dates.to_date_text(v.text(), p)
    return Typed(F.when(v.col != 0, out) if v.kind == "double" else out)


@_step("replace")
def _replace(v: Typed, p: str | None) -> Typed:
    if not p or "|" not in p:
        return v
    old, new = p.split("|", 1)
    return Typed(F.replace(v.text(), F.lit(old), F.lit(new)))


@lru_cache(maxsize=None)
def _try_pattern(pattern: str) -> None:
    """Raise now what the pattern would raise in a job: the two regex dialects differ."""
    SparkSession.active().sql("SELECT 1").select(F.lit("").rlike(pattern)).collect()


@_step("regex")
def _regex(v: Typed, p: str | None) -> Typed:
    if not p:
        return v
    pattern = "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p.replace("(?P<", "(?<"))
    try:
        groups = re.compile(p).groups
        _try_pattern(pattern)
    except (re.error, PySparkException) as exc:
        log.warning("regex %r skipped: %s", p, exc)
        return v
    return Typed(let(v.text(), lambda c: F.when(
        c.rlike(pattern), F.regexp_extract(c, pattern, min(groups, 1))).otherwise(c)))


@_step("default")
def _default(v: Typed, p: str | None) -> Typed:
    if v.kind == "strings":
        return v
    return Typed(let(v.col, lambda c: F.when(
        truthy(c, v.kind), Typed(c, v.kind).text()).otherwise(F.lit(p))))


@_step("split")
def _split(v: Typed, p: str | None) -> Typed:
    return Typed(F.split(v.text(), "\\Q" + (p or ",") + "\\E", -1), "strings")


@_step("join")
def _join(v: Typed, p: str | None) -> Typed:
    return Typed(F.array_join(v.col, p or ",")) if v.kind == "strings" else Typed(v.text())


# Numbers --------------------------------------------------------------------------------


@_step("to_decimal")
def _to_decimal(v: Typed, p: str | None) -> Typed:
    places = int(p) if p else 2
    digits = F.regexp_replace(fold_digits(strip_currency(v.text())), r"[^\d.-]", "")
    # Only digits, points and signs are left, on which the plain cast is exact.
    value = F.coalesce(digits.try_cast("double"), F.lit(0.0))
    return Typed(F.bround(value, places) if places >= 0 else value, "double")


def _arithmetic(v: Typed, fn: Callable[[Column], Column]) -> Typed:
    if v.kind == "double":
        return Typed(fn(v.col), "double")
    if v.kind == "strings":
        return v

    # Text that is no number stays as it is, so the result has to stay text as well.
    def on_text(c: Column) -> Column:
        return let(num(c), lambda n: F.when(n.isNull(), c).otherwise(let(fn(n), plain_number_text)))

    return Typed(let(v.col, on_text))


@_step("round")
def _round(v: Typed, p: str | None) -> Typed:
    places = int(p) if p else 0
    return _arithmetic(v, lambda c: F.bround(c, places))


@_step("abs")
def _abs(v: Typed, p: str | None) -> Typed:
    return _arithmetic(v, F.abs)


@_step("multiply")
def _multiply(v: Typed, p: str | None) -> Typed:
    factor = float(p or "")
    return _arithmetic(v, lambda c: c * F.lit(factor))


@_step("divide")
def _divide(v: Typed, p: str | None) -> Typed:
    divisor = float(p or "")
    if divisor == 0:
        return _arithmetic(v, lambda c: F.lit(None).cast("double"))
    return _arithmetic(v, lambda c: c / F.lit(divisor))


# Chains ---------------------------------------------------------------------------------


def compile_chain(c: Column, chain: Iterable[str], kind: str = "string") -> Typed:
    """Fold a chain over a column. The result is null wherever the input is null."""
    value = Typed(c, kind)
    for item in chain:
        name, _, param = item.partition(":")
        step = _REGISTRY.get(name)
        if step is None:
            log.warning("unknown transform %r skipped", name)
            continue
        try:
            value = step(value, param if ":" in item else None)
        except ValueError as exc:  # a parameter that is no number fails for every value
            log.warning("transform %r skipped: %s", item, exc)
    return Typed(F.when(c.isNotNull(), value.col), value.kind)


def apply_chain(c: Column, *chain: str, kind: str = "string") -> Column:
    """Chain result as a column of its natural type."""
    return compile_chain(c, chain, kind).col


def chain_text(c: Column, *chain: str) -> Column:
    """Chain result in text form."""
    return compile_chain(c, chain).text()
