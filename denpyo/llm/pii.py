"""Personal data in whole texts, with DataFrame operations only.

Method: regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for bank
accounts, ranges and digit counts for the rest), and words nearby move the score, which starts from
how often a confirmed span of its kind is what it looks like. Spans of the base kinds stay whatever
their score; those of other kinds stay from `KEPT_SCORE` on.

How it is done: a text is cut by a kind's expression twice, into the matches and into the gaps
between them. Their lengths, added up, are the positions, so a text of any length takes one pass
and no search for what was found. The sums are folded in blocks, so that thousands of matches in one text
stay linear. Expressions start a match only where a run of its characters starts (or right behind
the last match) and never give characters back where that could not help, so none is quadratic; the
matches are those of the plain expressions, leftmost and not overlapping.

Everything is an expression of one row: no shuffle, no state, nothing that grows with the table.

Results by case: null text has no spans, like the empty one; rows are independent, so null and repeated
ids give a row each; an empty table gives none. Positions count code points, ends are exclusive. Spans
of different kinds may overlap; they are ordered by start, then by kind as `KINDS` lists them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Characters on either side that count as nearby, up to the neighbouring spans of the kind.
CONTEXT = 40
#: What a good or a bad word nearby adds to the score, and the least score of a kind that is not base.
WORD_WEIGHT, KEPT_SCORE = 0.3, 0.5
#: Matches that are folded at once.
BLOCK = 256

#: Lengths of bank account numbers by country (fixed values).
ACCOUNT_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}


class Kind(NamedTuple):
    name: str
    #: The expression, written to be linear, and a text without which it has no match.
    pattern: str
    needs: str
    #: Length of the span within the match, null if the match is none: (match, text before, text after).
    length: Callable[[Column, Column, Column], Column]
    prior: float
    good: str
    bad: str
    base: bool = True


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _whole(match: Column, valid: Column) -> Column:
    return F.when(valid, F.length(match))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a number (text of digits) is right."""

    def value(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number (capital letters and digits) has the remainder 1."""
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
        return (rest * F.when(c >= "A", 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _address(match: Column, before: Column, after: Column) -> Column:
    part = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return _whole(match, match.rlike(rf"^{part}(\.{part}){{3}}$"))


def _card(match: Column, before: Column, after: Column) -> Column:
    return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), F.when(luhn(d), F.length(match))))


def _phone(match: Column, before: Column, after: Column) -> Column:
    return _whole(match, F.length(_digits(match)).between(10, 15))


def _account(match: Column, before: Column, after: Column) -> Column:
    """The country tells the length; what follows it in the match must be another group."""
    lengths = F.create_map(*[F.lit(x) for pair in ACCOUNT_LENGTHS.items() for x in pair])
    size = F.try_element_at(lengths, F.substring(match, 1, 2))

    def cut(span: Column) -> Column:
        rest = F.substring(match, F.length(span) + 1, F.lit(1))
        ends = F.when(rest == "", ~after.rlike("^[A-Za-z0-9]")).otherwise(rest == " ")
        return F.when(ends & (F.length(span) > 0) & ~before.rlike("[A-Za-z0-9]$"),
                      F.when(mod97(F.replace(span, F.lit(" "))), F.length(span)))

    inner = F.concat(F.lit("^(?:[A-Z0-9] ?){"), (size - 1).cast("string"), F.lit("}[A-Z0-9]"))
    return F.when(size.isNotNull(), let(F.call_function("regexp_extract", match, inner, F.lit(0)), cut))


def _social(match: Column, before: Column, after: Column) -> Column:
    shape = match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    return _whole(match, shape & ~match.rlike("^(000|666|9)|-00-|-0000$"))


def _national(match: Column, before: Column, after: Column) -> Column:
    free = ~before.rlike(r"[A-Za-z0-9+./-]$") & ~after.rlike("^[A-Za-z0-9]")
    return _whole(match, F.length(_digits(match)).between(9, 12) & free)


#: Patterns, priors and words of each kind, in the order of their spans; the first four are the base.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m, b, a: F.length(m), 0.9, "mail|contact|write|schreib|correo|courriel", "example|noreply"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _address,
         0.5, "ip|host|server|login|address|adresse", "version|release|section|chapter"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13,}+", "", _card,
         0.7, "card|visa|master|credit|karte|carte|tarjeta|pay", "order|isbn|serial|tracking|article"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", _phone,
         0.7, "tel|phone|call|fax|mobil|whatsapp|anruf", "score|sum|total"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+", "", _account,
         0.9, "iban|bank|account|konto|compte|cuenta", "serial|key", False),
    Kind("ssn", r"[0-9][0-9-]{9,}+", "-", _social,
         0.3, "ssn|social security|taxpayer", "order|isbn|serial|tracking", False),
    Kind("tel", r"0[0-9 ()./-]{7,}[0-9]", "", _national,
         0.3, "tel|phone|call|fax|mobil|anruf|appel|llam", "order|isbn|serial|invoice|total", False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _lengths(gaps: Column, matches: Column) -> Column:
    """(gap, size) of every match and the gap before it."""
    return F.zip_with(matches, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))


def _starts(lengths: Column) -> Column:
    """Where each match starts, from its length and that of the gap before it: ARRAY<INT>."""

    def blocks(sizes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")),
                           lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))

    def within(block: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, first, lambda s, e: F.struct(
            (s["at"] + e["gap"] + e["size"]).alias("at"),
            F.concat(s["out"], F.array(s["at"] + e["gap"])).alias("out")), lambda s: s["out"])

    def placed(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, e: s + e["gap"] + e["size"]))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), within))

    return let(blocks(lengths), placed)


def _weight(near: Column, words: str) -> Column:
    return F.when(near.rlike(f"(^|[^a-z])({words})"), WORD_WEIGHT).otherwise(0.0)


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """Spans of one kind in their order; null where the match is none."""

    def span(start: Column, match: Column, before: Column, after: Column) -> Column:
        near = F.lower(F.concat(F.substring(before, -CONTEXT, CONTEXT), F.lit(" "), F.substring(after, 1, CONTEXT)))
        moved = F.lit(kind.prior) + _weight(near, kind.good) - _weight(near, kind.bad)
        return let(kind.length(match, before, after), lambda size: F.when(size.isNotNull(), F.struct(
            start.alias("start"), F.lit(number).alias("number"), (start + size).alias("end"),
            F.lit(kind.name).alias("kind"), F.substring(match, F.lit(1), size).alias("value"),
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 2).alias("score"), F.lit(kind.base).alias("base"))))

    def placed(gaps: Column, matches: Column) -> Column:
        return let(_starts(_lengths(F.slice(gaps, F.lit(1), F.size(matches)), matches)), lambda starts: F.transform(
            matches, lambda m, i: span(F.get(starts, i), m, F.get(gaps, i), F.get(gaps, i + 1))))

    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string,value:string,score:double,base:boolean>>")
    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda matches: F.when(
        F.size(matches) == 0, none).otherwise(let(F.split(text, kind.pattern, -1), lambda gaps: placed(gaps, matches))))
    return F.when(text.contains(kind.needs), found).otherwise(none) if kind.needs else found


def spans_of(text: Column) -> Column:
    """ARRAY<STRUCT<start, number, end, kind, value, score, base>> of a text, in order."""
    every = F.concat(*[_spans(text, i, k) for i, k in enumerate(KINDS)])
    return F.array_sort(F.filter(every, lambda s: s.isNotNull() & (s["base"] | (s["score"] >= KEPT_SCORE))))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every document (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", spans_of(F.col("text")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in brackets; of spans that overlap the first decides."""

    def step(state: Column, s: Column) -> Column:
        text = F.concat(F.substring("text", state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(
            s["end"].alias("at"), F.concat(state["out"], F.array(text)).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate("spans", first, step, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring("text", s["at"] + 1, F.length("text"))))
    return find(docs).select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(cut).alias("text"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<kind> and base_sha256 of the base spans, spans, scores) for every document."""
    found = find(docs).select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
