"""Document type, vendor and confidence from text. Every step works within one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import fence, fold_alnum, squeeze_spaces, utrim
from .vendor_table import with_table_vendor


def normalize_for_matching(c: Column) -> Column:
    """Runs of white space to one space, full-width letters and digits to ASCII."""
    return fold_alnum(squeeze_spaces(c))


def _ascii(word: str) -> bool:
    return word.isascii()


def keyword_score(lower: Column, normalized: Column, words: list[str]) -> Column:
    """Number of words found in the lower-cased or the normalized text."""
    hits = []
    for word in words:
        hit = lower.contains(word)
        if _ascii(word):
            # Normalizing touches spaces and Latin letters only, so other words cannot gain.
            hit = hit | normalized.contains(word)
        hits.append(hit.cast("int"))
    return sum(hits[1:], hits[0])


def type_by_score(scores: dict[str, Column], min_score: int = 2,
                  default: str | None = None) -> Column:
    """The type that scores strictly higher than the other and at least `min_score`."""
    (first, a), (second, b) = scores.items()
    return (
        F.when((a > b) & (a >= min_score), first)
        .when((b > a) & (b >= min_score), second)
        .otherwise(F.lit(default))
    )


def simple_type(text: Column) -> Column:
    """Type without a minimum score: invoice if it scores higher, else order if it scores."""
    lower = F.lower(text)
    words = rules.SIMPLE_TYPE_KEYWORDS
    a, b = (keyword_score(lower, lower, words[t]) for t in (rules.INVOICE, rules.PURCHASE_ORDER))
    return (
        F.when(a > b, rules.INVOICE).when(b > 0, rules.PURCHASE_ORDER).otherwise("UNKNOWN")
    )


def fixed_score_type(text: Column) -> tuple[Column, Column]:
    """First type with any keyword, with the score that belongs to it."""
    lower = F.lower(text)
    name, score = (F.lit(v) for v in rules.FIXED_SCORE_UNKNOWN)
    for doc_type, words, value in reversed(rules.FIXED_SCORE_KEYWORDS):
        hit = F.lit(False)
        for word in words:
            hit = hit | (lower if _ascii(word) else text).contains(word)
        name, score = F.when(hit, doc_type).otherwise(name), F.when(hit, value).otherwise(score)
    return name, score


def first_company(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, trimmed; null if none does."""
    found = [F.regexp_extract(text, "(?U)" + p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", utrim(f)) for f in found])


def vendor_by_patterns(text: Column, vendors: dict) -> Column:
    """First vendor, in rule order, any of whose patterns occurs; entries that are no
    mapping are skipped."""
    branches = []
    for vendor, kinds in vendors.items():
        if not isinstance(kinds, dict):
            continue
        for kind, patterns in kinds.items():
            for p in patterns:
                if kind == "phone_patterns" and "-" in p:
                    hit = text.rlike("(?U)" + p.replace("-", r"[\-\s]?"))
                elif kind in ("company_names", "phone_patterns", "domains", "addresses"):
                    hit = text.contains(p)
                else:
                    continue
                branches.append(F.when(hit, vendor))
    return F.coalesce(*branches) if branches else F.lit(None).cast("string")


def vendor(text: Column, vendors: dict | None = None) -> Column:
    vendors = rules.VENDOR_PATTERNS if vendors is None else vendors
    return F.coalesce(
        vendor_by_patterns(text, vendors), first_company(text, rules.VENDOR_FALLBACK)
    )


def simple_vendor(text: Column) -> tuple[Column, Column]:
    """Company name up to 30 characters on its line with score 0.8, else 不明 with 0.0."""
    name = first_company(text, rules.VENDOR_ON_LINE)
    return F.coalesce(name, F.lit(rules.UNKNOWN_VENDOR)), F.when(name.isNotNull(), 0.8).otherwise(0.0)


def confidence(doc_type: Column, vendor_name: Column, text: Column) -> Column:
    w = rules.CONFIDENCE_WEIGHTS
    words = [text.contains(x).cast("int") for x in rules.CONFIDENCE_WORDS]
    share = sum(words[1:], words[0]) / F.lit(float(len(words)))
    score = (
        F.when(F.coalesce(doc_type, F.lit("")) != "", w["type"]).otherwise(0.0)
        + F.when(F.coalesce(vendor_name, F.lit("")) != "", w["vendor"]).otherwise(0.0)
        + share * F.lit(w["words"])
    )
    # A null text has no words to count and no confidence.
    return F.least(F.coalesce(score, F.lit(0.0)), F.lit(1.0))


def with_classification(df: DataFrame, text: str = "raw_text", vendors: dict | None = None,
                        vendor_table: DataFrame | None = None) -> DataFrame:
    """Add doc_type, vendor and confidence. Vendors are found by folded patterns or by a table of any
    size (see `match_vendor_master`), else by company suffixes."""
    t = F.col(text)
    named = vendor(t, vendors)
    if vendor_table is not None:
        df = with_table_vendor(df, vendor_table, text, "_listed")
        named = F.coalesce(F.col("_listed"), first_company(t, rules.VENDOR_FALLBACK))
    return (
        df.withColumns({"_lower": F.lower(t), "_norm": normalize_for_matching(t)})
        .withColumns({
            f"_score_{k}": keyword_score(F.col("_lower"), F.col("_norm"), words)
            for k, words in rules.TYPE_KEYWORDS.items()
        })
        .withColumns({
            "doc_type": fence(type_by_score({k: F.col(f"_score_{k}") for k in rules.TYPE_KEYWORDS})),
            "vendor": fence(named),
        })
        .withColumn("confidence", confidence(F.col("doc_type"), F.col("vendor"), t))
        .drop("_lower", "_norm", "_listed", *[f"_score_{k}" for k in rules.TYPE_KEYWORDS])
    )


# Vendor master of any size ----------------------------------------------------------------


def match_vendor_master(docs: DataFrame, patterns: DataFrame, doc_id: str = "doc_id",
                        text: str = "raw_text") -> DataFrame:
    """First pattern of a vendor table that occurs in each text: (doc_id, vendor), null if none, one row for
    each row of docs.

    `patterns` has (vendor_ord, pat_ord, vendor, pattern) and optionally `kind`; in
    "phone_patterns" a dash also stands for a blank or nothing. See `vendor_table`.
    """
    return with_table_vendor(docs.select(doc_id, text), patterns, text).select(doc_id, "vendor")
