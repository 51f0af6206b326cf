"""Checks on canonical documents. Each check is an array column of (code, path, message),
so a document of any quality stays one row and no check can fail the job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.dates import iso_date
from ..functions.text import fence, listed, truthy
from .mapping import lookup, rule_variants, with_keys

ERRORS = "array<struct<code:string,path:string,message:string>>"


def error(code: str, path: str | Column, message: str | Column) -> Column:
    def text(v):
        return v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(code).alias("code"), text(path).alias("path"), text(message).alias("message"))


def collect(checks: Iterable[tuple[Column, Column]]) -> Column:
    """Errors whose condition holds, in the given order."""
    return listed(list(checks), ERRORS)


def nested(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """Column and type at a dotted path; a null literal where the schema has no such path."""
    dtype: T.DataType = schema
    for part in path.split("."):
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            return F.lit(None).cast("string"), T.StringType()
        dtype = dtype[part].dataType
    return F.col(path), dtype


def _kind(dtype: T.DataType) -> str:
    return "double" if isinstance(dtype, T.NumericType) else "string"


def _is_null_key(name: str) -> Column:
    return F.array_contains("null_targets", name)


# Schema -----------------------------------------------------------------------------------


def schema_errors(schema: T.StructType, spec: dict, first_only: bool = False) -> Column:
    """Violations of type, const, pattern and required, the shallowest paths first."""
    required, values = [], []
    for part in ("doc", "totals"):
        rule = spec["properties"][part]
        for name in rule.get("required", []):
            col, dtype = nested(schema, f"{part}.{name}")
            required.append((
                col.isNull() & ~_is_null_key(name),
                error("schema_required", part, f"'{name}' is a required property"),
            ))
        for name, want in rule["properties"].items():
            path = f"{part}.{name}"
            col, dtype = nested(schema, path)
            kind = "number" if isinstance(dtype, T.NumericType) else "string"
            wrong = col.isNotNull() if want.get("type", kind) != kind else F.lit(False)
            if part == "doc":
                wrong = wrong | _is_null_key(name)
            values.append((wrong, error("schema_type", path, f"not of type {want.get('type', kind)}")))
            if "const" in want:
                values.append((col != want["const"], error("schema_const", path, "not the constant")))
            if "pattern" in want:
                values.append((~col.rlike(want["pattern"]),
                               error("schema_pattern", path, "does not match the pattern")))
    item_types = spec["properties"]["lines"]["items"]["properties"]
    numbers = [n for n, want in item_types.items() if want["type"] == "number"]
    lines = F.flatten(F.transform(F.col("lines"), lambda line, i: F.transform(
        F.filter(F.array(*[F.lit(n) for n in numbers]),
                 lambda n: F.map_contains_key(line["unparsed"], n)),
        lambda n: error("schema_type", F.concat(F.lit("lines."), i.cast("string"), F.lit("."), n),
                        "not of type number"),
    )))
    out = F.concat(collect(required), collect(values), lines)
    return F.slice(out, 1, 1) if first_only else out


# Coded business checks --------------------------------------------------------------------


def amount_errors(schema: T.StructType, limits: dict) -> Column:
    sub, tax, total = (F.col(f"totals.{n}") for n in ("subtotal", "tax", "grand_total"))
    known = truthy(sub, "double") & truthy(tax, "double") & truthy(total, "double")
    lines = line_total()
    return collect([
        (known & (F.abs(sub + tax - total) > limits["tolerance"]),
         error("amount_mismatch", "totals.grand_total", "subtotal and tax do not give the total")),
        ((lines != 0) & truthy(sub, "double") & (F.abs(lines - sub) > limits["line_tolerance"]),
         error("line_total_mismatch", "totals.subtotal", "the lines do not give the subtotal")),
    ])


def line_total() -> Column:
    """Sum of the line amounts that are numbers."""
    return F.aggregate(
        F.col("lines"), F.lit(0.0), lambda acc, line: acc + F.coalesce(line["amount"], F.lit(0.0)))


def date_errors(schema: T.StructType, limits: dict) -> Column:
    issue, due = (nested(schema, f"doc.{n}")[0] for n in ("issue_date", "due_date"))
    both = truthy(issue) & truthy(due)
    first, last = iso_date(issue), iso_date(due)
    return collect([
        (both & (first.isNull() | last.isNull()),
         error("invalid_date", "doc.due_date", "not a date")),
        (both & (last < first), error("due_before_issue", "doc.due_date", "due before issue")),
        (both & (F.datediff(last, first) > limits["max_payment_terms"]),
         error("payment_terms_exceeded", "doc.due_date", "payment term too long")),
    ])


def required_errors(schema: T.StructType, paths: list[str]) -> Column:
    out = []
    for path in paths:
        col, dtype = nested(schema, path)
        out.append((~truthy(col, _kind(dtype)), error("required_missing", path, "missing")))
    return collect(out)


def constraint_errors(schema: T.StructType, constraints: dict[str, dict]) -> Column:
    out = []
    for path, rule in constraints.items():
        col, dtype = nested(schema, path)
        number = isinstance(dtype, T.NumericType)
        text = col.cast("string")
        size = F.length(text)
        if "min_length" in rule:
            out.append((size < rule["min_length"], error("too_short", path, "too short")))
        if "max_length" in rule:
            out.append((size > rule["max_length"], error("too_long", path, "too long")))
        if "pattern" in rule:
            out.append((~text.rlike("^(?:" + rule["pattern"] + ")"),
                        error("pattern", path, "does not match the pattern")))
        if "min_value" in rule and number:
            out.append((col < rule["min_value"], error("below_minimum", path, "below the minimum")))
        if "max_value" in rule and number:
            out.append((col > rule["max_value"], error("above_maximum", path, "above the maximum")))
    return collect(out)


def format_errors(schema: T.StructType) -> Column:
    """Currency, number and date formats. A key present with null ends this check with a
    system error, as its text cannot be matched."""
    currency, number = (nested(schema, f"doc.{n}")[0] for n in ("currency", "document_no"))
    checks = [
        (~currency.rlike(r"^[A-Z]{3}$"), error("format_currency", "doc.currency", "no currency code")),
        (F.length(number) > 50, error("format_document_no", "doc.document_no", "too long")),
    ]
    for name in ("issue_date", "due_date"):
        col = nested(schema, f"doc.{name}")[0]
        checks.append((~col.rlike(r"^\d{4}-\d{2}-\d{2}$"),
                       error("format_date", f"doc.{name}", "not YYYY-MM-DD")))
    null_key = F.arrays_overlap(
        F.col("null_targets"),
        F.array(*[F.lit(n) for n in ("currency", "document_no", "issue_date", "due_date")]))
    return F.when(null_key, F.array(error("system_error", "doc", "null value"))).otherwise(collect(checks))


# Declared checks --------------------------------------------------------------------------


def currency_errors(schema: T.StructType, allowed: list[str]) -> Column:
    col = nested(schema, "doc.currency")[0]
    return collect([(~col.isin(allowed), error("currency_not_allowed", "doc.currency", "not allowed"))])


def future_date_errors(schema: T.StructType, limits: dict, today: Column) -> Column:
    issue = iso_date(nested(schema, "doc.issue_date")[0])
    days = limits["max_future_days"] if limits["allow_future"] else 0
    return collect([(issue > F.date_add(today, days),
                     error("future_date", "doc.issue_date", "in the future"))])


def confidence_errors(gates: dict, variants: list | None = None) -> Column:
    """Field, document and critical-field gates. Needs `conf`, `confidence` and the key
    columns of `with_keys` over `conf_entries`."""
    variants = rule_variants() if variants is None else variants
    low = F.transform(
        F.filter(F.col("conf_entries"), lambda e: e["score"] < gates["field"]),
        lambda e: error("low_field_confidence", e["key"], "below the field threshold"),
    )
    document = collect([(F.col("confidence") < gates["document"],
                         error("low_document_confidence", "doc", "below the document threshold"))])
    critical = []
    for target in gates["critical_fields"]:
        sources = list(dict.fromkeys(
            s for _, _, r in variants for s in r["mappings"].get(target, {}).get("from", [])))
        critical.append((
            lookup(sources + [target], "conf_entries")["score"] < gates["critical"],
            error("low_critical_confidence", target, "below the threshold for critical fields"),
        ))
    return F.concat(low, document, collect(critical))


def with_confidence_errors(df: DataFrame, gates: dict | None = None) -> DataFrame:
    gates = rules.VALIDATION["confidence"] if gates is None else gates
    entries = F.transform(F.map_entries("conf"), lambda e: F.struct(
        e["key"].alias("key"), e["value"].alias("score")))
    keys = ("_lower", "_norm", "_all_norm")
    staged = with_keys(df.drop(*keys).withColumn("conf_entries", entries), "conf_entries")
    return staged.withColumn("confidence_errors", confidence_errors(gates)).drop("conf_entries", *keys)


def business_errors(schema: T.StructType, conditions: dict, today: Column) -> Column:
    """SQL conditions per document type over the document and issue_day, delivery_day, today,
    which `with_days` provides."""
    out = []
    for doc_type, own in conditions.items():
        for name, path, condition in own:
            out.append(((F.col("doc_type") == doc_type) & ~F.expr(condition),
                        error(name, path, "business rule violated")))
    return collect(out)


def with_days(df: DataFrame, run_date: str) -> DataFrame:
    schema = df.schema
    return df.withColumns({
        "issue_day": iso_date(nested(schema, "doc.issue_date")[0]),
        "delivery_day": iso_date(nested(schema, "doc.delivery_date")[0]),
        "today": F.lit(run_date).cast("date"),
    })


def range_errors(schema: T.StructType, r: dict, today: Column) -> Column:
    """Documented ranges: amounts, dates, lengths, tax rates, payment days, number formats."""
    out = []
    for path, (low, high) in r["numeric"].items():
        col = nested(schema, path)[0]
        out.append(((col < low) | (col > high), error("range_numeric", path, "out of range")))
    low, high = r["tax_rate"]
    out.append((
        F.exists("lines", lambda x: (x["tax_rate"] < low) | (x["tax_rate"] > high)),
        error("range_tax_rate", "lines.tax_rate", "out of range"),
    ))
    issue, due = (iso_date(nested(schema, f"doc.{n}")[0]) for n in ("issue_date", "due_date"))
    out.append((
        (issue < F.lit(r["issue_min"]).cast("date"))
        | (issue > F.add_months(today, 12 * r["issue_max_years"])),
        error("range_issue_date", "doc.issue_date", "out of range"),
    ))
    out.append((
        (due < issue) | (due > F.add_months(today, 12 * r["due_max_years"])),
        error("range_due_date", "doc.due_date", "out of range"),
    ))
    for path, (low, high) in r["lengths"].items():
        size = F.length(nested(schema, path)[0])
        out.append(((size < low) | (size > high), error("range_length", path, "out of range")))
    sub, tax = F.col("totals.subtotal"), F.col("totals.tax")
    nearest = F.least(*[F.abs(tax - sub * F.lit(rate)) for rate in r["tax_rates"]])
    out.append((nearest > r["tax_tolerance"], error("tax_rate", "totals.tax", "not a valid rate")))
    out.append((
        ~F.datediff(due, issue).isin(r["payment_days"]),
        error("payment_days", "doc.due_date", "not a usual payment term"),
    ))
    number = nested(schema, "doc.document_no")[0]
    for doc_type, pattern in r["document_no"].items():
        out.append((
            (F.col("doc_type") == doc_type) & ~number.rlike(pattern),
            error("document_no_pattern", "doc.document_no", "not the form for its type"),
        ))
    return collect(out)


#: Names of the declared checks that a verdict can cover.
DECLARED = ("currency", "future_dates", "confidence", "business", "ranges")


def with_declared_errors(df: DataFrame, v: dict, names: Iterable[str], check_date: str | None) -> DataFrame:
    """Add `_declared`, the errors of the named checks in the order of DECLARED."""
    names = set(names)
    unknown = names - set(DECLARED)
    if unknown:
        raise ValueError(f"no such checks: {sorted(unknown)}")
    if check_date is None and names & {"future_dates", "business", "ranges"}:
        raise ValueError("checks on dates need check_date")
    s, today = df.schema, F.lit(check_date).cast("date")
    build = {
        "currency": lambda: currency_errors(s, v["allowed_currencies"]),
        "future_dates": lambda: future_date_errors(s, v["dates"], today),
        "confidence": lambda: F.col("confidence_errors"),
        "business": lambda: business_errors(s, v["business"], today),
        "ranges": lambda: range_errors(s, v["ranges"], today),
    }
    staged = with_days(df, check_date) if "business" in names else df
    if "confidence" in names:
        staged = with_confidence_errors(staged, v["confidence"])
    found = [build[name]().cast(ERRORS) for name in DECLARED if name in names]
    staged = staged.withColumn("_declared", F.concat(*found) if found else F.array().cast(ERRORS))
    return staged.drop(*({"issue_day", "delivery_day", "today", "confidence_errors"} - set(df.columns)))


# Verdict ----------------------------------------------------------------------------------


def _by_type(build, per_type: dict) -> Column:
    out = F.array().cast(ERRORS)
    for doc_type, own in reversed(list(per_type.items())):
        out = F.when(F.col("doc_type") == doc_type, build(own)).otherwise(out)
    return out


def with_validation(df: DataFrame, v: dict | None = None, first_only: bool = False,
                    declared: Iterable[str] = (), check_date: str | None = None) -> DataFrame:
    """Add `errors` in the order schema, amounts, dates, required, constraints, duplicate,
    formats, the `declared` checks asked for, and `is_valid`. A boolean column `is_duplicate`, if
    there, is part of it."""
    v = rules.VALIDATION if v is None else v
    s = df.schema
    staged = with_declared_errors(df, v, declared, check_date).withColumns({
        "_schema": _by_type(lambda spec: schema_errors(s, spec, first_only), rules.CDM_SCHEMA),
        "_amounts": amount_errors(s, v["amounts"]),
        "_dates": date_errors(s, v["dates"]),
        "_required": _by_type(lambda paths: required_errors(s, paths), v["required"]),
        "_constraints": constraint_errors(s, v["constraints"]),
        "_formats": format_errors(s),
    })
    duplicate = F.array().cast(ERRORS)
    if "is_duplicate" in df.columns:
        duplicate = collect([(F.col("is_duplicate"), error("duplicate", "doc", "duplicate document"))])
    coded = F.concat(
        *[F.col(c) for c in ("_schema", "_amounts", "_dates", "_required", "_constraints")],
        duplicate, F.col("_formats"), F.coalesce("_declared", F.array().cast(ERRORS)),
    ).cast(ERRORS)
    stopped = (
        F.when(~F.col("extracted"), F.array(error("extract_failed", "doc", "unreadable payload")))
        .when(F.col("doc_type").isNull(), F.array(error("classify_failed", "doc", "no document type")))
    )
    return (
        staged.withColumn("errors", fence(F.coalesce(stopped, coded)))
        .withColumn("is_valid", F.size("errors") == 0)
        .drop("_schema", "_amounts", "_dates", "_required", "_constraints", "_formats", "_declared")
    )


def error_codes(errors: str = "errors") -> Column:
    """Error codes with their paths as one text, in order."""
    return F.array_join(F.transform(errors, lambda e: F.concat_ws(":", e["code"], e["path"])), ",")
