"""Tables to typed line items, and totals with their back-fill rules."""

from __future__ import annotations

import logging
import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import fence, let, money, normalize_key, normalize_key_text
from .mapping import _by_variant, lookup, rule_variants, with_keys

log = logging.getLogger(__name__)

#: Columns that every line has, with their types; rules may add more.
COLUMNS = {"description": "string", "qty": "double", "unit_price": "double", "amount": "double",
           "tax_rate": "double", "delivery_date": "string"}


def line_columns(variants: list) -> dict[str, str]:
    """Column -> type: the fixed ones, then every header target and default of the rules. A column
    is a number if some rule's default for it is one."""
    columns = dict(COLUMNS)
    for _, _, rule in variants:
        own = rule.get("lines") or {}
        for name in [*own.get("headers", {}), *own.get("defaults", {})]:
            columns.setdefault(name, "string")
        for name, value in own.get("defaults", {}).items():
            if isinstance(value, (int, float)) and not isinstance(value, bool) and name not in COLUMNS:
                columns[name] = "double"
    return columns


def line_schema(columns: dict[str, str]) -> str:
    fields = ",".join(f"`{n}`:{t}" for n, t in columns.items())
    return f"array<struct<{fields},unparsed:map<string,string>>>"


LINE_SCHEMA = line_schema(COLUMNS)


def header_dictionary(headers: dict[str, list[str]]) -> dict[str, str]:
    """Normalized header -> target; a header listed for two targets goes to the later one."""
    out: dict[str, str] = {}
    for target, names in headers.items():
        out.update((normalize_key_text(n), target) for n in names)
    return out


def map_headers(header_row: Column, headers: dict[str, list[str]]) -> Column:
    """Target of every header cell, null where the header is unknown."""
    pairs = header_dictionary(headers)
    literal = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.transform(header_row, lambda h: F.try_element_at(literal, normalize_key(h)))


def is_data_row(row: Column) -> Column:
    """At least two cells that are not blank."""
    return F.size(F.filter(row, lambda c: c.rlike(r"(?U)\S"))) >= 2


def _raw_line(row: Column, header: Column, names: list[str]) -> Column:
    """Text of each target. Of several columns for one target the last non-empty cell counts."""

    def cells(zipped: Column) -> Column:
        def cell(target: str) -> Column:
            hits = F.filter(zipped, lambda z: (z["h"] == target) & (z["c"] != ""))
            return F.try_element_at(hits, F.lit(-1))["c"]

        return F.struct(*[cell(t).alias(t) for t in names])

    return let(F.arrays_zip(header.alias("h"), row.alias("c")), cells)


def _typed_line(raw: Column, n: Column, columns: dict[str, str], named: set[str], defaults: dict) -> Column:
    """Line from its texts and parsed numbers; unreadable numbers stay as text in `unparsed`. A
    default stands in for a cell that is missing or empty, not for one that is unreadable."""
    failed = [
        F.when(raw[f].isNotNull() & n[f].isNull(),
               F.struct(F.lit(f).alias("key"), raw[f].alias("value")))
        for f, kind in columns.items() if kind == "double" and f in named
    ]

    def value(name: str, kind: str) -> Column:
        default = F.lit(defaults.get(name)).cast(kind)
        if name not in named:
            return default
        return F.when(raw[name].isNull(), default).otherwise(n[name] if kind == "double" else raw[name])

    return F.struct(
        *[value(name, kind).alias(name) for name, kind in columns.items()],
        F.map_from_entries(F.array_compact(F.array(*failed)) if failed else F.array().cast(_PAIRS)).alias("unparsed"),
    )


_PAIRS = "array<struct<key:string,value:string>>"


def line_items(tables: Column, lines_rule: dict, columns: dict[str, str] | None = None) -> Column:
    """Lines of every table that has a header row and data below it."""
    columns = line_columns([(None, None, {"lines": lines_rule})]) if columns is None else columns
    headers = lines_rule.get("headers", {})
    names = [c for c in columns if c in headers]
    numbers = [c for c in names if columns[c] == "double"]

    def raw_of_table(t: Column) -> Column:
        body = F.filter(F.slice(t["rows"], F.lit(2), F.size(t["rows"])), is_data_row)
        header = map_headers(F.get(t["rows"], 0), headers)
        return let(header, lambda h: F.transform(body, lambda row: _raw_line(row, h, names)))

    def parsed(r: Column) -> Column:
        read = [money(r[f]).alias(f) for f in numbers] or [F.lit(None).cast("double").alias("none")]
        return F.struct(r.alias("raw"), F.struct(*read).alias("n"))

    wide = F.filter(tables, lambda t: F.size(t["rows"]) >= 2)
    raw = F.flatten(F.transform(wide, raw_of_table))
    defaults = lines_rule.get("defaults", {})
    return F.transform(F.transform(raw, parsed), lambda p: _typed_line(
        p["raw"], p["n"], columns, set(names), defaults)).cast(line_schema(columns))


def with_lines(df: DataFrame, variants: list | None = None) -> DataFrame:
    variants = rule_variants() if variants is None else variants
    columns = line_columns(variants)
    none = F.array().cast(line_schema(columns))
    built = _by_variant(
        [(d, v, r.get("lines")) for d, v, r in variants],
        lambda rule: line_items(F.col("tables"), rule, columns) if rule and rule.get("headers") else None, none)
    return df.withColumn("lines", fence(F.coalesce(built, none)))


def with_totals(df: DataFrame) -> DataFrame:
    """Add totals from the fixed synonyms; an unreadable amount leaves its total out."""
    staged = df if "_all_norm" in df.columns else with_keys(df)
    names = list(rules.TOTAL_SYNONYMS)
    return (
        staged.withColumns({f"_x_{t}": lookup(s) for t, s in rules.TOTAL_SYNONYMS.items()})
        .withColumns({f"_x_{t}": money(F.col(f"_x_{t}.value")) for t in names})
        .withColumn("totals", F.struct(*[F.col(f"_x_{t}").alias(t) for t in names]))
        .drop(*[f"_x_{t}" for t in names])
    )


#: What a rule may divide: names, numbers, calls without inner brackets, bracketed terms.
_OPERAND = r"(?:[\w.]*\([^()/%]*\)|[\w.]+)"
_SAFE_FORMS = ("cast", "to_date", "to_timestamp", "to_number", "element_at", "make_date", "make_timestamp")


def safe_expression(text: str) -> str | None:
    """The SQL expression with forms that give null where the plain ones raise an error; None if it
    has one that is not known to have such a form, or is no expression."""
    for name in _SAFE_FORMS:
        text = re.sub(rf"(?i)(?<![\w.]){name}\s*\(", f"try_{name}(", text)
    text = re.sub(r"(?i)\s+div\s+", " // ", text)
    found = re.compile(rf"({_OPERAND})\s*(//|/|%)\s*({_OPERAND})")
    functions = {"/": "try_divide(%s, %s)", "%": "try_mod(%s, %s)", "//": "cast(floor(try_divide(%s, %s)) as bigint)"}
    held: list[str] = []
    # What has been rewritten is set aside under a name, so that it can be an operand in turn.
    while match := found.search(text):
        held.append(functions[match[2]] % (match[1], match[3]))
        text = f"{text[:match.start()]}held_{len(held) - 1}_{text[match.end():]}"
    for i in reversed(range(len(held))):
        text = text.replace(f"held_{i}_", held[i])
    refused = re.search(r"(?i)(?<!\w)(?:assert_true|raise_error|date\s*'|timestamp\s*')", text)
    if re.search(r"[/%;]", re.sub(r"'[^']*'", "", text)) or refused:
        return None
    try:
        F.expr(text)
    except PySparkException:
        return None
    return text


def with_post_compute(df: DataFrame, variants: list | None = None) -> DataFrame:
    """Run the back-fill rules in order, those of the vendor's layer included. Conditions and values
    are SQL expressions over `totals`; an assignment sees the assignments before it, the
    condition does not. A rule that can not be made free of run-time errors is skipped with a
    warning; one that fails for a row leaves that row's totals as they are."""
    variants = rule_variants() if variants is None else variants
    which = _by_variant([(d, v, i) for i, (d, v, _) in enumerate(variants)], F.lit, F.lit(-1))
    lists = [r.get("post_compute", []) for _, _, r in variants]
    steps: list[tuple[list[int], dict]] = []
    for i, own in enumerate(lists):
        for at, rule in enumerate(own):
            shared = [j for j, o in enumerate(lists) if at < len(o) and o[at] == rule]
            if i == shared[0]:
                steps.append((shared, rule))
    fields = {f.name for f in df.schema["totals"].dataType}
    staged = df if "vendor" in df.columns else df.withColumn("vendor", F.lit(None).cast("string"))
    out = staged.withColumn("_variant", which)
    for shared, rule in steps:
        forms = [safe_expression(rule["when"]), *[safe_expression(value) for _, value in rule["set"]]]
        try:
            if None in forms or any(target not in fields for target, _ in rule["set"]):
                raise ValueError("a form that may fail, or an unknown target")
            staged.select(*[F.expr(form) for form in forms])
        except (ValueError, PySparkException) as exc:
            log.warning("post-compute rule %r skipped: %s", rule, exc)
            continue
        applies = F.col("_variant").isin(shared) & F.expr(forms[0])
        out = out.withColumn("_on", F.coalesce(applies, F.lit(False)))
        for (target, _), form in zip(rule["set"], forms[1:]):
            value = F.expr(form).try_cast("double")
            changed = F.col("totals").withField(target, F.coalesce(value, F.col(f"totals.{target}")))
            out = out.withColumn("totals", F.when(F.col("_on"), changed).otherwise(F.col("totals")))
    return out.drop("_on", "_variant", *({"vendor"} - set(df.columns)))


# Long form --------------------------------------------------------------------------------


def line_sums(lines: DataFrame, key: str, amount: str) -> DataFrame:
    """Exact line total per document for lines kept as rows; partial sums leave the map side,
    so a document with very many lines is no burden on one task. Amounts that are no number of
    at most 26 digits before the point are counted in `unread_count`, not summed; a sum beyond 36
    digits is null."""
    value = F.col(amount).try_cast("decimal(28,2)")
    return lines.groupBy(key).agg(
        F.try_sum(value).alias("line_total"),
        F.count("*").alias("line_count"),
        F.count_if(F.col(amount).isNotNull() & value.isNull()).alias("unread_count"),
    )


def store_by_document(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Headers or lines as a table in buckets of their document, sorted by it. Sums and joins by document on
    tables of as many buckets read them where they lie, without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def stated_and_summed(headers: DataFrame, lines: DataFrame, key: str, line_key: str, amount: str) -> DataFrame:
    """`headers` with line_total, line_count and unread_count of their lines."""
    sums = line_sums(lines, line_key, amount)
    return headers.join(sums, headers[key] == sums[line_key], "left").select(
        *headers.columns, "line_total", "line_count", "unread_count")
