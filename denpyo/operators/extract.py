"""Analysis payload (JSON text) to the raw extraction: entries, confidence, tables, text.

A document is one row before and after, and every step is an expression over its own arrays
and maps, so nothing is shuffled. Arrays keep the order of the payload, which later decides
which key wins. Only nested values, which may be of any depth, are unfolded by a small Arrow
function, and only payloads that name such a value are handed to it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fence, let, plain_number_text

# A field is a map, not a struct, because a key that is present with null beats later keys.
PAYLOAD_SCHEMA = """
    analyzeResult STRUCT<
        documents: ARRAY<STRUCT<fields: MAP<STRING, {field}>>>,
        tables: ARRAY<STRUCT<rowCount: DOUBLE, columnCount: DOUBLE,
                             cells: ARRAY<STRUCT<rowIndex: DOUBLE, columnIndex: DOUBLE, content: STRING>>>>,
        keyValuePairs: ARRAY<STRUCT<key: STRUCT<content: STRING>, value: STRUCT<content: STRING>>>,
        content: STRING>,
    _corrupt STRING
"""

# Typed variants of a field, the first one present decides.
SCALAR_VARIANTS = ["content", "valueString", "valueNumber", "valueDate"]
NESTED_VARIANTS = ["valueObject", "valueArray"]

_FIELD = "MAP<STRING, STRING>"


def _parsed(c: Column, field: str) -> Column:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return F.from_json(c, PAYLOAD_SCHEMA.format(field=field), options)


def parse_payload(c: Column) -> Column:
    """Payload struct; `_corrupt` holds the text where it is no such JSON.

    A field that is no object makes the whole text unfit for the schema. Such texts are read
    again with every field as text of its own, and the field is left out.
    """
    def again(slow: Column) -> Column:
        result = slow["analyzeResult"]
        documents = F.transform(result["documents"], lambda d: F.struct(F.map_filter(
            F.transform_values(d["fields"], lambda k, v: F.from_json(v, _FIELD)),
            lambda k, v: v.isNotNull()).alias("fields")))
        return F.struct(result.withField("documents", documents).alias("analyzeResult"), slow["_corrupt"].alias("_corrupt"))

    return let(_parsed(c, _FIELD), lambda fast: F.when(fast["_corrupt"].isNull(), fast).otherwise(
        let(_parsed(c, "STRING"), again)))


def _named_value(field) -> bool:
    return isinstance(field, dict) and any(v in field for v in SCALAR_VARIANTS + NESTED_VARIANTS)


def _plain(field: dict):
    """Value of a field of a parsed payload, objects and arrays unfolded all the way down."""
    for variant in SCALAR_VARIANTS:
        if variant in field:
            return field[variant]
    if "valueObject" in field:
        return _object(field["valueObject"])
    items = field["valueArray"]
    return [_object(x) if isinstance(x, dict) else x for x in items] if isinstance(items, list) else items


def _object(fields) -> dict:
    if not isinstance(fields, dict):
        return {}
    return {name: _plain(field) for name, field in fields.items() if _named_value(field)}


def _nested_values(payload: str | None) -> dict[str, str] | None:
    """Field -> JSON text of the first document's fields whose value is nested."""
    try:
        fields = json.loads(payload)["analyzeResult"]["documents"][0]["fields"]
        out = {}
        for name, field in fields.items():
            if _named_value(field) and not any(v in field for v in SCALAR_VARIANTS):
                value = _plain(field)
                if value is not None:
                    out[name] = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return out
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
        return None  # no such payload: parse_payload says so


def nested_values(payload: Column) -> Column:
    """Field -> JSON text of its nested value; null for payloads that name none."""
    @F.pandas_udf("map<string,string>")
    def unfold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _nested_values(t))

    named = [payload.contains(f'"{v}"') for v in NESTED_VARIANTS]
    return unfold(F.when(named[0] | named[1], payload))


def typed_value(field: Column, nested: Column) -> Column:
    """Value of one field; objects and arrays as JSON text, numbers without an exponent."""
    value = nested
    for variant in reversed(SCALAR_VARIANTS):
        text = field[variant]
        if variant == "valueNumber":
            # The JSON reader writes large and small numbers with an exponent.
            text = let(text, lambda t: F.when(
                t.rlike("[eE]"), F.coalesce(plain_number_text(t.try_cast("double")), t)).otherwise(t))
        value = F.when(F.map_contains_key(field, variant), text).otherwise(value)
    return value


def _last_wins(entries: Column) -> Column:
    """One entry per key at the place of its first, with the value of its last occurrence."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    merged = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
    return F.when(F.size(keys) == F.size(entries), entries).otherwise(merged)


def last_keys(pairs: Column) -> Column:
    """The map with one entry per key, the last of each; maps without repeats as they are."""
    return F.when(
        F.size(F.array_distinct(F.map_keys(pairs))) == F.size(F.map_keys(pairs)), pairs,
    ).otherwise(F.map_from_entries(_last_wins(F.map_entries(pairs))))


def field_entries(fields: Column, nested: Column) -> Column:
    """(key, value) in payload order for every field that has one of the variants."""
    known = F.array(*[F.lit(v) for v in SCALAR_VARIANTS + NESTED_VARIANTS])

    return F.transform(
        F.filter(F.map_entries(fields), lambda e: F.arrays_overlap(F.map_keys(e["value"]), known)),
        lambda e: F.struct(
            e["key"].alias("key"), typed_value(e["value"], F.try_element_at(nested, e["key"])).alias("value")),
    )


def field_confidence(fields: Column) -> Column:
    """Key -> confidence for the top-level fields that state one."""
    stated = F.map_filter(fields, lambda k, v: F.map_contains_key(v, "confidence"))
    return F.transform_values(stated, lambda k, v: v["confidence"].try_cast("double"))


def pair_entries(pairs: Column) -> Column:
    """(key, value) of the key/value pairs whose key and value are both non-empty."""
    flat = F.transform(pairs, lambda p: F.struct(
        p["key"]["content"].alias("key"), p["value"]["content"].alias("value")))
    return F.filter(flat, lambda e: (e["key"] != "") & (e["value"] != ""))


def merge_entries(fields: Column, pairs: Column) -> Column:
    """Fields then pairs; a pair overrides a field of the same key and keeps its place.

    Both inputs hold distinct keys. Result: (key, value, source, field_value).
    """

    def joined(pair_map: Column) -> Column:
        return F.transform(fields, lambda e: F.struct(
            e["key"].alias("key"),
            F.coalesce(F.try_element_at(pair_map, e["key"]), e["value"]).alias("value"),
            F.lit("fields").alias("source"),
            e["value"].alias("field_value"),
        ))

    def added(field_keys: Column) -> Column:
        return F.transform(
            F.filter(pairs, lambda e: ~F.array_contains(field_keys, e["key"])),
            lambda e: F.struct(
                e["key"].alias("key"), e["value"].alias("value"),
                F.lit("key_value_pairs").alias("source"),
                F.lit(None).cast("string").alias("field_value"),
            ),
        )

    return F.concat(
        let(F.map_from_entries(pairs), joined),
        let(F.transform(fields, lambda e: e["key"]), added),
    )


def table_rows(cells: Column, by_column_index: bool = False) -> Column:
    """Cells to rows: a new row starts where the row index differs from the cell before.

    Spans and gaps are not filled unless `by_column_index`, which places each cell at its
    column.
    """
    def starts_of(index: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(index) - 1),
            lambda i: (i == 0) | (F.get(index, i) != F.get(index, i - 1)),
        )

    def rows_of(starts: Column) -> Column:
        def row(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(cells))
            part = F.slice(cells, start + 1, end - start)
            return place(part) if by_column_index else texts(part)

        return F.transform(starts, row)

    def texts(part: Column) -> Column:
        return F.transform(part, lambda c: F.coalesce(c["content"], F.lit("")))

    def place(part: Column) -> Column:
        columns = F.transform(part, lambda c: F.coalesce(c["columnIndex"].cast("int"), F.lit(0)))
        return let(columns, lambda column: F.transform(
            F.sequence(F.lit(0), F.array_max(column)),
            lambda j: F.coalesce(
                F.get(texts(part), F.array_position(column, j).cast("int") - 1), F.lit("")),
        ))

    index = F.transform(cells, lambda c: F.coalesce(c["rowIndex"].cast("int"), F.lit(0)))
    built = let(index, lambda ix: let(starts_of(ix), rows_of))
    return F.when(F.size(cells) > 0, built)


def extract_tables(tables: Column, by_column_index: bool = False) -> Column:
    """Tables with at least one row; counts default to what the cells show."""
    built = F.transform(tables, lambda t: F.struct(
        table_rows(t["cells"], by_column_index).alias("rows"),
        t["rowCount"].cast("int").alias("row_count"), t["columnCount"].cast("int").alias("column_count")))
    return F.transform(
        F.filter(built, lambda t: F.size(t["rows"]) > 0),
        lambda t: F.struct(
            t["rows"].alias("rows"),
            F.coalesce(t["row_count"], F.size(t["rows"])).alias("row_count"),
            F.coalesce(
                t["column_count"], F.array_max(F.transform(t["rows"], F.size))
            ).alias("column_count"),
        ),
    )


_NO_PAIRS = "array<struct<key:string,value:string>>"
_NO_TABLES = "array<struct<rows:array<array<string>>,row_count:int,column_count:int>>"


def with_extraction(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add entries, conf, tables, raw_text and extracted (false for unreadable JSON)."""
    # Unfolded first, while a row is no more than its payload.
    staged = df.withColumn("_nested", nested_values(F.col(payload)))
    parsed = staged.withColumn("_p", parse_payload(F.col(payload)))
    result = F.col("_p.analyzeResult")
    return (
        parsed.withColumns({
            # Only the first document of a payload counts.
            "_fields": F.get(result["documents"], 0)["fields"],
            "_kv": result["keyValuePairs"],
        })
        .withColumn("_fields", F.transform_values(last_keys(F.col("_fields")), lambda k, v: last_keys(v)))
        .withColumns({
            "_field_entries": F.coalesce(
                field_entries(F.col("_fields"), F.col("_nested")), F.array().cast(_NO_PAIRS)),
            "_pair_entries": F.coalesce(pair_entries(F.col("_kv")), F.array().cast(_NO_PAIRS)),
        })
        .withColumn("_pair_entries", _last_wins(F.col("_pair_entries")))
        .withColumns({
            "entries": fence(merge_entries(F.col("_field_entries"), F.col("_pair_entries"))),
            "conf": F.coalesce(field_confidence(F.col("_fields")),
                               F.create_map().cast("map<string,double>")),
            "tables": fence(
                F.coalesce(extract_tables(result["tables"]), F.array().cast(_NO_TABLES))),
            "raw_text": fence(F.coalesce(result["content"], F.lit(""))),
            "extracted": fence(result.isNotNull() & F.col("_p._corrupt").isNull()),
        })
        .drop("_p", "_nested", "_fields", "_kv", "_field_entries", "_pair_entries")
    )
