"""Registered queries, each with the SQL that gives the same rows over the source tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from denpyo import rules
from denpyo.functions import dates, text
from denpyo.functions.transforms import apply_chain, chain_text, register_transform
from denpyo.operators import (
    classify, duplicates, extract, lines, mapping, monitor, resolve, skew, text_fields, validate,
)
from denpyo.sources import files, sinks
from denpyo.streaming import alert, dedup, ingest
from denpyo.plans.normalize import KEY_COLUMNS, normalize_payloads, normalize_texts

from . import render
from .oracles import CDM, FACTS, cdm_errors, wide

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RUN_TS = "2024-02-01T00:00:00"
RUN_DATE = "2000-06-30"


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return keep


# The whole run ------------------------------------------------------------------------------


@query(FACTS + """
SELECT doc_id, CASE WHEN NOT broken THEN doc_type END AS doc_type,
       CASE WHEN has_cdm THEN vendor END AS vendor,
       CASE WHEN has_cdm THEN number END AS document_no,
       CASE WHEN has_cdm THEN strftime(d, '%Y-%m-%d') END AS issue_date,
       CASE WHEN has_cdm AND NOT is_po AND NOT later_empty THEN strftime(later, '%Y-%m-%d') END AS due_date,
       CASE WHEN has_cdm AND is_po AND NOT later_empty THEN strftime(later, '%Y-%m-%d') END AS delivery_date,
       CASE WHEN has_cdm THEN currency END AS currency,
       CASE WHEN has_cdm THEN total::DOUBLE END AS grand_total,
       CASE WHEN has_cdm THEN t_sub END AS total_before_tax,
       CASE WHEN has_cdm THEN t_tax END AS total_tax,
       CASE WHEN has_cdm AND NOT is_po THEN (CASE WHEN k % 10 = 3 THEN 'Client#' ELSE 'Customer#' END)
            || printf('%09d', c) END AS customer_name,
       CASE WHEN has_cdm AND is_po THEN '部署 ' || priority END AS requester,
       CASE WHEN has_cdm THEN 2 END AS line_count,
       errors, (errors = '') AS is_valid
FROM g
""")
def normalize_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize_payloads(render.payload_docs(spark, sf_dir), RUN_TS)
    return out.select(
        "doc_id", "doc_type", "doc.vendor", "doc.document_no", "doc.issue_date", "doc.due_date",
        "doc.delivery_date", "doc.currency", "doc.grand_total",
        F.col("totals.subtotal").alias("total_before_tax"), F.col("totals.tax").alias("total_tax"),
        "doc.customer_name", "doc.requester", F.size("lines").alias("line_count"),
        validate.error_codes().alias("errors"), "is_valid",
    )


@query(FACTS + """
SELECT doc_id, CASE WHEN has_cdm THEN number END AS document_no, errors, errors = '' AS is_valid
FROM g WHERE doc_id >= 'D5' AND doc_id < 'D6'
""")
def normalize_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few documents of a large table: the condition reaches the scan."""
    out = normalize_payloads(
        render.payload_docs(spark, sf_dir), RUN_TS, where="doc_id >= 'D5' AND doc_id < 'D6'")
    return out.select("doc_id", "doc.document_no", validate.error_codes().alias("errors"), "is_valid")


@query(FACTS + f"""
, r AS (SELECT g.*, copy, doc_id || copy AS id FROM g, (SELECT unnest(['', 'b']) AS copy)
        WHERE copy = '' OR k % 41 = 7),
e AS (SELECT r.*, list_sort(list_filter(string_split(errors, ',') || [
    CASE WHEN has_cdm AND copy = 'b' AND vendor IS NOT NULL AND number IS NOT NULL THEN 'duplicate:doc' END,
    CASE WHEN has_cdm AND currency = 'YEN1' THEN 'currency_not_allowed:doc.currency' END,
    CASE WHEN has_cdm AND d > DATE '{RUN_DATE}' THEN 'future_date:doc.issue_date' END,
    CASE WHEN has_cdm AND NOT is_po AND d > DATE '{RUN_DATE}' THEN 'issue_not_after_today:doc.issue_date' END,
    CASE WHEN has_cdm AND NOT is_po AND least(abs(t_tax - t_sub * 0.08::DOUBLE), abs(t_tax - t_sub * 0.1::DOUBLE)) > 1
      THEN 'tax_rate_8_or_10:totals.tax' END,
    CASE WHEN has_cdm AND is_po AND NOT later_empty AND NOT later > d THEN 'delivery_after_issue:doc.delivery_date' END,
    CASE WHEN has_cdm AND is_po AND t_total <= 0 THEN 'total_positive:totals.grand_total' END],
    lambda x: coalesce(x, '') <> '')) AS found FROM r)
SELECT id AS doc_id, array_to_string(found, ',') AS errors, len(found) = 0 AS is_valid,
       CASE WHEN has_cdm AND c % 6 = 0 THEN 'V1' WHEN has_cdm AND c % 6 = 4 THEN 'V2' END AS vendor_id,
       CASE WHEN has_cdm AND NOT is_po AND k % 10 <> 3 THEN printf('C%06d', c_custkey) END AS customer_id
FROM e LEFT JOIN customer ON c_custkey = c
""")
def normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything at once: masters, duplicates and declared checks."""
    vendors = spark.createDataFrame(
        [("株式会社エグザンプル", "V1", None), ("有限会社　山田工務店", "V2", None)],
        "name string, id string, normalized_name string")
    out = normalize_payloads(
        render.repeated_payloads(spark, sf_dir), RUN_TS, vendors=vendors, find_duplicates=True,
        customers=render.customer_master(spark, sf_dir), checks=("currency", "future_dates", "business"),
        check_date=RUN_DATE)
    listed = F.transform("errors", lambda e: F.concat_ws(":", e["code"], e["path"]))
    return out.select("doc_id", F.array_join(F.array_sort(listed), ",").alias("errors"), "is_valid",
                      "doc.vendor_id", "doc.customer_id")


@query(FACTS + """
SELECT doc_id, doc_type, CASE WHEN doc_type IS NOT NULL THEN vendor END AS vendor,
       CASE WHEN doc_type = 'INVOICE' THEN number END AS document_no,
       CASE WHEN doc_type IS NOT NULL THEN strftime(d, '%Y-%m-%d') END AS issue_date,
       CASE WHEN doc_type = 'INVOICE' THEN strftime(later, '%Y-%m-%d') END AS due_date,
       CASE WHEN doc_type IS NOT NULL AND style <> 2 THEN total::DOUBLE END AS grand_total,
       CASE WHEN doc_type IS NULL OR style = 2 THEN NULL WHEN split THEN sub::DOUBLE
            ELSE round_even(total / 1.1::DOUBLE, 0) END AS total_before_tax,
       CASE WHEN doc_type IS NULL OR style = 2 THEN NULL WHEN split THEN tax::DOUBLE
            ELSE total - round_even(total / 1.1::DOUBLE, 0) END AS total_tax,
       CASE WHEN doc_type IS NOT NULL AND c % 6 = 1 THEN '06-9876-5432' END AS vendor_phone
FROM f
""")
def normalize_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize_texts(render.text_docs(spark, sf_dir), RUN_TS)
    return out.select(
        "doc_id", "doc_type", "doc.vendor", "doc.document_no", "doc.issue_date", "doc.due_date",
        "totals.grand_total", F.col("totals.subtotal").alias("total_before_tax"),
        F.col("totals.tax").alias("total_tax"), "doc.vendor_phone",
    )


# Classification -----------------------------------------------------------------------------


@query(FACTS + "SELECT doc_id, doc_type FROM f")
def classify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.with_classification(render.text_docs(spark, sf_dir)).select("doc_id", "doc_type")


@query(FACTS + "SELECT doc_id, round(conf_base + words / 3.0::DOUBLE * 0.2::DOUBLE, 4) AS confidence FROM f")
def classify_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.with_classification(render.text_docs(spark, sf_dir))
    return out.select("doc_id", F.round("confidence", 4).alias("confidence"))


@query(FACTS + "SELECT doc_id, vendor FROM f")
def classify_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.text_docs(spark, sf_dir)
    return docs.select("doc_id", classify.vendor(F.col("raw_text")).alias("vendor"))


@query(FACTS + "SELECT doc_id, CASE WHEN c % 6 IN (0, 4) THEN vendor END AS vendor FROM f")
def vendor_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.text_docs(spark, sf_dir)
    return docs.select("doc_id", classify.first_company(
        F.col("raw_text"), rules.VENDOR_FALLBACK).alias("vendor"))


@query(FACTS + """
SELECT doc_id,
       CASE WHEN k % 31 = 8 THEN 'PURCHASE_ORDER' WHEN unknown THEN 'UNKNOWN'
            WHEN is_po THEN 'PURCHASE_ORDER' ELSE 'INVOICE' END AS simple_type,
       CASE WHEN k % 31 = 8 THEN 'INVOICE' WHEN unknown THEN 'UNKNOWN'
            WHEN is_po THEN 'PURCHASE_ORDER' ELSE 'INVOICE' END AS fixed_type,
       CASE WHEN k % 31 = 8 THEN 0.9::DOUBLE WHEN unknown THEN 0.1::DOUBLE
            WHEN is_po THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS fixed_score,
       CASE c % 6 WHEN 0 THEN '株式会社エグザンプル 本社' WHEN 4 THEN '有限会社　山田工務店'
            ELSE '不明' END AS vendor,
       CASE WHEN c % 6 IN (0, 4) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS vendor_score
FROM f
""")
def classify_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("raw_text")
    fixed_type, fixed_score = classify.fixed_score_type(t)
    vendor, vendor_score = classify.simple_vendor(t)
    return render.text_docs(spark, sf_dir).select(
        "doc_id", classify.simple_type(t).alias("simple_type"), fixed_type.alias("fixed_type"),
        fixed_score.alias("fixed_score"), vendor.alias("vendor"), vendor_score.alias("vendor_score"))


@query("""
SELECT 'D' || o_orderkey AS doc_id, s_name AS vendor
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey // 10 AND o_orderkey % 8 <> 0
""")
def vendor_master_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = render.table(spark, sf_dir, "supplier")
    patterns = s.select(
        F.col("s_suppkey").alias("vendor_ord"), F.lit(0).alias("pat_ord"),
        F.col("s_name").alias("vendor"), F.col("s_name").alias("pattern"))
    return classify.match_vendor_master(render.supplier_texts(spark, sf_dir), patterns)


_LISTED = [
    (rank, order, vendor, pattern, kind)
    for rank, (vendor, kinds) in enumerate(rules.VENDOR_PATTERNS.items()) if isinstance(kinds, dict)
    for order, (kind, pattern) in enumerate((k, p) for k, ps in kinds.items() for p in ps)
]


def _vendor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured patterns, and behind them a pattern for every supplier."""
    s = render.table(spark, sf_dir, "supplier")
    listed = spark.createDataFrame(_LISTED, "vendor_ord long, pat_ord long, vendor string, pattern string, kind string")
    return listed.union(s.select((F.col("s_suppkey") + 1_000_000).cast("long"), F.lit(0).cast("long"), "s_name", "s_name", F.lit("company_names")))


@query(FACTS + """
SELECT doc_id, CASE WHEN has_cdm THEN vendor END AS vendor, errors, errors = '' AS is_valid FROM g
""")
def normalize_vendor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run with vendors from a table instead of patterns in the plan, phone numbers included."""
    out = normalize_payloads(render.payload_docs(spark, sf_dir), RUN_TS, vendor_table=_vendor_table(spark, sf_dir))
    return out.select("doc_id", "doc.vendor", validate.error_codes().alias("errors"), "is_valid")


@query(FACTS + """
SELECT doc_id, CASE WHEN has_cdm THEN number END AS document_no, CASE WHEN has_cdm THEN total::DOUBLE END AS grand_total,
       CASE WHEN has_cdm THEN currency END AS currency, errors, errors = '' AS is_valid FROM g
""")
def normalize_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run with the sources of all fields from a table, which also lists every supplier as a source."""
    suppliers = render.table(spark, sf_dir, "supplier").select(
        F.lit(rules.INVOICE).alias("doc_type"), F.lit(None).cast("string").alias("vendor"), F.lit("requester").alias("target"),
        (F.col("s_suppkey") + 1_000).cast("int").alias("priority"), F.col("s_name").alias("source"))
    out = normalize_payloads(
        render.payload_docs(spark, sf_dir), RUN_TS, rule_table=mapping.rule_rows(spark).unionByName(suppliers))
    return out.select("doc_id", "doc.document_no", "doc.grand_total", "doc.currency",
                      validate.error_codes().alias("errors"), "is_valid")


# Extraction ---------------------------------------------------------------------------------


def _entry(key: str, part: str = "value") -> Column:
    return F.get(F.filter("entries", lambda e: e["key"] == key), 0)[part]


@query(FACTS + f"""
SELECT doc_id, NOT broken AS extracted,
       CASE WHEN broken THEN 0 ELSE 3 + (CASE WHEN number IS NULL THEN 0 ELSE 1 END)
            + (CASE WHEN split THEN 2 ELSE 0 END) END AS n_fields,
       CASE WHEN broken THEN NULL WHEN style = 0 THEN '¥' || format('{{:,}}', total)
            WHEN style = 1 THEN '￥' || format('{{:,}}', total) || '円'
            ELSE {wide("format('{:,}', total)")} END AS total_text,
       CASE WHEN NOT broken THEN '  ' || lower(number) || '　' END AS number_text,
       CASE WHEN NOT broken THEN round(0.93 - (k % 4) * 5 / 100.0, 4)::DOUBLE END AS issue_confidence,
       CASE WHEN NOT broken AND later_empty THEN '' END AS empty_date
FROM f
""")
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.with_extraction(render.payload_docs(spark, sf_dir))
    later = F.coalesce(_entry("DueDate"), _entry("DeliveryDate"))
    return out.select(
        "doc_id", "extracted",
        F.size(F.filter("entries", lambda e: e["source"] == "fields")).alias("n_fields"),
        _entry("TotalAmount").alias("total_text"),
        F.coalesce(_entry("InvoiceNumber"), _entry("PurchaseOrderNumber")).alias("number_text"),
        F.round(F.try_element_at("conf", F.lit("IssueDate")), 4).alias("issue_confidence"),
        F.when(later == "", later).alias("empty_date"),
    )


@query(FACTS + """
SELECT doc_id,
       CASE WHEN broken THEN 0 ELSE 2 + (CASE WHEN k % 6 IN (0, 1) THEN 1 ELSE 0 END)
            + (CASE WHEN is_po THEN 0 ELSE 1 END) END AS n_pairs,
       CASE WHEN NOT broken THEN repeat(priority || '/', 20) END AS remark,
       CASE WHEN NOT broken THEN 'fields' END AS total_source,
       CASE WHEN NOT broken AND k % 6 = 0 THEN 'usd' WHEN NOT broken AND k % 6 = 1 THEN 'yen1' END AS currency
FROM f
""")
def extract_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.with_extraction(render.payload_docs(spark, sf_dir))
    return out.select(
        "doc_id",
        F.size(F.filter("entries", lambda e: e["source"] == "key_value_pairs")).alias("n_pairs"),
        _entry("備考").alias("remark"), _entry("TotalAmount", "source").alias("total_source"),
        _entry("通貨").alias("currency"),
    )


@query("""
SELECT 'D' || o_orderkey AS doc_id, true AS extracted, 7 AS n_fields,
       (floor(o_totalprice)::BIGINT + 10000000) || '.0' AS amount, '0.5' AS small,
       (floor(o_totalprice)::BIGINT + 20000000)::VARCHAR AS whole,
       '{"bank":{"branch":{"account":{"holder":"H' || o_orderkey || '"}}}}' AS nested,
       '["a' || o_orderkey || '",{},7]' AS items, 'K' || o_orderkey AS twice, '{"a":"2"}' AS inner_twice,
       floor(o_totalprice)::DOUBLE + 10000000 AS grand_total, 'h/c' AS cells
FROM orders
""")
def payload_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large numbers, deep nesting, repeated keys, fields that are no objects, float indexes."""
    out = extract.with_extraction(render.hard_payloads(spark, sf_dir))
    total = apply_chain(_entry("TotalAmount"), "to_decimal:2")
    return out.select(
        "doc_id", "extracted", F.size("entries").alias("n_fields"), _entry("TotalAmount").alias("amount"),
        _entry("Small").alias("small"), _entry("Whole").alias("whole"), _entry("Pay").alias("nested"),
        _entry("Items").alias("items"), _entry("Twice").alias("twice"), _entry("Pay2").alias("inner_twice"),
        total.alias("grand_total"),
        F.array_join(F.flatten(F.get("tables", 0)["rows"]), "/").alias("cells"))


LINES = """
WITH x AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS doc_id,
         l_linenumber % 3 AS h, l_orderkey % 2 = 0 AS inv, l_partkey, l_suppkey,
         CAST(l_quantity AS BIGINT) AS qty, round(l_extendedprice, 2) AS amt,
         strftime(l_shipdate, '%Y-%m-%d') AS ship
  FROM lineitem
)
"""


@query(LINES + """
SELECT doc_id, 2 AS n_tables, 4 AS row_count, 6 AS column_count, 1 AS rows2, 2 AS columns2,
       CASE h WHEN 0 THEN '品 目|数量|単価|金額|小計|納期'
              WHEN 1 THEN 'Description|【Quantity】|UnitPrice|Amount|LineTotal|DeliveryDate'
              ELSE '列|列|列|列|列|列' END AS header,
       '部品 ' || l_partkey AS first_cell, '小計行' AS second_cell, '$5.5' AS last_amount
FROM x
""")
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.with_extraction(render.line_docs(spark, sf_dir))
    first, second = F.get("tables", 0), F.get("tables", 1)

    def cell(i: int, j: int) -> Column:
        return F.get(F.get(first["rows"], i), j)

    return out.select(
        "doc_id", F.size("tables").alias("n_tables"), first["row_count"].alias("row_count"),
        first["column_count"].alias("column_count"), second["row_count"].alias("rows2"),
        second["column_count"].alias("columns2"),
        F.array_join(F.get(first["rows"], 0), "|").alias("header"),
        cell(1, 0).alias("first_cell"), cell(2, 0).alias("second_cell"), cell(3, 3).alias("last_amount"),
    )


# Mapping ------------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.with_extraction(render.payload_docs(spark, sf_dir))
    return classify.with_classification(out)


@query(FACTS + """
SELECT doc_id, CASE WHEN has_cdm THEN number END AS document_no,
       CASE WHEN has_cdm THEN strftime(d, '%Y-%m-%d') END AS issue_date,
       CASE WHEN has_cdm THEN total::DOUBLE END AS grand_total,
       CASE WHEN has_cdm AND split THEN sub::DOUBLE END AS subtotal,
       CASE WHEN has_cdm AND split THEN tax::DOUBLE END AS tax,
       CASE WHEN has_cdm THEN currency END AS currency,
       CASE WHEN has_cdm AND NOT later_empty AND NOT is_po THEN strftime(later, '%Y-%m-%d') END AS due_date,
       CASE WHEN has_cdm AND later_empty THEN (CASE WHEN is_po THEN 'delivery_date' ELSE 'due_date' END)
            ELSE '' END AS null_targets
FROM g
""")
def map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapping.with_mapped_fields(_entries(spark, sf_dir))
    names = ("document_no", "issue_date", "grand_total", "subtotal", "tax", "currency", "due_date")
    return out.select("doc_id", *[F.col(f"t_{n}").alias(n) for n in names],
                      F.array_join("null_targets", ",").alias("null_targets"))


VENDOR_LAYER = {
    (rules.INVOICE, "株式会社サンプル商事"): {
        "mappings": {
            "payment_terms": {"from": ["備考"]},
            "document_no": {"transform": ["replace:INV|SM"]},
            "currency": {"default": "USD"},
        },
    },
}


@query(FACTS + """
SELECT doc_id,
       CASE WHEN NOT has_cdm THEN NULL WHEN mine THEN replace(number, 'INV', 'SM') ELSE number END AS document_no,
       CASE WHEN NOT has_cdm THEN NULL WHEN mine AND currency = 'JPY' THEN 'USD' ELSE currency END AS currency,
       CASE WHEN has_cdm AND mine THEN repeat(priority || '/', 20) END AS payment_terms
FROM (SELECT *, (NOT is_po AND c % 6 = 1) AS mine FROM g)
""")
def layered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapping.with_mapped_fields(_entries(spark, sf_dir), mapping.rule_variants(VENDOR_LAYER))
    return out.select("doc_id", *[
        F.col(f"t_{n}").alias(n) for n in ("document_no", "currency", "payment_terms")])


@query(FACTS + """
SELECT doc_id, CASE WHEN has_cdm THEN '備考=' || left(repeat(priority || '/', 20), 100) || ':key_value_pairs'
       || (CASE WHEN is_po THEN '' ELSE ';担当者=部署　' || priority || ':key_value_pairs' END) END AS unmapped
FROM g
""")
def unmapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mapping.with_keys(_entries(spark, sf_dir))
    rows = F.transform(mapping.unmapped_fields(), lambda u: F.concat(
        u["field"], F.lit("="), u["value"], F.lit(":"), u["source"]))
    listed = F.when(F.col("doc_type").isNotNull(), F.array_join(rows, ";"))
    return docs.select("doc_id", listed.alias("unmapped"))


MATCHES = FACTS + """, h AS (
  SELECT doc_id, doc_type, 'document_no' AS target,
         CASE WHEN is_po THEN 'PurchaseOrderNumber' ELSE 'InvoiceNumber' END AS key
  FROM g WHERE has_cdm AND number IS NOT NULL
  UNION ALL SELECT doc_id, doc_type, 'issue_date', 'IssueDate' FROM g WHERE has_cdm
  UNION ALL SELECT doc_id, doc_type, 'grand_total', 'TotalAmount' FROM g WHERE has_cdm
  UNION ALL SELECT doc_id, doc_type, 'subtotal', 'SubTotal' FROM g WHERE has_cdm AND split
  UNION ALL SELECT doc_id, doc_type, 'tax', 'Tax' FROM g WHERE has_cdm AND split
  UNION ALL SELECT doc_id, doc_type, 'currency', '通貨' FROM g WHERE has_cdm AND k % 6 IN (0, 1)
  UNION ALL SELECT doc_id, doc_type, 'due_date', 'DueDate' FROM g WHERE has_cdm AND NOT is_po
  UNION ALL SELECT doc_id, doc_type, 'customer_name', '請求先' FROM g WHERE has_cdm AND NOT is_po
  UNION ALL SELECT doc_id, doc_type, 'delivery_date', 'DeliveryDate' FROM g WHERE has_cdm AND is_po
  UNION ALL SELECT doc_id, doc_type, 'requester', '担当者' FROM g WHERE has_cdm AND is_po
)
"""


@query(MATCHES + "SELECT doc_id, target, key FROM h")
def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files.materialize(_entries(spark, sf_dir).select("doc_id", "doc_type", "vendor", "entries"))
    return mapping.lookup_long(docs, mapping.rule_rows(spark)).select("doc_id", "target", "key")


@query(MATCHES + "SELECT doc_type, target, key, count(*) AS documents FROM h GROUP BY ALL")
def rule_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files.materialize(_entries(spark, sf_dir).select("doc_id", "doc_type", "vendor", "entries"))
    return monitor.rule_usage(docs, mapping.lookup_long(docs, mapping.rule_rows(spark)))


@query(LINES + """
SELECT doc_id, 0 AS line, CASE WHEN h < 2 THEN '部品 ' || l_partkey END AS description,
       CASE WHEN h < 2 THEN qty::DOUBLE END AS qty,
       CASE WHEN h < 2 THEN l_suppkey::DOUBLE END AS unit_price,
       CASE WHEN h = 2 THEN NULL WHEN l_partkey % 2 = 0 THEN amt ELSE 1000.0::DOUBLE END AS amount,
       0.1::DOUBLE AS tax_rate, CASE WHEN h < 2 AND NOT inv THEN ship END AS delivery_date,
       NULL::VARCHAR AS unread_qty FROM x
UNION ALL
SELECT doc_id, 1, CASE WHEN h < 2 THEN '送料' END, NULL, NULL,
       CASE WHEN h < 2 THEN 5.5::DOUBLE END, 0.1::DOUBLE, NULL,
       CASE WHEN h < 2 THEN '一式' END FROM x
""")
def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.with_lines(extract.with_extraction(render.line_docs(spark, sf_dir)).withColumn(
        "vendor", F.lit(None).cast("string")))
    return out.select("doc_id", F.posexplode_outer("lines").alias("line", "l")).select(
        "doc_id", "line", "l.description", "l.qty", "l.unit_price", "l.amount", "l.tax_rate",
        "l.delivery_date", F.try_element_at("l.unparsed", F.lit("qty")).alias("unread_qty"))


WIDE_LINES = {
    (rules.INVOICE, "A社"): {"lines": {
        "headers": {"product_code": ["品番"], "tax_rate": ["税率"]}, "defaults": {"unit": "個", "weight": 1.5}}},
}


@query("""
SELECT 'D' || o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'P-' || o_orderkey END AS product_code,
       CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 THEN 0.1::DOUBLE
            WHEN o_orderkey % 3 = 1 THEN 0.08::DOUBLE END AS tax_rate,
       CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 2 THEN '軽減' END AS unread_rate,
       CASE WHEN o_orderkey % 2 = 0 THEN '個' END AS unit,
       CASE WHEN o_orderkey % 2 = 0 THEN 1.5::DOUBLE END AS weight, 2.0::DOUBLE AS qty
FROM orders
""")
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and defaults that only a vendor's rules name."""
    docs = extract.with_extraction(render.wide_line_docs(spark, sf_dir))
    out = lines.with_lines(docs, mapping.rule_variants(WIDE_LINES)).withColumn("l", F.get("lines", 0))
    return out.select("doc_id", "l.product_code", "l.tax_rate",
                      F.try_element_at("l.unparsed", F.lit("tax_rate")).alias("unread_rate"),
                      "l.unit", "l.weight", "l.qty")


VENDOR_RULES = {
    (rules.INVOICE, "株式会社サンプル商事"): {"post_compute": [
        {"when": "totals.grand_total > 0", "set": [("tax", "totals.grand_total / (totals.grand_total - totals.grand_total)")]},
        {"when": "totals.grand_total > 0", "set": [("tax", "totals.subtotal * 2")]},
        {"when": "totals.grand_total > 0", "set": [("tax", "raise_error('x')")]},
    ]},
}


@query(FACTS + """
SELECT doc_id, CASE WHEN broken THEN NULL WHEN has_cdm AND NOT is_po AND c % 6 = 1 AND t_total > 0 AND t_sub IS NOT NULL
         THEN t_sub * 2 WHEN split OR has_cdm THEN t_tax END AS tax FROM g
""")
def vendor_post_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a vendor's layer run after those of the type; one that divides by zero changes
    nothing, one that can not be made safe is skipped."""
    docs = lines.with_totals(_entries(spark, sf_dir))
    out = lines.with_post_compute(docs, mapping.rule_variants(VENDOR_RULES))
    return out.select("doc_id", "totals.tax")


@query(FACTS + """
SELECT doc_id, CASE WHEN NOT broken THEN t_total::DOUBLE END AS grand_total,
       CASE WHEN NOT broken AND split AND style <> 1 THEN sub::DOUBLE END AS subtotal,
       CASE WHEN NOT broken AND split AND style <> 1 THEN tax::DOUBLE END AS tax
FROM f
""")
def extract_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = extract.with_extraction(render.payload_docs(spark, sf_dir))
    return lines.with_totals(docs).select("doc_id", "totals.*")


@query(FACTS + """
SELECT doc_id, CASE WHEN NOT broken THEN t_total::DOUBLE END AS grand_total,
       CASE WHEN broken THEN NULL WHEN split OR has_cdm THEN t_sub END AS subtotal,
       CASE WHEN broken THEN NULL WHEN split OR has_cdm THEN t_tax END AS tax
FROM g
""")
def post_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _entries(spark, sf_dir)
    return lines.with_post_compute(lines.with_totals(docs)).select("doc_id", "totals.*")


# Transforms ---------------------------------------------------------------------------------


@query(f"""
SELECT c_custkey, c_name AS folded, replace(c_name, '#', '＃') AS letters_only,
       {wide("c_name", text.ALNUM)} AS widened, '12' || c_mktsegment AS circled
FROM customer
""")
def tf_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = render.table(spark, sf_dir, "customer").withColumn(
        "w", F.translate("c_name", text.ALNUM + "#", text.WIDE_ALNUM + "＃"))
    circled = F.concat(F.lit("①②"), F.col("c_mktsegment"))
    return c.select(
        "c_custkey", apply_chain(F.col("w"), "zenkaku_to_hankaku").alias("folded"),
        apply_chain(F.col("w"), "zenkaku_to_hankaku:alnum").alias("letters_only"),
        apply_chain(F.col("c_name"), "hankaku_to_zenkaku").alias("widened"),
        apply_chain(circled, "fold_circled").alias("circled"))


@query(FACTS + f"""
SELECT doc_id, CASE WHEN style = 2 THEN {wide("total::VARCHAR")} ELSE total::VARCHAR END AS plain,
       total || '税込' AS words_kept, total::VARCHAR AS final
FROM f
""")
def tf_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = render.amount_text(F.col("total"), F.col("style"))
    figures = F.format_number("total", 0)
    note = F.concat(F.lit("計 ¥1円＋税¥2円 = ¥"), figures, F.lit("円"))
    mixed = F.concat(F.lit(" USD "), figures, F.lit(" yen税込"))
    return render.order_facts(spark, sf_dir).select(
        "doc_id", apply_chain(amount, "strip_currency").alias("plain"),
        apply_chain(mixed, "strip_currency", "remove_spaces").alias("words_kept"),
        apply_chain(note, "final_amount").alias("final"))


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS amount, round_even(o_totalprice, 0) AS whole,
       CASE WHEN o_orderkey % 10 = 0 THEN 0.0::DOUBLE ELSE o_orderkey::DOUBLE END AS or_zero,
       printf('%.2f', o_totalprice) AS number
FROM orders
""")
def tf_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = render.table(spark, sf_dir, "orders")
    amount = F.concat(F.lit("¥"), F.format_number("o_totalprice", 2), F.lit("円"))
    key = F.when(F.col("o_orderkey") % 10 == 0, "abc").otherwise(
        F.translate(F.col("o_orderkey").cast("string"), text.DIGITS, text.WIDE_DIGITS))
    wide_amount = F.concat(F.lit("合計"), F.translate(
        F.format_number("o_totalprice", 2), text.DIGITS + ",.", text.WIDE_DIGITS + "，．"))
    return o.select(
        "o_orderkey", apply_chain(amount, "strip_currency", "to_decimal:2").alias("amount"),
        apply_chain(amount, "to_decimal:0").alias("whole"),
        apply_chain(key, "to_decimal").alias("or_zero"),
        apply_chain(wide_amount, "extract_number").alias("number"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS named, strftime(o_orderdate, '%Y-%m-%d') AS formatted,
       strftime(o_orderdate, '%Y-%m-%d') AS free, strftime(o_orderdate, '%Y-%m-%d') AS day_first,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS empty_or_date,
       CASE WHEN o_orderkey % 3 = 0 THEN '未定' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS unread_kept,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS strict
FROM orders
""")
def tf_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = render.orders(spark, sf_dir).select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    styled = render.date_text(F.col("d"), F.col("o_orderkey") % 4)
    third = F.col("o_orderkey") % 3 == 0
    padded = F.concat(F.lit("　"), styled, F.lit(" 付"))
    impossible = F.when(third, "令和6年13月45日").otherwise(styled)
    return o.select(
        "o_orderkey", apply_chain(padded, "parse_japanese_date").alias("named"),
        apply_chain(styled, "to_date:%Y-%m-%d").alias("formatted"),
        apply_chain(F.date_format("d", "MMMM d, yyyy"), "to_date").alias("free"),
        apply_chain(F.date_format("d", "dd.MM.yyyy"), "to_date:%d.%m.%Y").alias("day_first"),
        apply_chain(F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(styled), "to_date:%Y-%m-%d")
        .alias("empty_or_date"),
        apply_chain(F.when(third, "未定").otherwise(styled), "to_date:%Y-%m-%d").alias("unread_kept"),
        dates.japanese_date(impossible, strict=True).alias("strict"))


@query("""
SELECT c_custkey, '03-' || printf('%04d', c_custkey % 10000) || '-5678' AS dashed,
       '03' || printf('%04d', c_custkey % 10000) || '5678' AS bracketed
FROM customer
""")
def tf_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.format_string("%04d", F.col("c_custkey") % 10000)
    dashed = F.concat(F.lit("０３－"), F.translate(part, text.DIGITS, text.WIDE_DIGITS), F.lit("－－５６７８"))
    bracketed = F.concat(F.lit(" 03("), part, F.lit(")5678"))
    return render.table(spark, sf_dir, "customer").select(
        "c_custkey", apply_chain(dashed, "normalize_phone").alias("dashed"),
        apply_chain(bracketed, "normalize_phone").alias("bracketed"))


@query("""
SELECT c_custkey, printf('%03d', c_custkey % 1000) || '-0001' AS marked,
       printf('%03d', c_custkey % 1000) || '-0002' AS joined,
       printf('%03d', c_custkey % 1000) || '-0003' AS found, '' AS missing
FROM customer
""")
def tf_postal(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.format_string("%03d", F.col("c_custkey") % 1000)
    marked = F.concat(F.lit("〒"), F.translate(part, text.DIGITS, text.WIDE_DIGITS), F.lit("－０００１"))
    inside = F.concat(F.lit("郵便番号: "), part, F.lit("0003 東京都千代田1-1-1"))
    return render.table(spark, sf_dir, "customer").select(
        "c_custkey", apply_chain(marked, "normalize_postal_code").alias("marked"),
        apply_chain(F.concat(part, F.lit("0002")), "normalize_postal_code").alias("joined"),
        apply_chain(inside, "extract_postal_code").alias("found"),
        apply_chain(F.col("c_mktsegment"), "extract_postal_code").alias("missing"))


@query("""
SELECT p_partkey, p_name AS trimmed, upper(p_name) AS uppered, replace(p_name, ' ', '') AS joined,
       'A1 ' || p_name AS normalized, replace(p_name, 'e', 'o') AS replaced, p_name AS kept,
       split_part(p_name, ' ', 1) AS first_word, coalesce(nullif(p_type, 'SMALL'), 'none') AS defaulted,
       p_brand AS unknown_name
FROM part
""")
def tf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    padded = F.concat(F.lit(" 　"), name, F.lit("　\n"))
    wide_prefix = F.concat(F.lit("　Ａ１　\t"), F.replace(name, F.lit(" "), F.lit("　 ")), F.lit(" "))
    small_empty = F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type"))
    return render.table(spark, sf_dir, "part").select(
        "p_partkey", apply_chain(padded, "trim").alias("trimmed"),
        apply_chain(name, "lower", "upper").alias("uppered"),
        apply_chain(padded, "remove_spaces").alias("joined"),
        apply_chain(wide_prefix, "normalize_japanese").alias("normalized"),
        apply_chain(name, "replace:e|o").alias("replaced"),
        apply_chain(name, "replace:e", "regex:[0-9]+円").alias("kept"),
        apply_chain(name, r"regex:^(\S+)").alias("first_word"),
        apply_chain(small_empty, "default:none").alias("defaulted"),
        apply_chain(F.col("p_brand"), "no_such_transform").alias("unknown_name"))


@query("""
SELECT o_orderkey, round_even(o_totalprice, 0) AS rounded, o_totalprice * 2.5::DOUBLE AS doubled,
       o_totalprice / 4.0::DOUBLE AS quarter, o_totalprice AS absolute,
       NULL::DOUBLE AS by_zero, o_orderpriority AS not_a_number
FROM orders
""")
def tf_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    out = render.table(spark, sf_dir, "orders")

    def number(*chain: str) -> Column:
        return apply_chain(price, *chain, kind="double")

    return out.select(
        "o_orderkey", number("round:0").alias("rounded"), number("multiply:2.5").alias("doubled"),
        number("divide:4").alias("quarter"),
        apply_chain(-price, "abs", kind="double").alias("absolute"),
        number("divide:0").alias("by_zero"),
        chain_text(F.col("o_orderpriority"), "round:1", "multiply:2").alias("not_a_number"))


@query("""
SELECT p_partkey, replace(p_name, ' ', '/') AS rejoined, len(string_split(p_name, ' ')) AS parts,
       p_name || ',' || p_brand AS unsplit
FROM part
""")
def tf_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    both = F.concat_ws(",", name, "p_brand")
    return render.table(spark, sf_dir, "part").select(
        "p_partkey", apply_chain(name, "split: ", "join:/").alias("rejoined"),
        F.size(apply_chain(name, "split: ")).alias("parts"),
        apply_chain(both, "split", "join").alias("unsplit"))


@query("""
SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS masked, length(c_name)::DOUBLE * 2 AS size,
       upper(c_name) AS after_unknown
FROM customer
""")
def tf_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms that a user adds, with a parameter and with a number as result, inside chains."""
    register_transform("mask", lambda c, kept: F.concat(
        F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(c) - int(kept))), F.right(c, F.lit(int(kept)))))
    register_transform("characters", lambda c, _: F.length(c).cast("double"), returns="double")
    name = F.col("c_name")
    return render.table(spark, sf_dir, "customer").select(
        "c_custkey", apply_chain(F.concat(F.lit("　"), name), "trim", "mask:4").alias("masked"),
        apply_chain(name, "characters", "multiply:2").alias("size"),
        apply_chain(name, "no_such_transform", "upper").alias("after_unknown"))


# Text path ----------------------------------------------------------------------------------

_PHONES = " + ".join(
    f"len(regexp_extract_all(text, '{p}'))"
    for p in (r"[0-9]{2,4}-[0-9]{2,4}-[0-9]{4}", r"[0-9]{10,11}",
              r"\+81-[0-9]{1,4}-[0-9]{1,4}-[0-9]{4}"))
_POSTAL = " + ".join(
    f"len(regexp_extract_all(text, '{p}'))" for p in (r"〒[0-9]{3}-[0-9]{4}", r"[0-9]{3}-[0-9]{4}"))
_SUFFIXES = " + ".join(
    f"contains(text, '{w}')::INTEGER" for w in rules.SCREENS["company_suffix"])
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


@query(f"""
SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}'))::INTEGER AS emails,
       array_to_string(regexp_extract_all(text, '{_EMAIL}'), ' ') AS email_list,
       ({_PHONES})::INTEGER AS phones, ({_POSTAL})::INTEGER AS postal_codes,
       ({_SUFFIXES})::INTEGER AS company_words
FROM documents
""")
def text_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.spread(render.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = {k: text_fields.screen_matches(F.col("text"), k) for k in rules.SCREENS}
    return docs.select(
        "doc_id", F.size(found["email"]).alias("emails"),
        F.array_join(found["email"], " ").alias("email_list"),
        F.size(found["phone"]).alias("phones"), F.size(found["postal_code"]).alias("postal_codes"),
        F.size(found["company_suffix"]).alias("company_words"))


@query(FACTS + """
SELECT doc_id, CASE WHEN NOT is_po AND NOT unknown THEN number END AS document_no,
       strftime(d, '%Y-%m-%d') AS issue_date,
       CASE WHEN NOT is_po AND NOT unknown THEN strftime(later, '%Y-%m-%d') END AS due_date,
       CASE WHEN style <> 2 THEN total END AS grand_total,
       CASE WHEN style <> 2 AND split THEN sub END AS subtotal,
       CASE WHEN style <> 2 AND split THEN tax END AS tax,
       CASE WHEN c % 6 = 1 THEN '06-9876-5432' END AS phone
FROM f
""")
def text_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_fields.with_converted_fields(
        text_fields.with_text_fields(render.text_docs(spark, sf_dir)))
    return out.select("doc_id", "document_no", "issue_date", "due_date", "grand_total",
                      "subtotal", "tax", "phone")


@query(FACTS + """
SELECT doc_id, CASE WHEN k % 31 = 8 THEN 'PURCHASE_ORDER' WHEN unknown THEN 'UNKNOWN'
            WHEN is_po THEN 'PURCHASE_ORDER' ELSE 'INVOICE' END AS type,
       CASE c % 6 WHEN 0 THEN '株式会社エグザンプル 本社' WHEN 4 THEN '有限会社　山田工務店'
            ELSE '不明' END AS vendor,
       CASE WHEN NOT is_po AND NOT unknown THEN number END AS document_no,
       (CASE WHEN style <> 2 AND split THEN 1 ELSE 0 END)::INTEGER AS line_count,
       CASE WHEN style <> 2 AND split THEN sub::DOUBLE END AS line_amount,
       CASE WHEN style <> 2 THEN total::DOUBLE END AS grand_total
FROM f
""")
def text_cdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("raw_text")
    docs = text_fields.with_converted_fields(
        text_fields.with_text_fields(render.text_docs(spark, sf_dir)))
    docs = docs.withColumns({
        "doc_type": classify.simple_type(t), "vendor": classify.simple_vendor(t)[0]})
    return text_fields.text_cdm(docs, RUN_TS).select(
        "doc_id", "doc.type", "doc.vendor", "doc.document_no", F.size("lines").alias("line_count"),
        F.get("lines", 0)["amount"].alias("line_amount"), "totals.grand_total")


@query(FACTS + f"""
SELECT doc_id, CASE WHEN unknown THEN 'UNKNOWN' ELSE doc_type END AS type,
       CASE WHEN NOT is_po AND NOT unknown THEN number END AS document_no,
       '発行日: ' || (CASE k % 4 WHEN 0 THEN strftime(d, '%Y-%m-%d')
         WHEN 1 THEN '平成' || (year(d) - 1988) || '年' || month(d) || '月' || day(d) || '日'
         WHEN 2 THEN {wide("year(d) || '年' || month(d) || '月' || day(d) || '日'")}
         ELSE year(d) || '/' || month(d) || '/' || day(d) END) AS issue_date_raw,
       NULL::VARCHAR AS issue_date, CASE WHEN style <> 2 THEN 'JPY' END AS currency,
       CASE WHEN style <> 2 THEN total::DOUBLE END AS grand_total,
       CASE c % 6 WHEN 0 THEN '株式会社エグザンプル 本社' WHEN 4 THEN '有限会社　山田工務店' END AS vendor_name
FROM f
""")
def minimal_cdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = classify.with_classification(render.text_docs(spark, sf_dir))
    docs = text_fields.with_text_fields(docs, fields=rules.LOOSE_TEXT_FIELDS)
    return text_fields.minimal_cdm(docs, RUN_TS).select(
        "doc_id", "doc.type", "doc.document_no", "doc.issue_date_raw", "doc.issue_date",
        "doc.currency", "totals.grand_total", "vendor_name")


# Validation ---------------------------------------------------------------------------------


def _check(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    docs = render.cdm_docs(spark, sf_dir)
    out = docs.withColumn("errors", build(docs.schema))
    return out.select("doc_id", validate.error_codes().alias("errors"))


_BAD_CURRENCY = "currency = 'usd'"
_SCHEMA = [
    ("number IS NULL AND NOT null_number", "schema_required:doc"),
    ("null_number", "schema_type:doc.document_no"),
    ("null_issue", "schema_type:doc.issue_date"),
    ("k % 11 = 0", "schema_pattern:doc.issue_date"),
    (_BAD_CURRENCY, "schema_pattern:doc.currency"),
    ("line2 IS NULL", "schema_type:lines.1.amount"),
]
_SCHEMA.insert(1, ("issue_text IS NULL AND NOT null_issue", "schema_required:doc"))
_AMOUNTS = [
    ("tax <> 0 AND grand_total <> 0 AND abs(subtotal + tax - grand_total) > 1",
     "amount_mismatch:totals.grand_total"),
    ("abs(line1 + coalesce(line2, 0) - subtotal) > 10", "line_total_mismatch:totals.subtotal"),
]
_DATES = [
    ("k % 11 = 0 AND due IS NOT NULL", "invalid_date:doc.due_date"),
    ("due < issue", "due_before_issue:doc.due_date"),
    ("due - issue > 90", "payment_terms_exceeded:doc.due_date"),
]
_REQUIRED = [
    ("coalesce(number, '') = ''", "required_missing:doc.document_no"),
    ("issue_text IS NULL", "required_missing:doc.issue_date"),
    ("vendor IS NULL", "required_missing:doc.vendor"),
    ("grand_total = 0", "required_missing:totals.grand_total"),
]
_CONSTRAINTS = [
    ("number = ''", "too_short:doc.document_no"),
    ("length(number) > 50", "too_long:doc.document_no"),
    ("number = '' OR number LIKE '請求%'", "pattern:doc.document_no"),
    (_BAD_CURRENCY, "pattern:doc.currency"),
    ("grand_total < 0", "below_minimum:totals.grand_total"),
    ("grand_total > 999999999", "above_maximum:totals.grand_total"),
]
_FORMATS = [
    ("null_number OR null_issue", "system_error:doc"),
    (f"NOT (null_number OR null_issue) AND {_BAD_CURRENCY}", "format_currency:doc.currency"),
    ("NOT (null_number OR null_issue) AND length(number) > 50", "format_document_no:doc.document_no"),
    ("NOT (null_number OR null_issue) AND k % 11 = 0", "format_date:doc.issue_date"),
]


@query(cdm_errors(*_SCHEMA))
def validate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, lambda s: validate._by_type(
        lambda spec: validate.schema_errors(s, spec), rules.CDM_SCHEMA))


@query(cdm_errors(_AMOUNTS[0]))
def validate_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, lambda s: F.filter(
        validate.amount_errors(s, rules.VALIDATION["amounts"]), lambda e: e["code"] == "amount_mismatch"))


@query(cdm_errors(_AMOUNTS[1]))
def validate_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, lambda s: F.filter(
        validate.amount_errors(s, rules.VALIDATION["amounts"]),
        lambda e: e["code"] == "line_total_mismatch"))


@query(cdm_errors(*_DATES))
def validate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, lambda s: validate.date_errors(s, rules.VALIDATION["dates"]))


@query(cdm_errors(*_REQUIRED))
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, lambda s: validate._by_type(
        lambda paths: validate.required_errors(s, paths), rules.VALIDATION["required"]))


@query(cdm_errors(*_CONSTRAINTS))
def validate_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, lambda s: validate.constraint_errors(
        s, rules.VALIDATION["constraints"]))


@query(cdm_errors(*_FORMATS))
def validate_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, validate.format_errors)


_ALL = _SCHEMA + _AMOUNTS + _DATES + _REQUIRED + _CONSTRAINTS + _FORMATS


@query(f"SELECT *, errors = '' AS is_valid FROM ({cdm_errors(*_ALL)})")
def validate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.with_validation(render.cdm_docs(spark, sf_dir))
    return out.select("doc_id", validate.error_codes().alias("errors"), "is_valid")


@query(cdm_errors(("currency IN ('usd', 'CHF')", "currency_not_allowed:doc.currency")))
def allowed_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, lambda s: validate.currency_errors(
        s, rules.VALIDATION["allowed_currencies"]))


@query(f"""{CDM} SELECT doc_id,
  CASE WHEN issue > DATE '{RUN_DATE}' THEN 'future_date:doc.issue_date' ELSE '' END AS errors,
  CASE WHEN issue > DATE '{RUN_DATE}' + 30 THEN 'future_date:doc.issue_date' ELSE '' END AS with_grace
FROM f""")
def future_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.cdm_docs(spark, sf_dir)
    limits, today = rules.VALIDATION["dates"], F.lit(RUN_DATE).cast("date")
    out = docs.withColumns({
        "errors": validate.future_date_errors(docs.schema, limits, today),
        "grace": validate.future_date_errors(docs.schema, {**limits, "allow_future": True}, today),
    })
    return out.select("doc_id", validate.error_codes().alias("errors"),
                      validate.error_codes("grace").alias("with_grace"))


@query(cdm_errors(
    ("k % 5 < 2", "low_field_confidence:備考"),
    ("k % 6 < 3", "low_document_confidence:doc"),
    ("k % 3 = 2", "low_critical_confidence:document_no"),
    ("k % 4 > 1", "low_critical_confidence:grand_total"),
))
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.cdm_docs(spark, sf_dir).withColumn("conf", F.col("metadata.confidence_scores"))
    out = validate.with_confidence_errors(docs)
    return out.select("doc_id", validate.error_codes("confidence_errors").alias("errors"))


@query(cdm_errors(
    (f"NOT is_po AND issue > DATE '{RUN_DATE}'", "issue_not_after_today:doc.issue_date"),
    ("NOT is_po AND least(abs(tax - subtotal * 0.08::DOUBLE), abs(tax - subtotal * 0.1::DOUBLE)) > 1",
     "tax_rate_8_or_10:totals.tax"),
    ("is_po AND NOT delivery > issue", "delivery_after_issue:doc.delivery_date"),
    ("is_po AND grand_total <= 0", "total_positive:totals.grand_total"),
))
def business_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = validate.with_days(render.cdm_docs(spark, sf_dir), RUN_DATE)
    errors = validate.business_errors(docs.schema, rules.VALIDATION["business"], F.col("today"))
    return docs.withColumn("errors", errors).select("doc_id", validate.error_codes().alias("errors"))


@query(cdm_errors(
    ("grand_total < 1 OR grand_total > 100000000", "range_numeric:totals.grand_total"),
    (f"issue < DATE '2000-01-01' OR issue > DATE '{RUN_DATE}' + INTERVAL 1 YEAR",
     "range_issue_date:doc.issue_date"),
    (f"due < issue OR due > DATE '{RUN_DATE}' + INTERVAL 2 YEAR", "range_due_date:doc.due_date"),
    ("length(number) < 3 OR length(number) > 50", "range_length:doc.document_no"),
    ("least(abs(tax), abs(tax - subtotal * 0.08::DOUBLE), abs(tax - subtotal * 0.1::DOUBLE)) > 10",
     "tax_rate:totals.tax"),
    ("due - issue NOT IN (0, 30, 60, 90)", "payment_days:doc.due_date"),
    ("number IS NOT NULL AND NOT regexp_matches(number, "
     "(CASE WHEN is_po THEN '^(PO|発注)' ELSE '^(INV|請求)' END) || '-[0-9]{4,}-[0-9]{3,}$')",
     "document_no_pattern:doc.document_no"),
))
def range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, lambda s: validate.range_errors(
        s, rules.VALIDATION["ranges"], F.lit(RUN_DATE).cast("date")))


@query("""
SELECT 'D' || o_orderkey AS doc_id, l.line_total::DOUBLE AS line_total, l.line_count,
       coalesce(abs(l.line_total - CAST(o_totalprice AS DECIMAL(18,2))) > 10, false) AS mismatch
FROM orders LEFT JOIN (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS line_total, count(*) AS line_count
  FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
""")
def line_totals_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = render.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("stated"))
    sums = lines.line_sums(render.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice")
    limit = rules.VALIDATION["amounts"]["line_tolerance"]
    return heads.join(sums, heads.o_orderkey == sums.l_orderkey, "left").select(
        F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("doc_id"),
        F.col("line_total").cast("double").alias("line_total"), "line_count",
        F.coalesce(F.abs(F.col("line_total") - F.col("stated")) > limit, F.lit(False)).alias("mismatch"))


@query(ORACLES["line_totals_by_document"])
def line_totals_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from tables in buckets of the document: no shuffle between scan, sum and join."""
    base, name = files.scratch_dir(spark, "buckets"), f"denpyo_{uuid.uuid4().hex}"
    heads = lines.store_by_document(render.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("stated")), f"{name}_heads", f"{base}/heads", "o_orderkey", 8)
    own = lines.store_by_document(render.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"),
                                  f"{name}_lines", f"{base}/lines", "l_orderkey", 8)
    limit = rules.VALIDATION["amounts"]["line_tolerance"]
    return lines.stated_and_summed(heads, own, "o_orderkey", "l_orderkey", "l_extendedprice").select(
        F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("doc_id"),
        F.col("line_total").cast("double").alias("line_total"), "line_count",
        F.coalesce(F.abs(F.col("line_total") - F.col("stated")) > limit, F.lit(False)).alias("mismatch"))


# Masters and duplicates ---------------------------------------------------------------------


@query("""
SELECT 'D' || o_orderkey AS doc_id, printf('V%06d', s_suppkey) AS vendor_id,
       CASE WHEN s_suppkey % 3 <> 0 THEN upper(s_name) ELSE s_name END AS vendor_normalized,
       s_nationkey::VARCHAR AS nation
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey // 10 AND o_custkey % 6 <> 5
""")
def resolve_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c") % 6 != 5, F.format_string("Supplier#%09d", F.expr("c div 10")))
    docs = render.order_facts(spark, sf_dir).select("doc_id", F.struct(name.alias("vendor")).alias("doc"))
    out = resolve.resolve_vendors(docs, render.vendor_master(spark, sf_dir))
    return out.select("doc_id", "doc.vendor_id", "doc.vendor_normalized",
                      F.try_element_at("doc.vendor_info", F.lit("nation")).alias("nation"))


@query("""
SELECT 'D' || o_orderkey AS doc_id, printf('V%06d', s_suppkey) AS vendor_id
FROM orders LEFT JOIN supplier ON s_suppkey = CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE o_custkey // 10 END
""")
def resolve_hot_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents name one vendor; the master counts as too large for a broadcast."""
    key = F.when(F.col("k") % 2 == 0, F.lit(1)).otherwise(F.expr("c div 10"))
    docs = render.order_facts(spark, sf_dir).select("doc_id", F.struct(F.format_string("Supplier#%09d", key).alias("vendor")).alias("doc"))
    limits = skew.MASTER_ROWS, skew.HOT_ROWS
    skew.MASTER_ROWS, skew.HOT_ROWS = 0, 500
    try:
        out = resolve.resolve_vendors(docs, render.vendor_master(spark, sf_dir))
    finally:
        skew.MASTER_ROWS, skew.HOT_ROWS = limits
    return out.select("doc_id", "doc.vendor_id")


@query("""
SELECT 'D' || o_orderkey AS doc_id, printf('C%06d', c_custkey) AS customer_id,
       lower(c_name) AS customer_normalized
FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2
""")
def resolve_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.resolve_customers(
        render.cdm_docs(spark, sf_dir), render.customer_master(spark, sf_dir))
    return out.select("doc_id", "doc.customer_id", "doc.customer_normalized")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey").cast("string")).alias("vendor"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("document_no"),
        F.to_date("o_orderdate").alias("issue_date"))


DUPLICATES = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS v, o_orderpriority || '/' || o_orderstatus AS n,
         CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 50 <> 0
), w AS (
  SELECT k, d, lag(d) OVER s AS before_d, lag(k) OVER s AS before_k,
         min(k) OVER (PARTITION BY v, n, d) AS first_k
  FROM o WINDOW s AS (PARTITION BY v, n ORDER BY d, k)
), p AS (
  SELECT k, d, CASE WHEN d - before_d <= 365 THEN before_d END AS prior_date,
         CASE WHEN before_d = d THEN first_k WHEN d - before_d <= 365 THEN before_k END AS prior_doc
  FROM w
)
"""


@query(DUPLICATES + """
SELECT o_orderkey AS doc_id, prior_doc IS NOT NULL AS is_duplicate, prior_doc,
       strftime(prior_date, '%Y-%m-%d') AS prior_date
FROM orders LEFT JOIN p ON k = o_orderkey
""")
def duplicate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.flag_duplicates(_keyed(spark, sf_dir)).select(
        "doc_id", "is_duplicate", "prior_doc", F.col("prior_date").cast("string").alias("prior_date"))


@query(DUPLICATES + """
SELECT k AS doc_id, prior_doc, (d - prior_date)::INTEGER AS days_between
FROM p WHERE prior_doc IS NOT NULL
""")
def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_links(_keyed(spark, sf_dir))


# Stored results -----------------------------------------------------------------------------


@query(CDM + """
SELECT doc_id, CASE WHEN vendor IS NOT NULL AND coalesce(number, '') <> ''
            THEN doc_type || '_' || vendor || '_' || number
            ELSE doc_type || '_20240201000000_' || doc_id END AS id,
       coalesce(vendor, 'unknown') AS partition_key, doc_type, number AS document_no,
       issue_text AS issue_date, strftime(due, '%Y-%m-%d') AS due_date, currency,
       grand_total, 2 AS line_item_count
FROM f
""")
def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.stored_rows(render.cdm_docs(spark, sf_dir), RUN_TS).select(
        "doc_id", "id", "partition_key", "doc_type", "document_no", "issue_date", "due_date",
        "currency", "totals.grand_total", "line_item_count")


@query(FACTS + """
SELECT doc_id, has_cdm AS success, errors = '' AS is_valid,
       (CASE WHEN errors = '' THEN 0 ELSE 1 + length(errors) - length(replace(errors, ',', '')) END)::INTEGER
         AS error_count, 0 AS warning_count
FROM g
""")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize_payloads(render.payload_docs(spark, sf_dir), RUN_TS)
    return sinks.audit_rows(out, RUN_TS).drop("processed_at")


@query(FACTS + """
SELECT 'raw' AS kind, count(*) AS documents, NULL::HUGEINT AS errors, NULL::DOUBLE AS amount FROM g
UNION ALL SELECT 'cdm', count(*), NULL, sum(total)::DOUBLE FROM g WHERE has_cdm
UNION ALL SELECT 'validation', count(*), sum(CASE WHEN errors = '' THEN 0
          ELSE 1 + length(errors) - length(replace(errors, ',', '')) END)::HUGEINT, NULL FROM g
""")
def artifacts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch_dir(spark, "artifacts")
    out = normalize_payloads(render.payload_docs(spark, sf_dir), RUN_TS)
    sinks.write_artifacts(out, path, RUN_TS, RUN_TS, 0)
    body = F.from_json("value", "doc STRUCT<grand_total: DOUBLE>, errors ARRAY<STRUCT<code: STRING>>")
    back = spark.read.text(path).withColumn("b", body)
    return back.groupBy("kind").agg(
        F.count("*").alias("documents"), F.sum(F.size("b.errors")).alias("errors"),
        F.sum("b.doc.grand_total").alias("amount"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.table(spark, sf_dir, "orders").select(
        F.concat_ws("_", F.col("o_custkey").cast("string"), "o_orderpriority").alias("id"),
        F.col("o_orderkey").alias("doc_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.struct(F.col("o_totalprice").alias("grand_total"),
                 F.col("o_orderstatus").alias("status")).alias("full_document"))


@query("""
SELECT id, doc_id, created_at, grand_total, status FROM (
  SELECT o_custkey || '_' || o_orderpriority AS id, o_orderkey AS doc_id,
         strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_totalprice AS grand_total,
         o_orderstatus AS status,
         row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                            ORDER BY o_orderdate DESC, o_orderkey % 2 DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal dates the later batch wins, that of the odd keys."""
    path = files.scratch_dir(spark, "documents")
    versions = _versions(spark, sf_dir)
    for batch in (0, 1, 1):  # a batch that is delivered twice changes nothing
        part = versions.filter(F.pmod("doc_id", F.lit(2)) == batch)
        sinks.merge_documents(part, path, RUN_TS, batch, buckets=8)
    return sinks.current_documents(spark, path).select("id", "doc_id", "created_at", "full_document.*")


@query("""
SELECT o_custkey || '_' || o_orderpriority AS id, count(*) AS versions,
       arg_max(o_orderkey, (CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'F' THEN 1 ELSE 0 END, o_orderkey)) AS doc_id
FROM orders GROUP BY 1
""")
def upsert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of equal creation time, the last from a second run into the same path: the
    later batch wins whatever the document's id, and no run replaces another."""
    path = files.scratch_dir(spark, "documents")
    versions = _versions(spark, sf_dir).withColumn("created_at", F.lit(RUN_TS))
    status = F.col("full_document.status")
    batches = [("first", 0, ~status.isin("O", "F")), ("first", 1, status == "F"), ("second", 2, status == "O")]
    for run, batch, mine in batches:
        sinks.upsert_documents(versions.filter(mine), path, run, batch)
    counts = spark.read.parquet(path).groupBy("id").agg(F.count("*").alias("versions"))
    return sinks.read_documents(spark, path).join(counts, "id").select("id", "versions", "doc_id")


_NUMBERED = "'請求番号: ' || o_orderkey || ' ' || o_orderpriority"


@query(f"""
SELECT o_orderstatus AS status, sum(strlen({_NUMBERED}) + 1)::BIGINT AS bytes,
       sum(length({_NUMBERED}) + 1)::BIGINT AS characters, count(*) AS lines
FROM orders GROUP BY 1
""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch_dir(spark, "inbox")
    body = F.concat_ws(" ", F.lit("請求番号:"), F.col("o_orderkey").cast("string"), "o_orderpriority")
    render.table(spark, sf_dir, "orders").select("o_orderstatus", body.alias("value")).write \
        .partitionBy("o_orderstatus").option("maxRecordsPerFile", 1000).text(path)
    status = F.regexp_extract("name", "o_orderstatus=([^/]+)", 1).alias("status")
    sizes = files.list_files(spark, path, "*.txt").groupBy(status).agg(F.sum("size").alias("bytes"))
    texts = files.read_text_files(spark, path, "*.txt").withColumnRenamed("doc_id", "name")
    counts = texts.groupBy(status).agg(
        F.sum(F.length("raw_text")).alias("characters"),
        F.sum(F.length("raw_text") - F.length(F.replace("raw_text", F.lit("\n"), F.lit("")))).alias("lines"))
    return sizes.join(counts, "status")


# Monitoring ---------------------------------------------------------------------------------


def _latest_event(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    runs = render.table(spark, sf_dir, "events").withColumnRenamed("event_type", "code")
    # One row: the time of the newest event.
    return runs, str(runs.agg(F.max("ts")).first()[0])


@query("""
SELECT event_type AS code, count(*) AS runs FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS GROUP BY 1
""")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, now = _latest_event(spark, sf_dir)
    return monitor.run_counts(runs, now, hours=24)


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS runs,
       count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1
""")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = render.table(spark, sf_dir, "events").withColumnRenamed("event_type", "code")
    return monitor.hourly_counts(runs, "error").withColumn(
        "hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("""
SELECT event_id, user_id, value FROM events
WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS
""")
def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, now = _latest_event(spark, sf_dir)
    return monitor.recent_failures(runs, now, "error").select("event_id", "user_id", "value")


# Streams ------------------------------------------------------------------------------------


_ARRIVAL = "doc_id BIGINT, vendor STRING, document_no STRING, arrival TIMESTAMP"


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrival = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 300 as int))")
    return render.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("vendor"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("document_no"), arrival.alias("arrival"))


@query("""
SELECT o_orderpriority AS priority, count(*) AS documents, count(*) FILTER (WHERE o_custkey % 6 = 4) AS with_vendor,
       count(*) FILTER (WHERE o_orderkey % 2 = 0) AS archived
FROM orders GROUP BY 1
""")
def stream_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text, many documents per file, through the stream in two deliveries. When the second begins, the
    files of the first are in the archive, and no longer in the inbox."""
    base = files.scratch_dir(spark, "text-files")
    vendor = F.when(F.col("o_custkey") % 6 == 4, "有限会社　山田工務店\n").otherwise("")
    body = F.concat(F.lit("請求書\n"), vendor, F.lit("請求番号: "), "o_orderpriority", F.lit("\n伝票 "), F.col("o_orderkey").cast("string"))
    texts = render.orders(spark, sf_dir).select("o_orderkey", body.alias("value"))
    for part in range(2):
        texts.filter(F.pmod("o_orderkey", F.lit(2)) == part).select("value").write.mode("append").option("lineSep", "\f").text(f"{base}/inbox")
        ingest.start_ingest(spark, f"{base}/inbox", f"{base}/out", f"{base}/checkpoint", RUN_TS, files="raw_text",
                            archive=f"{base}/archive", separator="\f").awaitTermination()
    priority = F.regexp_extract("raw_text", "請求番号: (.*)", 1).alias("priority")
    done = spark.read.parquet(f"{base}/out/results").groupBy(priority).agg(
        F.count("*").alias("documents"), F.count("vendor").alias("with_vendor"))
    kept = spark.read.option("recursiveFileLookup", "true").text(f"{base}/archive", lineSep="\f").withColumnRenamed("value", "raw_text")
    return done.join(kept.groupBy(priority).agg(F.count("*").alias("archived")), "priority", "left")


@query(FACTS + """
SELECT doc_type || '_' || replace(vendor, ' ', '_') || '_' || number AS id, doc_id,
       number AS document_no, vendor, t_total::DOUBLE AS grand_total, 2 AS line_item_count
FROM g WHERE errors = ''
""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = files.scratch_dir(spark, "ingest")
    render.payload_docs(spark, sf_dir).write.option("compression", "gzip").json(f"{base}/inbox")
    ingest.start_ingest(
        spark, f"{base}/inbox", f"{base}/out", f"{base}/checkpoint", RUN_TS).awaitTermination()
    return sinks.current_documents(spark, f"{base}/out/documents").select(
        "id", "doc_id", "document_no", "vendor", "totals.grand_total", "line_item_count")


@query(FACTS + """
SELECT count(*) AS documents, count(*) FILTER (has_cdm) AS successes, count(*) FILTER (errors = '') AS valid,
       sum(CASE WHEN errors = '' THEN 0 ELSE 1 + length(errors) - length(replace(errors, ',', '')) END)::BIGINT AS errors
FROM g
""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that the writing jobs of two batches have observed."""
    base = files.scratch_dir(spark, "totals")
    docs = render.payload_docs(spark, sf_dir)
    for batch in range(2):
        part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == batch)
        sinks.write_results(normalize_payloads(part, RUN_TS), f"{base}/results", f"{base}/totals", RUN_TS, RUN_TS, batch)
    return sinks.run_totals(spark, f"{base}/totals").drop("run")


@query("""
SELECT o_custkey::VARCHAR AS vendor, o_orderpriority || '/' || o_orderstatus AS document_no,
       arg_min(o_orderkey, (o_orderkey % 300, o_orderkey)) AS doc_id
FROM orders GROUP BY 1, 2
""")
def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest arrival of each key, with its document: three deliveries in as many micro-batches, a restart
    after the first, and for the third a new checkpoint, which meets all three again."""
    base = files.scratch_dir(spark, "first")
    arrivals = _arrivals(spark, sf_dir).withColumn("part", F.expr("cast(doc_id % 300 div 100 as int)"))
    for part in range(3):
        arrivals.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/inbox")
        docs = spark.readStream.schema(_ARRIVAL).option("maxFilesPerTrigger", 1).parquet(f"{base}/inbox")
        dedup.start_first_arrivals(docs, f"{base}/out", f"{base}/checkpoint-{part // 2}").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("vendor", "document_no", "doc_id")


@query("""
SELECT DISTINCT o_custkey::VARCHAR AS vendor, o_orderpriority || '/' || o_orderstatus AS document_no
FROM orders
""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = files.scratch_dir(spark, "dedup")
    _arrivals(spark, sf_dir).write.parquet(f"{base}/inbox")
    docs = spark.readStream.schema(_ARRIVAL).parquet(f"{base}/inbox")
    dedup.first_arrivals(docs).writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("vendor", "document_no")


@query("""
WITH e AS (SELECT ts, value FROM events WHERE event_type = 'error'),
s AS (SELECT date_trunc('minute', ts) - to_minutes(i) AS w, value
      FROM e, (SELECT unnest([0, 1, 2, 3, 4]) AS i)),
a AS (SELECT w, avg(value) AS average FROM s GROUP BY w)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, round(average, 4) AS average
FROM a WHERE average > 100
""")
def stream_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows: a heartbeat after the last event closes those that the watermark has not reached."""
    base = files.scratch_dir(spark, "alert")
    table = render.table(spark, sf_dir, "events")
    events = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    errors = alert.with_heartbeats(events.filter("event_type = 'error'"), f"{base}/heartbeats")
    windows = alert.high_average(errors, limit=100.0).writeStream.format("parquet").option(
        "path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    windows.start().awaitTermination()
    last = table.filter("event_type = 'error'").agg(F.max("ts").cast("string")).first()[0]
    if last is not None:
        alert.heartbeat(spark, f"{base}/heartbeats", last)
        windows.start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.round("average", 4).alias("average"))
