"""Expected results in SQL over the source tables. The SQL works out from the order tables
what the rendered documents state; it never repeats how they are read."""

from __future__ import annotations

# What the documents of `render.payload_docs` and `render.text_docs` state.
FACTS = """
WITH f AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d,
         o_orderpriority AS priority, CAST(floor(o_totalprice) AS BIGINT) AS yen,
         'D' || o_orderkey AS doc_id, (o_orderkey % 5 = 0) AS is_po,
         (o_orderkey % 17 = 5 OR o_orderkey % 31 = 8) AS unknown,
         (o_orderkey % 37 = 20) AS broken,
         CASE WHEN k % 13 <> 0 THEN (CASE WHEN is_po THEN 'PO-' ELSE 'INV-' END)
              || year(d) || '-' || printf('%06d', k) END AS number,
         yen * 10 // 11 AS sub,
         yen + (CASE WHEN k % 29 = 6 THEN 1 ELSE 0 END) AS total,
         yen - sub + (CASE WHEN k % 11 = 3 THEN 100 ELSE 0 END) AS tax,
         (k % 7 <> 0) AS split,
         CASE WHEN is_po THEN d + CAST(k % 40 AS INTEGER) - 5
              ELSE d + CAST(k % 120 AS INTEGER) - 10 END AS later,
         k % 3 AS style,
         sub - sub // 3 AS line1,
         sub // 3 + (CASE WHEN k % 9 = 4 THEN 100 ELSE 0 END) AS line2,
         (k % 19 = 7) AS line_bad, (k % 23 = 11) AS later_empty,
         CASE c % 6 WHEN 0 THEN '株式会社エグザンプル' WHEN 1 THEN '株式会社サンプル商事'
              WHEN 2 THEN 'テスト工業株式会社' WHEN 3 THEN 'デモシステム合同会社'
              WHEN 4 THEN '有限会社　山田工務店' END AS vendor,
         CASE WHEN k % 6 = 0 THEN 'USD' WHEN k % 6 = 1 THEN 'YEN1' ELSE 'JPY' END AS currency,
         CASE WHEN unknown THEN NULL WHEN is_po THEN 'PURCHASE_ORDER' ELSE 'INVOICE' END AS doc_type,
         (0.5::DOUBLE * (CASE WHEN doc_type IS NULL THEN 0 ELSE 1 END)
          + 0.3::DOUBLE * (CASE WHEN vendor IS NULL THEN 0 ELSE 1 END)) AS conf_base,
         (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)
          + (CASE WHEN k % 31 = 8 OR (NOT unknown AND number IS NOT NULL) THEN 1 ELSE 0 END) AS words,
         -- totals as the fixed synonyms read them: 円 makes an amount unreadable
         CASE WHEN style <> 1 THEN total END AS t_total,
         CASE WHEN style = 1 THEN NULL WHEN split THEN sub::DOUBLE
              ELSE round_even(total / 1.1::DOUBLE, 0) END AS t_sub,
         CASE WHEN style = 1 THEN NULL WHEN split THEN tax::DOUBLE
              ELSE total - round_even(total / 1.1::DOUBLE, 0) END AS t_tax
  FROM orders
), g AS (
  SELECT *, CASE WHEN broken THEN 'extract_failed:doc' WHEN doc_type IS NULL
                 THEN 'classify_failed:doc' ELSE concat_ws(',',
    CASE WHEN number IS NULL THEN 'schema_required:doc' END,
    CASE WHEN currency = 'YEN1' THEN 'schema_pattern:doc.currency' END,
    CASE WHEN later_empty AND NOT is_po THEN 'schema_type:doc.due_date' END,
    CASE WHEN later_empty AND is_po THEN 'schema_type:doc.delivery_date' END,
    CASE WHEN line_bad THEN 'schema_type:lines.1.unit_price' END,
    CASE WHEN line_bad THEN 'schema_type:lines.1.amount' END,
    CASE WHEN abs(t_sub + t_tax - t_total) > 1 THEN 'amount_mismatch:totals.grand_total' END,
    CASE WHEN abs(line1 + (CASE WHEN line_bad THEN 0 ELSE line2 END) - t_sub) > 10
         THEN 'line_total_mismatch:totals.subtotal' END,
    CASE WHEN NOT is_po AND NOT later_empty AND later < d
         THEN 'due_before_issue:doc.due_date' END,
    CASE WHEN NOT is_po AND NOT later_empty AND later - d > 90
         THEN 'payment_terms_exceeded:doc.due_date' END,
    CASE WHEN number IS NULL THEN 'required_missing:doc.document_no' END,
    CASE WHEN vendor IS NULL THEN 'required_missing:doc.vendor' END,
    CASE WHEN t_total IS NULL THEN 'required_missing:totals.grand_total' END,
    CASE WHEN currency = 'YEN1' THEN 'pattern:doc.currency' END,
    CASE WHEN later_empty AND NOT is_po THEN 'system_error:doc'
         WHEN currency = 'YEN1' THEN 'format_currency:doc.currency' END) END AS errors,
    doc_type IS NOT NULL AND NOT broken AS has_cdm
  FROM f
)
"""

# What the documents of `render.cdm_docs` hold.
CDM = """
WITH f AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d,
         CAST(floor(o_totalprice) AS BIGINT) AS yen, 'D' || o_orderkey AS doc_id,
         (o_orderkey % 5 = 0) AS is_po, yen * 10 // 11 AS sub, yen - sub AS t,
         CASE WHEN is_po THEN d + CAST(k % 40 AS INTEGER) - 5
              ELSE d + CAST(k % 120 AS INTEGER) - 10 END AS later,
         CASE WHEN is_po THEN 'PURCHASE_ORDER' ELSE 'INVOICE' END AS doc_type,
         CASE c % 6 WHEN 0 THEN '株式会社エグザンプル' WHEN 1 THEN '株式会社サンプル商事'
              WHEN 2 THEN 'テスト工業株式会社' WHEN 3 THEN 'デモシステム合同会社'
              WHEN 4 THEN '有限会社　山田工務店' END AS vendor,
         CASE k % 13 WHEN 0 THEN NULL WHEN 4 THEN NULL
              WHEN 1 THEN '請求-' || year(d) || '-' || printf('%03d', k)
              WHEN 2 THEN repeat('A', 51) WHEN 3 THEN ''
              ELSE (CASE WHEN is_po THEN 'PO-' ELSE 'INV-' END) || year(d) || '-'
                   || printf('%06d', k) END AS number,
         CASE k % 11 WHEN 0 THEN strftime(d, '%Y/%m/%d') WHEN 1 THEN NULL
              ELSE strftime(d, '%Y-%m-%d') END AS issue_text,
         CASE WHEN k % 11 NOT IN (0, 1) THEN d END AS issue,
         CASE WHEN NOT is_po THEN later END AS due, CASE WHEN is_po THEN later END AS delivery,
         CASE k % 6 WHEN 0 THEN 'usd' WHEN 1 THEN 'CHF' ELSE 'JPY' END AS currency,
         sub::DOUBLE AS subtotal,
         CASE k % 7 WHEN 0 THEN NULL WHEN 2 THEN t + 1.0::DOUBLE WHEN 3 THEN t + 1.01::DOUBLE
              WHEN 4 THEN 0.0::DOUBLE WHEN 5 THEN t + 100.0::DOUBLE
              WHEN 6 THEN round_even(sub * 0.08::DOUBLE, 0) ELSE t::DOUBLE END AS tax,
         CASE k % 17 WHEN 3 THEN -1.0::DOUBLE WHEN 4 THEN 0.0::DOUBLE
              WHEN 5 THEN 999999999.0::DOUBLE WHEN 6 THEN 1000000000.0::DOUBLE
              ELSE yen::DOUBLE END AS grand_total,
         (sub - sub // 3)::DOUBLE AS line1,
         CASE WHEN k % 19 <> 7 THEN (sub // 3)::DOUBLE + (CASE k % 9 WHEN 4 THEN 10.0::DOUBLE
              WHEN 5 THEN 10.01::DOUBLE ELSE 0.0::DOUBLE END) END AS line2,
         (k % 143 = 4) AS null_number, (k % 143 = 1) AS null_issue
  FROM orders
)
"""


def codes(*cases: tuple[str, str]) -> str:
    """Error codes whose condition holds, joined in order."""
    parts = [f"CASE WHEN {condition} THEN '{code}' END" for condition, code in cases]
    return "concat_ws(',', " + ", ".join(parts) + ")"


def cdm_errors(*cases: tuple[str, str]) -> str:
    return f"{CDM} SELECT doc_id, {codes(*cases)} AS errors FROM f"


def wide(column: str, chars: str = "0123456789") -> str:
    """Full-width form of the digits (or more) of a text."""
    target = "".join(chr(ord(ch) + 0xFEE0) for ch in chars)
    return f"translate({column}, '{chars}', '{target}')"
