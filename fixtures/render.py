"""Business documents rendered from the order tables, as input for queries and benchmarks.

One document per order or per order line, built inside its row from a few narrow columns. Only these are
dealt to tasks; the documents are neither stored nor shuffled. Remainders of the order and customer key vary the documents: type, vendor
line, date and amount notation, and the faults that the checks have to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from denpyo.functions.text import DIGITS, WIDE_DIGITS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents that one task renders.
TASK_DOCS = 100_000


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt to a number of tasks that grows with them: the test tables are single row
    groups, which only one task can read. Partitions follow the rows' values, so a lost task finds
    the same ones again."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_DOCS))
    return rows.repartition(tasks, *rows.columns)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"))


def _mod(c: str, n: int) -> Column:
    return F.col(c) % n


def date_text(d: Column, style: Column) -> Column:
    """ISO, era, full-width year-month-day or slash notation."""
    y, m, day = F.year(d), F.month(d), F.dayofmonth(d)
    western = F.format_string("%d年%d月%d日", y, m, day)
    return (
        F.when(style == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(style == 1, F.format_string("平成%d年%d月%d日", y - 1988, m, day))
        .when(style == 2, F.translate(western, DIGITS, WIDE_DIGITS))
        .otherwise(F.date_format(d, "yyyy/M/d"))
    )


def amount_text(n: Column, style: Column) -> Column:
    """¥1,234 or ￥1,234円 or full-width digits."""
    plain = F.format_number(n, 0)
    return (
        F.when(style == 0, F.concat(F.lit("¥"), plain))
        .when(style == 1, F.concat(F.lit("￥"), plain, F.lit("円")))
        .otherwise(F.translate(plain, DIGITS, WIDE_DIGITS))
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that the documents state, from `orders` alone."""
    o = orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("priority"),
        F.floor("o_totalprice").cast("bigint").alias("yen"),
    )
    po = _mod("k", 5) == 0
    facts = o.withColumns({
        "doc_id": F.concat(F.lit("D"), F.col("k").cast("string")),
        "is_po": po,
        "unknown": (_mod("k", 17) == 5) | (_mod("k", 31) == 8),
        "number": F.when(_mod("k", 13) != 0, F.format_string(
            "%s-%d-%06d", F.when(po, "PO").otherwise("INV"), F.year("d"), F.col("k"))),
        "sub": F.expr("yen * 10 div 11"),
        "total": F.col("yen") + (_mod("k", 29) == 6).cast("bigint"),
        "split": _mod("k", 7) != 0,
        "later": F.when(po, F.expr("date_add(d, cast(k % 40 as int) - 5)"))
                  .otherwise(F.expr("date_add(d, cast(k % 120 as int) - 10)")),
        "date_style": _mod("k", 4),
        "style": _mod("k", 3),
    })
    return facts.withColumns({
        "tax": F.col("yen") - F.col("sub") + F.when(_mod("k", 11) == 3, 100).otherwise(0),
        "line1": F.col("sub") - F.expr("sub div 3"),
        "line2": F.expr("sub div 3") + F.when(_mod("k", 9) == 4, 100).otherwise(0),
        "vendor_line": F.when(_mod("c", 6) == 0, "株式会社エグザンプル 本社")
            .when(_mod("c", 6) == 1, "TEL: 06-9876-5432")
            .when(_mod("c", 6) == 2, "連絡先 info@test-ind.co.jp")
            .when(_mod("c", 6) == 3, "福岡県福岡市中央区天神1-1")
            .when(_mod("c", 6) == 4, "有限会社　山田工務店"),
    })


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(label + ": "), value, F.lit("\n")))


def content() -> Column:
    """Full text of a document over `order_facts`."""
    head = (
        F.when(_mod("k", 31) == 8, "請求書 兼 発注書\n請求番号と発注番号の控え\n")
        .when(F.col("unknown"), "見積書\n")
        .when(F.col("is_po"), F.concat(F.lit("発注書\n"), _text(_line("発注番号", F.col("number")))))
        .otherwise(F.concat(F.lit("請求書\n"), _text(_line("請求番号", F.col("number")))))
    )
    later = F.when(~F.col("unknown"), F.concat(
        F.when(F.col("is_po"), "納期").otherwise("支払期限"), F.lit(": "),
        date_text(F.col("later"), F.col("date_style")), F.lit("\n")))
    split = F.col("split")
    return F.concat(
        head,
        _line("発行日", date_text(F.col("d"), F.col("date_style"))),
        _text(later),
        F.when(F.col("vendor_line").isNotNull(), F.concat(F.col("vendor_line"), F.lit("\n")))
        .otherwise(""),
        F.when(_mod("k", 2) == 0, "金額の内訳\n").otherwise(""),
        F.when(_mod("k", 3) == 0, "日付の欄\n").otherwise(""),
        _text(_line("小計", F.when(split, amount_text(F.col("sub"), F.col("style"))))),
        _text(_line("消費税(10%)", F.when(split, amount_text(F.col("tax"), F.col("style"))))),
        _line("合計", amount_text(F.col("total"), F.col("style"))),
    )


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text) per order."""
    return order_facts(spark, sf_dir).select("doc_id", content().alias("raw_text"))


def _field(name: str, value: Column, confidence: Column) -> Column:
    entry = F.struct(value.alias("content"), confidence.alias("confidence"))
    return F.struct(F.lit(name).alias("key"), F.when(value.isNotNull(), entry).alias("value"))


def _pair(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(
        F.struct(F.lit(key).alias("content")).alias("key"),
        F.struct(value.alias("content")).alias("value")))


def _cells(rows: list[list[Column]], index: tuple[int, ...] | None = None) -> Column:
    """Cells of all rows; `index` gives the rows' numbers if they are not consecutive."""
    return F.array(*[
        F.struct(F.lit(i).alias("rowIndex"), F.lit(j).alias("columnIndex"), c.alias("content"))
        for i, row in zip(index or range(len(rows)), rows) for j, c in enumerate(row)
    ])


def _table(rows: list[list[Column]]) -> Column:
    return F.struct(
        F.lit(len(rows)).alias("rowCount"), F.lit(len(rows[0])).alias("columnCount"),
        _cells(rows).alias("cells"))


def _words(*names: str) -> list[Column]:
    return [F.lit(n) for n in names]


def payload_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, payload) per order; a few payloads are cut off and are no JSON."""
    style, date_style, split = F.col("style"), F.col("date_style"), F.col("split")
    number = F.concat(F.lit("  "), F.lower("number"), F.lit("　"))
    score = F.lit(0.98) - (_mod("k", 4) * 5) / 100.0
    later = F.when(_mod("k", 23) == 11, "").otherwise(date_text(F.col("later"), date_style))
    fields = [
        _field("InvoiceNumber", F.when(~F.col("is_po"), number), score),
        _field("PurchaseOrderNumber", F.when(F.col("is_po"), number), score),
        _field("IssueDate", date_text(F.col("d"), date_style), score - 0.05),
        _field("TotalAmount", amount_text(F.col("yen"), style), F.lit(0.93)),
        _field("SubTotal", F.when(split, amount_text(F.col("sub"), style)), F.lit(0.9)),
        _field("Tax", F.when(split, amount_text(F.col("tax"), style)), F.lit(0.65)),
        _field("DeliveryDate", F.when(F.col("is_po"), later), F.lit(0.8)),
        _field("DueDate", F.when(~F.col("is_po"), later), F.lit(0.8)),
    ]
    fields_map = F.map_from_entries(F.filter(F.array(*fields), lambda e: e["value"].isNotNull()))
    customer = F.concat(
        F.when(_mod("k", 10) == 3, "Client#").otherwise("Customer#"),
        F.format_string("%09d", F.col("c")))
    pairs = F.array_compact(F.array(
        _pair("通貨", F.when(_mod("k", 6) == 0, "usd").when(_mod("k", 6) == 1, "yen1")),
        _pair("TotalAmount", F.when(
            _mod("k", 29) == 6, amount_text(F.col("total"), style))),
        _pair("備考", F.lit("初回")),
        _pair("請求先", F.when(~F.col("is_po"), customer)),
        _pair("担当者", F.concat(F.lit("部署　"), F.col("priority"))),
        _pair("備考", F.repeat(F.concat(F.col("priority"), F.lit("/")), 20)),
        _pair("空欄", F.lit("")),
    ))
    amount2 = F.concat(
        F.format_number("line2", 0), F.when(_mod("k", 19) == 7, "円").otherwise(""))
    lines = _table([
        _words("品目", "数量", "単価", "金額"),
        [F.lit("設計費"), F.lit("2"), F.format_string("¥%.1f", F.col("line1") / 2.0),
         F.concat(F.lit("¥"), F.format_number("line1", 0))],
        [F.lit("保守費"), F.lit("1"), amount2, amount2],
        _words("", "", "備考のみ", ""),
    ])
    result = F.struct(
        F.array(F.struct(fields_map.alias("fields"))).alias("documents"),
        F.array(lines).alias("tables"),
        pairs.alias("keyValuePairs"),
        content().alias("content"),
    )
    payload = F.to_json(F.struct(result.alias("analyzeResult")))
    whole = order_facts(spark, sf_dir).select("doc_id", "k", payload.alias("payload"))
    cut = F.expr("left(payload, length(payload) div 2)")
    return whole.select(
        "doc_id", F.when(_mod("k", 37) == 20, cut).otherwise(F.col("payload")).alias("payload"))


def line_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc_type, payload) per order line: a table with a header that is Japanese,
    English or unknown by line number, rows that are no data, and a second small table."""
    x = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate",
    )).withColumns({
        "qty": F.col("l_quantity").cast("bigint"),
        "cents": F.round(F.col("l_extendedprice") * 100).cast("bigint"),
    })
    h = _mod("l_linenumber", 3)

    def head(japanese: str, english: str) -> Column:
        return F.when(h == 0, japanese).when(h == 1, english).otherwise("列")

    def number(label: str, name: str) -> Column:
        return F.concat(F.lit(label), F.coalesce(F.col(name).cast("string"), F.lit("null")))

    amount = F.format_number(F.col("cents") / 100.0, 2)
    ship = F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = [
        [head("品 目", "Description"), head("数量", "【Quantity】"), head("単価", "UnitPrice"),
         head("金額", "Amount"), head("小計", "LineTotal"), head("納期", "DeliveryDate")],
        [number("部品 ", "l_partkey"), F.col("qty").cast("string"),
         number("￥", "l_suppkey"), amount,
         F.when(_mod("l_partkey", 2) == 0, F.lit("")).otherwise(F.lit("1,000")), ship],
        [F.lit("小計行"), F.lit("　"), F.lit(""), F.lit(" "), F.lit(""), F.lit("")],
        [F.lit("送料"), F.lit("一式"), F.lit(""), F.lit("$5.5"), F.lit(""), F.lit("")],
    ]
    # Row 2 of the cells carries index 5, which still starts a new row.
    cells = _cells(rows, index=(0, 1, 5, 3))
    bare = F.struct(F.lit(None).cast("int").alias("rowCount"),
                    F.lit(None).cast("int").alias("columnCount"), cells.alias("cells"))
    single = _table([_words("摘要", "数量")])
    result = F.struct(F.array(bare, single).alias("tables"))
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("doc_id"),
        F.when(_mod("l_orderkey", 2) == 0, "INVOICE").otherwise("PURCHASE_ORDER").alias("doc_type"),
        F.to_json(F.struct(result.alias("analyzeResult"))).alias("payload"),
    )


def supplier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text) per order naming a supplier, or none."""
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderpriority")
    name = F.format_string("Supplier#%09d", F.expr("o_custkey div 10"))
    body = F.when(_mod("o_orderkey", 8) == 0, F.lit("発行元の記載なし")).otherwise(
        F.concat(F.lit("発行元："), name, F.lit(" 御中")))
    return o.select(
        F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("doc_id"),
        F.concat(F.lit("納品書\n"), body, F.lit("\n担当 "), F.col("o_orderpriority")).alias("raw_text"),
    )


def vendor_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, id, normalized_name, additional_info) from `supplier`."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_name").alias("name"),
        F.format_string("V%06d", F.col("s_suppkey")).alias("id"),
        F.when(_mod("s_suppkey", 3) != 0, F.upper("s_name")).alias("normalized_name"),
        F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("additional_info"),
    )


def customer_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, id, normalized_name) from `customer`."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_name").alias("name"),
        F.format_string("C%06d", F.col("c_custkey")).alias("id"),
        F.lower("c_name").alias("normalized_name"),
    )


VENDOR_OF_REMAINDER = ["株式会社エグザンプル", "株式会社サンプル商事", "テスト工業株式会社",
                       "デモシステム合同会社", "有限会社　山田工務店"]


def _choose(selector: Column, cases: dict[int, Column], otherwise: Column) -> Column:
    out = otherwise
    for value, result in cases.items():
        out = F.when(selector == value, result).otherwise(out)
    return out


def cdm_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical documents per order with the faults and limits that the checks look for."""
    f = order_facts(spark, sf_dir).select(
        "k", "c", "d", "yen", "sub", "later", "is_po", "doc_id", "line1",
        (F.col("yen") - F.col("sub")).cast("double").alias("t"))
    null = F.lit(None)
    regular = F.format_string(
        "%s-%d-%06d", F.when(F.col("is_po"), "PO").otherwise("INV"), F.year("d"), F.col("k"))
    iso = F.date_format("d", "yyyy-MM-dd")
    later = F.date_format("later", "yyyy-MM-dd")
    flat = f.withColumns({
        "doc_type": F.when(F.col("is_po"), "PURCHASE_ORDER").otherwise("INVOICE"),
        "vendor": _choose(_mod("c", 6), {i: F.lit(v) for i, v in enumerate(VENDOR_OF_REMAINDER)},
                          null.cast("string")),
        "document_no": _choose(_mod("k", 13), {
            0: null, 1: F.format_string("請求-%d-%03d", F.year("d"), F.col("k")),
            2: F.repeat(F.lit("A"), 51), 3: F.lit(""), 4: null}, regular),
        "issue_date": _choose(_mod("k", 11), {0: F.date_format("d", "yyyy/MM/dd"), 1: null}, iso),
        "due_date": F.when(~F.col("is_po"), later),
        "delivery_date": F.when(F.col("is_po"), later),
        "currency": _choose(_mod("k", 6), {0: F.lit("usd"), 1: F.lit("CHF")}, F.lit("JPY")),
        "customer_name": F.format_string("Customer#%09d", F.col("c") * 2),
        "subtotal": F.col("sub").cast("double"),
        "tax": _choose(_mod("k", 7), {
            0: null.cast("double"), 2: F.col("t") + 1.0, 3: F.col("t") + 1.01, 4: F.lit(0.0),
            5: F.col("t") + 100.0, 6: F.bround(F.col("sub") * 0.08, 0)}, F.col("t")),
        "grand_total": _choose(_mod("k", 17), {
            3: F.lit(-1.0), 4: F.lit(0.0), 5: F.lit(999999999.0), 6: F.lit(1000000000.0)},
            F.col("yen").cast("double")),
        "amount2": F.when(_mod("k", 19) != 7, (F.col("sub") - F.col("line1")).cast("double") + _choose(
            _mod("k", 9), {4: F.lit(10.0), 5: F.lit(10.01)}, F.lit(0.0))),
        "confidence": F.lit(0.5) + _mod("k", 6) / 10.0,
        "null_targets": _choose(_mod("k", 143), {
            4: F.array(F.lit("document_no")), 1: F.array(F.lit("issue_date"))},
            F.array().cast("array<string>")),
    })

    def line(description: str, amount: Column, unread: Column) -> Column:
        return F.struct(
            F.lit(description).alias("description"), F.lit(1.0).alias("qty"),
            amount.alias("unit_price"), amount.alias("amount"), F.lit(0.10).alias("tax_rate"),
            F.lit(None).cast("string").alias("delivery_date"), unread.alias("unparsed"))

    nothing = F.create_map().cast("map<string,string>")
    unread = F.when(F.col("amount2").isNull(), F.create_map(F.lit("amount"), F.lit("5円")))
    return flat.select(
        "doc_id", "doc_type", "vendor", "confidence", "null_targets",
        F.lit(True).alias("extracted"),
        F.struct(
            F.col("doc_type").alias("type"), F.lit("1.0").alias("schema_version"),
            F.lit("2024-02-01T00:00:00").alias("extraction_timestamp"), "vendor", "document_no",
            "issue_date", "due_date", "delivery_date", "currency", "customer_name",
        ).alias("doc"),
        F.array(line("設計費", F.col("line1").cast("double"), nothing),
                line("保守費", F.col("amount2"), F.coalesce(unread, nothing))).alias("lines"),
        F.struct("subtotal", "tax", "grand_total").alias("totals"),
        F.struct(
            F.map_from_arrays(
                F.array(*_words("InvoiceNumber", "TotalAmount", "発行日", "備考")),
                F.array(F.lit(1.0) - _mod("k", 3) / 10.0, F.lit(1.0) - _mod("k", 4) / 10.0,
                        F.lit(0.95), F.lit(0.5) + _mod("k", 5) / 10.0)).alias("confidence_scores"),
            F.array().cast("array<struct<field:string,value:string,source:string>>")
            .alias("unmapped_fields"),
        ).alias("metadata"),
    )


def hard_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, payload) per order with values that a fixed schema reads wrongly: amounts of ten
    million and more, nesting of four levels, repeated keys, fields that are no objects."""
    o = order_facts(spark, sf_dir).select("doc_id", "k", "yen", "number")
    nested = (
        '{"type":"object","valueObject":{"bank":{"valueObject":{"branch":{"valueObject":{"account":'
        '{"valueObject":{"holder":{"content":"H%d","confidence":0.5}}}}}}}}}')
    items = '{"valueArray":["a%d",{"type":"string","valueString":"x"},7]}'
    fields = F.format_string(
        '{"TotalAmount":{"valueNumber":%d.0},"Small":{"valueNumber":0.5},"Whole":{"valueNumber":%d},'
        '"Pay":' + nested + ',"Items":' + items + ',"Plain":"text %d","Pay2":{"valueObject":'
        '{"a":{"content":"1"},"a":{"content":"2"}}},"Twice":{"content":"first"},"Twice":{"content":"K%d"}}',
        F.col("yen") + 10_000_000, F.col("yen") + 20_000_000, "k", "k", "k", "k")
    payload = F.concat(
        F.lit('{"analyzeResult":{"documents":[{"fields":'), fields,
        F.lit('}],"tables":[{"rowCount":2.0,"cells":[{"rowIndex":0.0,"columnIndex":0.0,"content":"h"},'
              '{"rowIndex":1.0,"columnIndex":0.0,"content":"c"}]}],"content":"請求書 請求番号"}}'))
    return o.select("doc_id", payload.alias("payload"))


def repeated_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`payload_docs`, some of them twice: the second under the id with a letter behind."""
    docs = payload_docs(spark, sf_dir)
    again = docs.filter(F.substring("doc_id", 2, 18).cast("bigint") % 41 == 7)
    return docs.union(again.select(F.concat("doc_id", F.lit("b")).alias("doc_id"), "payload"))


def wide_line_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc_type, vendor, payload) per order: lines with columns that only rules know."""
    o = order_facts(spark, sf_dir).select("doc_id", "k")
    rows = [
        _words("品目", "品番", "税率", "数量"),
        [F.lit("部材"), F.format_string("P-%d", F.col("k")),
         F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "0.08").otherwise("軽減"), F.lit("2")],
    ]
    result = F.struct(F.array(_table(rows)).alias("tables"))
    return o.select(
        "doc_id", F.lit("INVOICE").alias("doc_type"), F.when(F.col("k") % 2 == 0, "A社").alias("vendor"),
        F.to_json(F.struct(result.alias("analyzeResult"))).alias("payload"))
