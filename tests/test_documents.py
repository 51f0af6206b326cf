"""Small documents whose results follow from the rules alone."""

import json

from pyspark.sql import functions as F

from denpyo import rules
from denpyo.operators import (
    classify, duplicates, extract, lines, mapping, resolve, skew, text_fields, validate, vendor_table,
)
from denpyo.plans.normalize import normalize_payloads, normalize_texts
from denpyo.sources import files, sinks

RUN_TS = "2024-02-01T00:00:00"

INVOICE = """請求書

請求番号: INV-2024-TEST-001
発行日: 令和6年1月15日
支払期限: 令和6年2月15日

株式会社サンプル
〒100-0001 東京都千代田区千代田1-1-1
TEL: 03-1234-5678

小計: ¥50,000
消費税(10%): ¥5,000
合計: ¥55,000

金額
お振込先: ××銀行 ××支店
"""


def texts(spark, *bodies):
    rows = [(f"t{i}", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "doc_id string, raw_text string")


def test_sample_invoice(spark):
    r = normalize_texts(texts(spark, INVOICE), RUN_TS).first()
    assert (r.doc_type, r.vendor, round(r.confidence, 4)) == ("INVOICE", "株式会社エグザンプル", 0.9333)
    assert (r.doc.document_no, r.doc.issue_date, r.doc.due_date) == (
        "INV-2024-TEST-001", "2024-01-15", "2024-02-15")
    assert (r.totals.subtotal, r.totals.tax, r.totals.grand_total) == (50000.0, 5000.0, 55000.0)
    assert r.doc.vendor_phone == "03-1234-5678"
    assert r.is_valid, r.errors


def test_types_and_vendors(spark):
    docs = texts(
        spark, "請求書 発注書 請求番号 発注番号", "invoice", "ＩＮＶＯＩＣＥ payment", "purchase\norder delivery",
        "Invoice and PAYMENT", "06 9876 5432", "合同会社　やま田 様", "何もなし")
    got = classify.with_classification(docs).select("doc_type", "vendor").collect()
    assert [r.doc_type for r in got] == [
        None, None, None, "PURCHASE_ORDER", "INVOICE", None, None, None]
    assert got[5].vendor == "株式会社サンプル商事"
    assert got[6].vendor == "合同会社　やま田"
    assert got[7].vendor is None


def test_vendor_config_skips_text_entries(spark):
    config = {"description": "text", **rules.VENDOR_PATTERNS}
    col = classify.vendor_by_patterns(F.lit("Demo Systems LLC"), config)
    assert spark.range(1).select(col).first()[0] == "デモシステム合同会社"


def test_vendor_master_lengths(spark):
    docs = texts(spark, "納品 山田 商店", "株式会社山田商店 本社", "鈴木", "株式会社山田")
    patterns = spark.createDataFrame(
        [(2, 0, "A", "山田"), (1, 0, "B", "株式会社山田商店"), (3, 0, "C", "株式会社山田")],
        "vendor_ord int, pat_ord int, vendor string, pattern string")
    got = {r.doc_id: r.vendor for r in classify.match_vendor_master(docs, patterns).collect()}
    assert got == {"t0": "A", "t1": "B", "t2": None, "t3": "A"}


def payload(**parts):
    return json.dumps({"analyzeResult": parts}, ensure_ascii=False)


def extracted(spark, *payloads):
    df = spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(payloads)],
                               "doc_id string, payload string")
    return extract.with_extraction(df).collect()


def test_payload_values(spark):
    fields = {
        "a": {"content": None, "valueString": "later"}, "b": {"valueNumber": 5, "confidence": 0.5},
        "c": {"valueObject": {"x": {"content": "1"}}}, "d": {"confidence": 0.9},
        "e": {"valueArray": ["p", "q"]}, "f": {"valueString": "s"},
    }
    pairs = [
        {"key": {"content": k}, "value": {"content": v}}
        for k, v in (("f", "kv"), ("n", "1"), ("m", ""), ("", "x"), ("n", "2"))
    ]
    r, none, bad = extracted(
        spark, payload(documents=[{"fields": fields}, {"fields": {"z": {"content": "no"}}}],
                       keyValuePairs=pairs, content="text"),
        payload(), "{not json")
    assert [(e.key, e.value, e.source) for e in r.entries] == [
        ("a", None, "fields"), ("b", "5", "fields"), ("c", '{"x":"1"}', "fields"),
        ("e", '["p","q"]', "fields"), ("f", "kv", "fields"), ("n", "2", "key_value_pairs")]
    assert r.conf == {"b": 0.5, "d": 0.9} and r.raw_text == "text"
    assert none.extracted and none.entries == [] and none.tables == []
    assert not bad.extracted


def test_table_rows(spark):
    def cell(row, column, text):
        return {"rowIndex": row, "columnIndex": column, "content": text}

    cells = [cell(3, 0, "a"), cell(3, 1, "b"), cell(1, 1, "c"), cell(3, 0, "d")]
    r, = extracted(spark, payload(tables=[{"cells": cells}, {"cells": []}, {"rowCount": 9}]))
    assert [t.rows for t in r.tables] == [[["a", "b"], ["c"], ["d"]]]
    assert (r.tables[0].row_count, r.tables[0].column_count) == (3, 2)
    c = F.from_json(F.lit(json.dumps(cells)),
                    "array<struct<rowIndex:int,columnIndex:int,content:string>>")
    assert spark.range(1).select(extract.table_rows(c, True)).first()[0] == [["a", "b"], ["", "c"], ["d"]]


def test_lookup_order_and_nulls(spark):
    entries = [("SubTotal", "10"), ("TotalAmount", "11"), ("税抜 合計", "9"), ("通貨", None)]
    df = spark.createDataFrame(
        [("d", "INVOICE", None, [(k, v, "fields", v) for k, v in entries])],
        "doc_id string, doc_type string, vendor string, entries array<struct<key:string,value:string,"
        "source:string,field_value:string>>")
    totals = lines.with_totals(df).first().totals
    # "合計" is found inside 税抜 合計, and "subtotal" equals SubTotal.
    assert (totals.grand_total, totals.subtotal) == (9.0, 10.0)
    mapped = mapping.with_mapped_fields(df).first()
    assert (mapped.t_grand_total, mapped.t_subtotal, mapped.t_currency) == (11.0, 9.0, "JPY")
    wide = mapping.lookup_long(df, mapping.rule_rows(spark)).collect()
    assert {(r.target, r.key) for r in wide} == {
        ("grand_total", "TotalAmount"), ("subtotal", "税抜 合計"), ("currency", "通貨")}


def test_rules_of_vendors_shuffle_no_documents(spark, monkeypatch):
    rows = [(f"D{i}", "INVOICE", "A社" if i % 2 else None, [("金額", str(i))]) for i in range(8)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id string, doc_type string, vendor string, "
                                 "entries array<struct<key:string,value:string>>")
    table = spark.createDataFrame(
        [("INVOICE", None, "of_type", 0, "金額"), ("INVOICE", "A社", "of_vendor", 0, "金額")],
        "doc_type string, vendor string, target string, priority int, source string")
    ruled, _ = mapping._rule_hits(docs, table, "doc_id", "doc_type", "entries")
    plan = ruled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = sorted((d, "of_vendor" if v else "of_type", "金額", e[0][1]) for d, _, v, e in rows + rows[:1])
    assert sorted(map(tuple, mapping.lookup_long(docs, table).collect())) == want
    # More layers than are broadcast.
    monkeypatch.setattr(skew, "MASTER_ROWS", 0)
    assert sorted(map(tuple, mapping.lookup_long(docs, table).collect())) == want


def test_merge_of_layers():
    base = {"a": {"from": ["x"], "default": 1}, "b": 2}
    over = {"a": {"from": ["y"], "default": 3}}
    assert mapping.merge_layers(base, over)["a"] == {"from": ["x", "y"], "default": 3}
    assert mapping.merge_layers(base, over, "override")["a"]["from"] == ["y", "x"]


def test_post_compute(spark):
    rows = [(None, None, 110000.0), (100.0, None, 110.0), (1.0, 2.0, 3.0), (None, 5.0, None), (0.0, 7.0, 110.0)]
    df = spark.createDataFrame(
        [("INVOICE", r) for r in rows], "doc_type string, totals struct<subtotal:double,tax:double,grand_total:double>")
    got = [tuple(r.totals) for r in lines.with_post_compute(df).collect()]
    assert got == [(100000.0, 10000.0, 110000.0), (100.0, 10.0, 110.0), (1.0, 2.0, 3.0),
                   (None, 5.0, None), (100.0, 10.0, 110.0)]


def test_minimal_document(spark):
    docs = classify.with_classification(texts(spark, INVOICE))
    r = text_fields.minimal_cdm(
        text_fields.with_text_fields(docs, fields=rules.LOOSE_TEXT_FIELDS), RUN_TS).first()
    assert r.doc.document_no == "INV-2024-TEST-001" and r.doc.issue_date == "2024-01-15"
    assert r.totals.grand_total == 55000.0 and r.doc.currency == "JPY"
    assert "vendor_name" in r.unmapped_fields


def test_duplicates_with_a_hot_key(spark, monkeypatch):
    """A third of the documents share vendor and number, most of them on one day."""
    hot = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("V").alias("vendor"), F.lit("N").alias("document_no"),
        F.when(F.col("id") < 2900, "2024-01-01").when(F.col("id") < 2950, "2024-12-31")
        .otherwise("2026-01-01").alias("issue_date"))
    rest = spark.range(3000, 9000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("vendor"),
        F.lit("N").alias("document_no"), F.lit("2024-01-01").alias("issue_date"))
    docs = hot.union(rest)
    for rows in (skew.HOT_ROWS, 100):
        monkeypatch.setattr(skew, "HOT_ROWS", rows)
        flagged = duplicates.flag_duplicates(docs)
        got = {r.doc_id: r.prior_doc for r in flagged.filter("is_duplicate").collect()}
        assert len(got) == 2899 + 50 + 49
        assert got[1] == 0 and got[2900] == 2899 and got[2901] == 2900 and got[2951] == 2950
    assert flagged.count() == 9000
    plan = duplicates.flag_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window")
    # The window works on the reduced days, not on documents.
    assert "Aggregate" in plan[window:]


def test_resolution(spark, monkeypatch):
    docs = spark.createDataFrame(
        [("1", ("A", None)), ("2", ("B", "K")), ("3", (None, "K"))],
        "doc_id string, doc struct<vendor:string,customer_name:string>")
    master = spark.createDataFrame(
        [("A", "2", None), ("A", "1", "Aa"), ("K", "9", None)], "name string, id string, normalized_name string")
    for rows in (skew.MASTER_ROWS, 0):
        monkeypatch.setattr(skew, "MASTER_ROWS", rows)
        out = resolve.resolve_customers(resolve.resolve_vendors(docs, master), master)
        got = {r.doc_id: (r.doc.vendor_id, r.doc.vendor_normalized, r.doc.customer_id, r.doc.customer_normalized)
               for r in out.collect()}
        assert got == {"1": ("1", "Aa", None, None), "2": (None, None, "9", "K"), "3": (None, None, "9", "K")}


def test_ingest_equals_batch(spark, tmp_path):
    from denpyo.streaming.ingest import start_ingest

    def doc(i, number):
        return payload(
            documents=[{"fields": {
                "InvoiceNumber": {"content": number, "confidence": 0.9},
                "InvoiceDate": {"content": f"2024-01-{i + 1:02d}"}, "TotalAmount": {"content": "1,100"}}}],
            content="請求書 請求番号 Example Corp")

    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    rows = [(f"d{i}", doc(i, f"N-{i % 3}")) for i in range(5)] + [("bad", "{")]
    docs = spark.createDataFrame(rows, files.RECORD_SCHEMA)
    for part in (docs.filter("doc_id < 'd3'"), docs.filter("doc_id >= 'd3'")):
        part.coalesce(1).write.mode("append").json(inbox)
        start_ingest(spark, inbox, out, str(tmp_path / "cp"), RUN_TS).awaitTermination()
    batch = normalize_payloads(docs, RUN_TS)
    valid = sinks.stored_rows(batch.filter("is_valid"), RUN_TS)
    want = {(r.id, r.doc_id) for r in sinks.latest(valid).collect()}
    for read in (sinks.read_documents(spark, f"{out}/versions"), sinks.current_documents(spark, f"{out}/documents")):
        got = {(r.id, r.doc_id) for r in read.collect()}
        assert got == want and len(got) == 3
    totals = sinks.run_totals(spark, f"{out}/totals").drop("run").first().asDict()
    assert totals == {"documents": 6, "successes": 5, "valid": 5, "errors": batch.agg(F.sum(F.size("errors"))).first()[0]}
    audit = {r.doc_id: r.success for r in spark.read.parquet(f"{out}/audit").collect()}
    assert audit == {**{f"d{i}": True for i in range(5)}, "bad": False}
    assert {r.kind for r in spark.read.text(f"{out}/artifacts").select("kind").collect()} == {
        "raw", "cdm", "validation"}
    sinks.compact_documents(spark, f"{out}/versions", str(tmp_path / "compact"))
    again = sinks.read_documents(spark, str(tmp_path / "compact")).select("id", "doc_id").collect()
    assert {tuple(r) for r in again} == want


def test_first_schema_error_only(spark):
    from fixtures import render

    docs = render.cdm_docs(spark, "/root/testdata/sf0.001")
    out = validate.with_validation(docs, first_only=True)
    worst = out.select(F.max(F.size(F.filter("errors", lambda e: e["code"].startswith("schema"))))).first()[0]
    assert worst == 1


def test_hard_payload_values(spark):
    """Single bad fields are left out, nesting has no limit, the last of repeated keys counts."""
    deep = {"content": "x"}
    for _ in range(30):
        deep = {"valueObject": {"k": deep}}
    fields = {"plain": "text", "number": 5, "deep": deep, "big": {"valueNumber": 12345678.0}, "tiny": {"valueNumber": 1e-7},
              "list": {"valueArray": [{"type": "object", "valueObject": {"a": {"content": "1"}}}, "s", {"a": {"valueNumber": 2.5}}]}}
    text = json.dumps({"analyzeResult": {"documents": [{"fields": fields}], "content": "t"}})
    twice = '{"analyzeResult":{"documents":[{"fields":{"a":{"content":"1","content":"2"},"a":{"content":"3"},' \
            '"b":{"valueObject":{"x":{"content":"1"},"x":{"content":"2"}}}}}]}}'
    first, second = extracted(spark, text, twice)
    got = {e.key: e.value for e in first.entries}
    assert first.extracted and set(got) == {"deep", "big", "tiny", "list"}
    assert got["big"] == "12345678.0" and got["list"] == '[{},"s",{"a":2.5}]'
    assert got["deep"].count('"k"') == 30 and float(got["tiny"]) == 1e-7
    assert {e.key: e.value for e in second.entries} == {"a": "3", "b": '{"x":"2"}'}


def test_selection_reaches_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", payload(content="x")) for i in range(4)], files.RECORD_SCHEMA)
    docs.write.parquet(str(tmp_path / "docs"))
    out = normalize_payloads(spark.read.parquet(str(tmp_path / "docs")), RUN_TS, where="doc_id = 'd2'")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,d2)" in plan.split("PushedFilters", 1)[1][:200]
    assert [r.doc_id for r in out.collect()] == ["d2"]


def test_broken_lines_keep_their_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id":"a","payload":"{}"}\n{"doc_id":"b", oops\n')
    rows = {r.doc_id: r for r in files.read_records(spark, str(tmp_path / "in")).collect()}
    broken = next(r for i, r in rows.items() if i != "a")
    assert len(rows) == 2 and broken.payload == '{"doc_id":"b", oops' and "a.json#" in broken.doc_id


def test_runs_do_not_replace_each_other(spark, tmp_path):
    rows = spark.createDataFrame([("k", "z-old", RUN_TS)], "id string, doc_id string, created_at string")
    newer = spark.createDataFrame([("k", "a-new", RUN_TS)], rows.schema)
    for run, batch, part in (("r1", 0, rows), ("r1", 1, newer), ("r2", 0, rows.limit(0))):
        sinks.upsert_documents(part, str(tmp_path / "t"), run, batch)
    assert [r.doc_id for r in sinks.read_documents(spark, str(tmp_path / "t")).collect()] == ["a-new"]


def test_null_text_has_no_confidence(spark):
    df = spark.createDataFrame([("a", None)], "doc_id string, raw_text string")
    assert classify.with_classification(df).first().confidence == 0.0


def test_safe_expressions():
    assert lines.safe_expression("a / b") == "try_divide(a, b)"
    assert lines.safe_expression("cast(x as int) % 2") == "try_mod(try_cast(x as int), 2)"
    assert lines.safe_expression("a / (b / c)") == "try_divide(a, (try_divide(b, c)))"
    assert lines.safe_expression("raise_error('x')") is None and lines.safe_expression("a ** / b") is None


def test_line_sums_of_large_amounts(spark):
    df = spark.createDataFrame([("a", 1e17), ("a", 0.5), ("b", 1e30), ("b", None)], "k string, amount double")
    got = {r.k: (float(r.line_total) if r.line_total is not None else None, r.line_count, r.unread_count)
           for r in lines.line_sums(df, "k", "amount").collect()}
    assert got == {"a": (1e17 + 0.5, 2, 0), "b": (None, 2, 1)}


def test_vendor_phones(spark):
    patterns = spark.createDataFrame([(0, 0, "P", "06-9876-5432", "phone_patterns"), (1, 0, "Q", "Invoice One", "company_names")],
                                     "vendor_ord int, pat_ord int, vendor string, pattern string, kind string")
    docs = texts(spark, "tel 06 9876 5432", "tel 0698765432", "tel 06-9876-5433", "Invoice One", None)
    got = {r.doc_id: r.vendor for r in classify.match_vendor_master(docs, patterns).collect()}
    assert list(got.values()).count("P") == 2 and list(got.values()).count("Q") == 1 and len(got) == 5


def test_vendor_table_rows(spark, monkeypatch):
    """Null and repeated ids, long texts, shared beginnings, several parts and passes, against plain search."""
    import random
    import re

    rng = random.Random(5)
    words = ["ab", "abc", "b-c", "Supplier#", "山田", "商店", "03-1234", "x y", "-", "🙂z"]
    patterns = [(i // 3, i % 3, f"v{i}", "".join(rng.choice(words) for _ in range(rng.randint(1, 4))),
                 rng.choice(["company_names", "phone_patterns"])) for i in range(120)]
    patterns += [(50, 0, "first", "ab", "domains"), (None, None, "last", "ab", "domains"), (7, 7, "e", "", None), (7, 8, "r", "0[36]-12+", "phone_patterns")]
    bodies = ["".join(rng.choice([*words, " ", "\n", "q", "06-122"]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    bodies += [None, "", "ab" * 3000, "q" * 2000 + "Supplier#山田" + "q" * 700, bodies[0], bodies[1]]
    rows = [(None if i % 9 == 0 else f"d{i % 100}", b) for i, b in enumerate(bodies)]

    def vendor(text):
        for _, _, name, p, kind in sorted(patterns, key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0, r[2])):
            if text is None or not p:
                continue
            loose = kind == "phone_patterns" and "-" in p
            if re.search(p.replace("-", r"[\-\s]?"), text) if loose else p in text:
                return name
        return None

    table = spark.createDataFrame(patterns, "vendor_ord int, pat_ord int, vendor string, pattern string, kind string")
    docs = spark.createDataFrame(rows, "doc_id string, raw_text string").repartition(3)
    want = sorted(((i or "", vendor(b) or "") for i, b in rows))
    for size in (vendor_table.PART_BYTES, 600):
        monkeypatch.setattr(vendor_table, "PART_BYTES", size)
        got = classify.match_vendor_master(docs, table)
        assert sorted((r.doc_id or "", r.vendor or "") for r in got.collect()) == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    none = classify.match_vendor_master(docs, table.limit(0)).collect()
    assert len(none) == len(rows) and {r.vendor for r in none} == {None}
    assert classify.match_vendor_master(docs.limit(0), table).collect() == []


def test_a_million_vendors(spark):
    names = spark.range(1_000_000).select(
        F.col("id").alias("vendor_ord"), F.lit(0).alias("pat_ord"), F.concat(F.lit("v"), "id").alias("vendor"),
        F.concat(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), F.lit(" Ltd")).alias("pattern"))
    asked = [3, 500_000, 999_999]
    chosen = {r.vendor: r.pattern for r in names.filter(F.col("vendor_ord").isin(asked)).collect()}
    docs = texts(spark, *[f"to {p} of" for p in chosen.values()], *["no vendor here " * 20] * 500)
    found = {r.doc_id: r.vendor for r in classify.match_vendor_master(docs, names).collect()}
    assert len(found) == 503 and {v for v in found.values() if v} == set(chosen)


def test_hot_names_are_spread(spark, monkeypatch):
    """Half of the rows share one name: no task of the join gets them all."""
    monkeypatch.setattr(skew, "MASTER_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 1000)
    docs = spark.range(40_000).select(F.col("id").cast("string").alias("doc_id"), F.struct(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("vendor")).alias("doc"))
    master = spark.createDataFrame([("hot", "1", None), ("n7", "2", None)], "name string, id string, normalized_name string")
    assert skew.hot_pieces(docs.select("doc.vendor"), "vendor") == {"hot": 20}
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        out = resolve.resolve_vendors(docs, master)
        tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(
            F.count_if(F.col("doc.vendor_id") == "1").alias("hot")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(t.hot for t in tasks) == 20_000 and max(t.hot for t in tasks) <= 7_000
    assert out.filter("doc.vendor_id = '2'").count() == 1


def test_merged_documents(spark, tmp_path):
    """Touched buckets alone are written again; one id is read from one bucket."""
    path = str(tmp_path / "current")
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("d0").alias("doc_id"), F.lit(RUN_TS).alias("created_at"))
    sinks.merge_documents(rows, path, "r", 0, buckets=16)
    files_of = lambda: {f for f in spark.read.parquet(path).inputFiles()}
    before = files_of()
    newer = spark.createDataFrame([("k7", "d1", RUN_TS), ("new", "d1", RUN_TS), ("k8", "d1", "2000-01-01T00:00:00")], rows.schema)
    for _ in range(2):
        sinks.merge_documents(newer, path, "r", 1, buckets=999)
    after = files_of()
    assert 13 <= len(before & after) < 16
    got = {r.id: r.doc_id for r in sinks.current_documents(spark, path).collect()}
    assert len(got) == 501 and got["k7"] == got["new"] == "d1" and got["k8"] == "d0"
    one = sinks.current_documents(spark, path, ["k7"])
    assert [r.doc_id for r in one.collect()] == ["d1"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "Join" not in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:120]


def test_first_arrivals_over_the_horizon(spark, tmp_path):
    """A key passes again beyond the horizon, rows without a key always, and a new checkpoint forgets nothing."""
    from denpyo.streaming import dedup

    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id STRING, vendor STRING, document_no STRING, arrival TIMESTAMP"

    def deliver(checkpoint, *rows):
        frame = spark.createDataFrame(list(rows), "doc_id STRING, vendor STRING, document_no STRING, arrival STRING")
        frame.withColumn("arrival", F.col("arrival").cast("timestamp")).coalesce(1).write.mode("append").parquet(inbox)
        docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        dedup.start_first_arrivals(docs, out, str(tmp_path / checkpoint), horizon_days=10).awaitTermination()
        return sorted(r.doc_id for r in spark.read.parquet(out).collect())

    assert deliver("a", ("1", "v", "n", "2024-01-02"), ("2", "v", "n", "2024-01-01"), ("3", None, "n", "2024-01-01"), ("4", "v", "", "2024-01-01")) == ["2", "3", "4"]
    assert deliver("a", ("5", "v", "n", "2024-01-11"), ("6", "v", "n", "2024-01-12"), ("7", "w", "n", "2024-01-05")) == ["2", "3", "4", "6", "7"]
    again = deliver("b", ("8", "v", "n", "2024-01-20"), ("9", "w", "n", "2024-01-30"))
    assert again == ["2", "3", "3", "4", "4", "6", "7", "9"]


def test_duplicates_of_stored_keys_are_pruned(spark, tmp_path):
    docs = spark.range(200).select(
        F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("v"), F.col("id") % 50).alias("vendor"), F.lit("n").alias("document_no"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 10).cast("int")).cast("string").alias("issue_date"))
    path = str(tmp_path / "keys")
    duplicates.key_rows(docs).write.partitionBy("vendor_bucket", "issue_month").parquet(path)
    stored = spark.read.schema("doc_id STRING, vendor STRING, document_no STRING, issue_date STRING, vendor_bucket INT, issue_month STRING").parquet(path)
    new = spark.createDataFrame([("x", "v3", "n", "2024-09-01"), ("y", None, "n", "2024-09-01")], "doc_id string, vendor string, document_no string, issue_date string")
    near = duplicates.near_keys(stored, new)
    assert "PartitionFilters: [" in near._jdf.queryExecution().executedPlan().toString()
    assert 0 < near.count() < 30
    got = {r.doc_id: r.prior_doc for r in duplicates.flag_duplicates(new, earlier=near).collect()}
    assert got == {r.doc_id: r.prior_doc for r in duplicates.flag_duplicates(new, earlier=docs).collect()}
    assert got["x"] is not None and got["y"] is None
    assert duplicates.near_keys(stored, new.filter("vendor IS NULL")).count() == 0


def test_tables_in_buckets_are_joined_without_a_shuffle(spark):
    from fixtures import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["line_totals_in_buckets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_rule_hits_joined_and_broadcast(spark, monkeypatch):
    """Both ways to look rules up give the same rows."""
    from fixtures import catalog

    rows = []
    for most in (mapping.SENT_HITS, 0):
        monkeypatch.setattr(mapping, "SENT_HITS", most)
        rows.append(sorted(map(tuple, catalog.QUERIES["rule_lookup"](spark, "/root/testdata/sf0.001").collect())))
    assert rows[0] == rows[1] and rows[0]


def test_rule_table_inside_normalization(spark, monkeypatch):
    """A table of the folded rules gives what these give, broadcast or joined, for repeated and null ids too, and
    a vendor's own rules replace those of its type."""
    from denpyo.plans.normalize import normalize_payloads
    from fixtures import render

    docs = render.payload_docs(spark, "/root/testdata/sf0.001").limit(150)
    docs = docs.union(docs.limit(5)).withColumn("doc_id", F.when(~F.col("doc_id").endswith("7"), F.col("doc_id")))
    variants = mapping.rule_variants({("INVOICE", "株式会社エグザンプル"): {"document_no": {"from": ["IssueDate"]}}}, "override")

    def rows(**options):
        out = normalize_payloads(docs, "2024-01-01", variants=variants, **options)
        return sorted(repr(r) for r in out.select("doc_id", "doc", "metadata", "null_targets", "is_valid").collect())

    want = rows()
    for most in (mapping.SENT_HITS, 0):
        monkeypatch.setattr(mapping, "SENT_HITS", most)
        assert rows(rule_table=mapping.rule_rows(spark, variants)) == want
    none = normalize_payloads(docs, "2024-01-01", rule_table=mapping.rule_rows(spark, variants).limit(0))
    assert none.count() == 155 and not none.filter("doc.document_no IS NOT NULL").count()


def test_variant_can_not_hold_nested_values(spark):
    """Why nested values go through a function: a VARIANT orders the keys of an object anew and refuses repeated
    ones, of which the last counts here."""
    df = spark.createDataFrame([('{"b":{"x":1},"a":2}', '{"a":1,"a":2}')], "ordered string, twice string")
    r = df.select(F.to_json(F.try_parse_json("ordered")).alias("ordered"), F.try_parse_json("twice").isNull().alias("refused")).first()
    assert r.ordered == '{"a":2,"b":{"x":1}}' and r.refused


def test_first_arrivals_take_rows():
    """Rows of a key one by one, without a data frame for each key; known days stop what is near to them."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from denpyo.streaming.dedup import FirstArrivals

    kept = []
    processor = FirstArrivals(10)
    days = SimpleNamespace(get=lambda: iter([(100,)]), put=kept.extend)
    processor.init(SimpleNamespace(getListState=lambda *_: days, registerTimer=kept.append))
    rows = [Row(doc_id=i, at=at, day=at // 10) for i, at in enumerate([1055, 1200, 1205, 1200, 1401])]
    got = list(processor.handleInputRows(("v", "n"), iter(rows), None))
    assert got == [Row(doc_id=1, vendor="v", document_no="n", at=1200), Row(doc_id=4, vendor="v", document_no="n", at=1401)]
    assert kept == [(100,), (120,), (140,), 111 * 86_400_000]


def test_first_arrivals_call_the_state_once_for_many_keys(monkeypatch):
    """All keys of a bucket cost one read, one write and one timer; parts are united, and days fall out behind the horizon."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from denpyo.streaming import dedup

    calls, state = [], []
    parts = SimpleNamespace(
        get=lambda: (calls.append("get"), iter(list(state)))[1], appendList=lambda new: (calls.append("append"), state.extend(new)),
        put=lambda new: (calls.append("put"), state.clear(), state.extend(new)), clear=lambda: (calls.append("clear"), state.clear()))
    processor = dedup.BucketArrivals(10)
    processor.init(SimpleNamespace(getListState=lambda *_: parts, registerTimer=calls.append))

    def deliver(day, *keys):
        calls.clear()
        rows = [Row(doc_id=f"{k}{i}", vendor=k, document_no="n", at=day * 10 + i, day=day) for i in (1, 0) for k in keys]
        return sorted(r.doc_id for r in processor.handleInputRows((7,), iter(rows), None))

    many = [f"k{i:03d}" for i in range(500)]
    assert deliver(100, *many) == [f"{k}0" for k in many]
    assert calls == ["get", "append", 111 * 86_400_000]
    assert deliver(105, *many, "new") == ["new0"] and calls == ["get", "append"]
    assert deliver(110, *many, "new") == [] and calls == ["get"]
    assert deliver(111, "k000", "new") == ["k0000"] and len(state) == 3
    monkeypatch.setattr(dedup, "PARTS", 3)
    assert deliver(99, "first") == ["first0"] and calls == ["get", "put", 110 * 86_400_000] and len(state) == 1
    calls.clear()
    for at, left in ((110, 502), (111, 2), (116, 1), (122, 0)):
        expired = SimpleNamespace(getExpiryTimeInMs=lambda at=at: at * 86_400_000)
        assert list(processor.handleExpiredTimer((7,), None, expired)) == []
        assert sum(len(part[2]) for part in state) == left
    assert calls[-1] == "clear"
    processor.handleInitialState((7,), Row(bucket=7, vendors=["k000", "x"], numbers=["n", "n"], days=[100, 90]), None)
    assert deliver(101, "k000", "x") == ["x0"]


def test_checks_and_known_keys_without_lambdas_and_lists(spark):
    """What is computed for a check stays in generated code, a key is looked up in a set, and nulls count as before."""
    df = spark.createDataFrame([(1, "x"), (-1, "x"), (None, None)], "n int, s string")
    found = df.select(validate.collect([
        (F.col("n") < 0, validate.error("low", "n", "below zero")), (F.col("s") == "x", validate.error("x", F.col("s"), "is x"))]).alias("errors"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [[(e.code, e.path) for e in r.errors] for r in found.collect()] == [[("x", "x")], [("low", "n"), ("x", "x")], []]
    assert validate.collect([]) is not None and df.select(validate.collect([]).alias("e")).first().e == []

    entry = ("key string, value string, source string, field_value string")
    rows = [("INVOICE", None, [("InvoiceNumber", "1", "f", "1"), ("Tax", "", "f", None), ("other", "v" * 120, "f", ""), ("more", "", "f", None)]),
            (None, None, [("InvoiceNumber", "1", "f", "2"), (None, "1", "f", "1")])]
    keyed = mapping.with_keys(spark.createDataFrame(rows, f"doc_type string, vendor string, entries array<struct<{entry.replace(' string', ':string')}>>"))
    out = keyed.select(mapping.unmapped_fields().alias("u"))
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [[tuple(u) for u in r.u] for r in out.collect()] == [[("other", "v" * 100, "f")], [("InvoiceNumber", "2", "f")]]


def test_rendered_documents_are_not_stored(spark, monkeypatch):
    """Only narrow rows are dealt to tasks, whose number grows with them."""
    from fixtures import render

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(render, "TASK_DOCS", 100)
    for docs, name, rows in ((render.payload_docs, "orders", 1500), (render.text_docs, "orders", 1500), (render.line_docs, "lineitem", 6000)):
        found = docs(spark, sf)
        assert [f.rpartition("/")[2] for f in found.inputFiles()] == [f"{name}.parquet"]
        assert found.rdd.getNumPartitions() == rows // 100 and found.count() == rows


def test_artifacts_are_compressed(spark, tmp_path):
    """Texts of all kinds in few bytes, each line as it was."""
    from denpyo.plans.normalize import normalize_payloads
    from denpyo.sources import sinks
    from fixtures import render

    out = normalize_payloads(render.payload_docs(spark, "/root/testdata/sf0.001"), "2024-01-01").limit(300)
    out = out.localCheckpoint()
    sinks.write_artifacts(out, str(tmp_path / "a"), "2024-01-01T00:00:00", "r", 0)
    want = sinks.artifact_rows(out).select("kind", "body").collect()
    got = spark.read.text(str(tmp_path / "a")).select("kind", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    size = sum(f.stat().st_size for f in (tmp_path / "a").rglob("part-*"))
    assert size < sum(len(r.body.encode()) for r in want) / 3
