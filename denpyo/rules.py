"""Shipped rules. Everything in this module is a fixed value: word lists, field synonyms,
patterns and limits that decide results."""

from __future__ import annotations

INVOICE = "INVOICE"
PURCHASE_ORDER = "PURCHASE_ORDER"
SCHEMA_VERSION = "1.0"

# Classification ---------------------------------------------------------------------------

TYPE_KEYWORDS = {
    INVOICE: ["請求書", "invoice", "bill", "請求番号", "請求金額", "お支払い", "payment",
              "支払期限", "振込先"],
    PURCHASE_ORDER: ["発注書", "purchase order", "注文書", "発注番号", "注文番号", "納期",
                     "delivery", "納品先", "発注金額"],
}

SIMPLE_TYPE_KEYWORDS = {
    INVOICE: ["請求書", "請求番号", "請求金額", "invoice"],
    PURCHASE_ORDER: ["発注書", "注文書", "発注番号", "purchase order"],
}

# First type with a hit wins; the score belongs to the type.
FIXED_SCORE_KEYWORDS = [
    (INVOICE, ["請求書", "請求番号", "invoice"], 0.9),
    (PURCHASE_ORDER, ["発注書", "注文書", "purchase order"], 0.8),
]
FIXED_SCORE_UNKNOWN = ("UNKNOWN", 0.1)

CONFIDENCE_WORDS = ["金額", "日付", "番号"]
CONFIDENCE_WEIGHTS = {"type": 0.5, "vendor": 0.3, "words": 0.2}

# Vendor -> kinds of pattern, both in matching order.
VENDOR_PATTERNS = {
    "株式会社エグザンプル": {
        "company_names": ["株式会社エグザンプル", "エグザンプル", "Example Corp"],
        "phone_patterns": ["03-1234-5678", "0312345678"],
        "domains": ["@example.co.jp", "example.co.jp"],
        "addresses": ["東京都千代田区", "〒100-0001"],
    },
    "株式会社サンプル商事": {
        "company_names": ["株式会社サンプル商事", "サンプル商事", "Sample Trading"],
        "phone_patterns": ["06-9876-5432", "0698765432"],
        "domains": ["@sample-shoji.jp", "sample-shoji.jp"],
        "addresses": ["大阪府大阪市", "〒530-0001"],
    },
    "テスト工業株式会社": {
        "company_names": ["テスト工業株式会社", "テスト工業", "Test Industries"],
        "phone_patterns": ["052-111-2222", "0521112222"],
        "domains": ["@test-ind.co.jp", "test-ind.co.jp"],
        "addresses": ["愛知県名古屋市", "〒460-0001"],
    },
    "デモシステム合同会社": {
        "company_names": ["デモシステム合同会社", "デモシステム", "Demo Systems LLC"],
        "phone_patterns": ["092-333-4444", "0923334444"],
        "domains": ["@demo-sys.com", "demo-sys.com"],
        "addresses": ["福岡県福岡市", "〒810-0001"],
    },
}

# Company name next to its legal form, first matching pattern wins (group 1).
VENDOR_FALLBACK = [
    r"(株式会社[\s　]*[一-龯぀-ゟ゠-ヿ]+)",
    r"([一-龯぀-ゟ゠-ヿ]+[\s　]*株式会社)",
    r"(合同会社[\s　]*[一-龯぀-ゟ゠-ヿ]+)",
    r"(有限会社[\s　]*[一-龯぀-ゟ゠-ヿ]+)",
]

VENDOR_ON_LINE = [
    r"((?:株式会社|有限会社|合同会社)[^\n\r]{1,30})",
    r"([^\n\r]{1,30}(?:株式会社|㈱))",
]
UNKNOWN_VENDOR = "不明"

# Screens for text whose vendor is unknown.
SCREENS = {
    "company_suffix": ["株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "Corporation",
                       "Corp.", "Inc.", "LLC", "Ltd."],
    "phone": [r"\d{2,4}-\d{2,4}-\d{4}", r"\d{10,11}", r"\+81-\d{1,4}-\d{1,4}-\d{4}"],
    "email": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
    "postal_code": [r"〒\d{3}-\d{4}", r"\d{3}-\d{4}"],
}

# Labelled text ----------------------------------------------------------------------------

# Field -> alternatives (pattern, group, ignore case), first match wins.
TEXT_FIELDS = {
    "document_no": [(r"請求番号[:：]\s*([A-Z0-9\-]+)", 1, False)],
    "issue_date_raw": [(r"発行日[:：]\s*([^\n\r]+)", 1, False)],
    "due_date_raw": [(r"支払期限[:：]\s*([^\n\r]+)", 1, False)],
    "grand_total_raw": [(r"合計[:：]\s*[¥￥]?([0-9,]+)", 1, False)],
    "subtotal_raw": [(r"小計[:：]\s*[¥￥]?([0-9,]+)", 1, False)],
    "tax_raw": [(r"消費税[^:：]*[:：]\s*[¥￥]?([0-9,]+)", 1, False)],
    "phone": [(r"TEL[:：]\s*([0-9\-]+)", 1, False)],
    "address": [(r"(〒\d{3}-\d{4}\s+[^\n\r]+)", 1, False)],
}

# The same with looser labels, for text read from PDF files.
LOOSE_TEXT_FIELDS = {
    "invoice_number": [
        (r"請求(?:書)?番号[\s:：]*([A-Z0-9\-]+)", 1, True),
        (r"Invoice\s*(?:No|Number)[\s:：]*([A-Z0-9\-]+)", 1, True),
        (r"(?:No|NO)[\s.:：]*([A-Z0-9\-]{5,})", 1, True),
    ],
    "issue_date_raw": [
        (r"発行日[\s:：]*([^\n\r]+)", 0, False),
        (r"(?:令和|平成)(\d+)年(\d+)月(\d+)日", 0, False),
        (r"(\d{4})年(\d{1,2})月(\d{1,2})日", 0, False),
        (r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", 0, False),
    ],
    "total_amount_raw": [
        (r"合計(?:金額)?[\s:：]*[￥¥]?([0-9,]+)円?", 1, True),
        (r"(?:Total|TOTAL)[\s:：]*[￥¥]?([0-9,]+)", 1, True),
        (r"([0-9,]+)円?\s*(?:税込|込み|total)", 1, True),
    ],
    "vendor_name": [
        (r"((?:株式会社|有限会社|合同会社|合名会社|合資会社)[^\n\r]{1,30})", 1, False),
        (r"([^\n\r]{1,30}(?:株式会社|有限会社|㈱|㈲))", 1, False),
        (r"([A-Z][A-Za-z\s&,.-]{5,30}(?:Inc|LLC|Corp|Co\.|Ltd))", 1, False),
    ],
    "address": [(r"(〒?\d{3}-?\d{4}\s*[^\n\r]{5,50})", 1, False)],
    "phone": [(r"(?:TEL|電話)[\s:：]*([0-9\-\(\)]{10,15})", 1, True)],
}

# A second spelling of the total, used by the one-line documents.
SIMPLE_TOTAL_FIELDS = [
    (r"合計[:：]\s*[¥￥]?([0-9,]+)円?", 1, False),
    (r"総額[:：]\s*[¥￥]?([0-9,]+)円?", 1, False),
]

# Mapping ----------------------------------------------------------------------------------

GLOBAL_MAPPING = {
    "mappings": {
        "document_no": {
            "from": ["請求番号", "伝票番号", "発注番号", "注文番号", "InvoiceNumber",
                     "PurchaseOrderNumber", "DocumentNumber"],
            "transform": ["trim", "upper"],
        },
        "issue_date": {
            "from": ["発行日", "請求日", "発注日", "注文日", "作成日", "InvoiceDate", "OrderDate",
                     "IssueDate"],
            "transform": ["to_date:%Y-%m-%d"],
        },
        "grand_total": {
            "from": ["合計金額", "総額", "お支払金額", "合計（税込）", "ご請求金額", "TotalAmount",
                     "GrandTotal"],
            "transform": ["strip_currency", "to_decimal:2"],
        },
        "subtotal": {
            "from": ["小計", "税抜金額", "税抜合計", "SubTotal", "NetAmount"],
            "transform": ["strip_currency", "to_decimal:2"],
        },
        "tax": {
            "from": ["消費税", "税額", "消費税額", "Tax", "VAT"],
            "transform": ["strip_currency", "to_decimal:2"],
        },
        "currency": {"from": ["通貨", "Currency"], "transform": ["upper"], "default": "JPY"},
        "vendor_address": {
            "from": ["住所", "所在地", "請求元住所", "Address", "VendorAddress"],
            "transform": ["normalize_japanese"],
        },
        "vendor_phone": {
            "from": ["電話番号", "TEL", "Tel", "Phone", "PhoneNumber"],
            "transform": ["normalize_phone"],
        },
        "vendor_postal_code": {
            "from": ["郵便番号", "〒", "PostalCode", "ZipCode"],
            "transform": ["normalize_postal_code"],
        },
    },
}

# Assignments run in order where the guard holds on the totals as they are before the rule.
POST_COMPUTE = [
    {
        "when": "(totals.subtotal is null or totals.subtotal = 0) and totals.grand_total <> 0",
        "set": [
            ("subtotal", "bround(totals.grand_total / 1.10D, 0)"),
            ("tax", "totals.grand_total - totals.subtotal"),
        ],
    },
    {
        "when": "(totals.tax is null or totals.tax = 0)"
                " and totals.subtotal <> 0 and totals.grand_total <> 0",
        "set": [("tax", "totals.grand_total - totals.subtotal")],
    },
]

TYPE_MAPPING = {
    INVOICE: {
        "mappings": {
            "due_date": {
                "from": ["支払期日", "お支払期限", "支払期限", "振込期限", "DueDate", "PaymentDueDate"],
                "transform": ["to_date:%Y-%m-%d"],
            },
            "payment_terms": {
                "from": ["支払条件", "お支払条件", "PaymentTerms"],
                "transform": ["trim"],
            },
            "bank_account": {
                "from": ["振込先", "銀行口座", "お振込先", "BankAccount"],
                "transform": ["normalize_japanese"],
            },
            "customer_name": {
                "from": ["請求先", "お客様名", "宛先", "CustomerName", "BillTo"],
                "transform": ["normalize_japanese"],
            },
        },
        "lines": {
            "headers": {
                "description": ["品目", "品名", "摘要", "商品名", "内容", "Description", "Item"],
                "qty": ["数量", "数", "個数", "Quantity", "Qty"],
                "unit_price": ["単価", "UnitPrice", "Price"],
                "amount": ["金額", "小計", "金額（税込）", "金額（税抜）", "Amount", "LineTotal"],
            },
            "defaults": {"tax_rate": 0.10},
        },
        "post_compute": POST_COMPUTE,
    },
    PURCHASE_ORDER: {
        "mappings": {
            "delivery_date": {
                "from": ["納期", "納入期限", "納品予定日", "DeliveryDate", "ExpectedDelivery"],
                "transform": ["to_date:%Y-%m-%d"],
            },
            "delivery_address": {
                "from": ["納品先", "納入先", "配送先", "お届け先", "DeliveryAddress", "ShipTo"],
                "transform": ["normalize_japanese"],
            },
            "supplier_name": {
                "from": ["発注先", "仕入先", "サプライヤー", "SupplierName", "VendorName"],
                "transform": ["normalize_japanese"],
            },
            "purchase_terms": {
                "from": ["取引条件", "購買条件", "PurchaseTerms", "Terms"],
                "transform": ["trim"],
            },
            "requester": {
                "from": ["発注者", "購買担当", "担当者", "Requester", "Buyer"],
                "transform": ["normalize_japanese"],
            },
        },
        "lines": {
            "headers": {
                "description": ["品目", "品名", "商品名", "部品名", "Description", "Item", "PartName"],
                "qty": ["数量", "発注数", "注文数", "Quantity", "OrderQty"],
                "unit_price": ["単価", "仕入単価", "UnitPrice", "Cost"],
                "amount": ["金額", "小計", "合計", "Amount", "LineTotal"],
                "delivery_date": ["納期", "納入日", "DeliveryDate"],
            },
            "defaults": {"tax_rate": 0.10},
        },
        "post_compute": POST_COMPUTE,
    },
}

TOTAL_SYNONYMS = {
    "subtotal": ["小計", "税抜金額", "subtotal", "net_amount"],
    "tax": ["消費税", "税額", "tax", "vat"],
    "grand_total": ["合計", "総額", "合計金額", "total", "grand_total", "お支払金額"],
}

CUSTOMER_FIELDS = ["customer", "bill_to", "ship_to", "customer_name", "取引先", "得意先"]

# Validation -------------------------------------------------------------------------------

VALIDATION = {
    "amounts": {"tolerance": 1.0, "line_tolerance": 10.0},
    "dates": {"max_payment_terms": 90, "allow_future": False, "max_future_days": 30},
    "required": {
        INVOICE: ["doc.document_no", "doc.issue_date", "doc.vendor", "totals.grand_total"],
        PURCHASE_ORDER: ["doc.document_no", "doc.issue_date", "doc.vendor", "totals.grand_total"],
    },
    "constraints": {
        "doc.document_no": {"min_length": 1, "max_length": 50, "pattern": r"^[A-Za-z0-9\-/_]+$"},
        "doc.currency": {"pattern": r"^[A-Z]{3}$"},
        "totals.grand_total": {"min_value": 0, "max_value": 999999999},
        "totals.tax": {"min_value": 0, "max_value": 999999999},
    },
    "allowed_currencies": ["JPY", "USD", "EUR", "GBP", "CNY"],
    "duplicates": {"window_days": 365},
    "confidence": {
        "field": 0.7,
        "document": 0.8,
        "critical": 0.9,
        "critical_fields": ["document_no", "grand_total", "issue_date"],
    },
    # Conditions that have to hold; a condition over a missing value is not judged.
    "business": {
        INVOICE: [
            ("issue_not_after_today", "doc.issue_date", "issue_day <= today"),
            ("tax_rate_8_or_10", "totals.tax",
             "least(abs(totals.tax - totals.subtotal * 0.08D),"
             " abs(totals.tax - totals.subtotal * 0.10D)) <= 1.0D"),
        ],
        PURCHASE_ORDER: [
            ("delivery_after_issue", "doc.delivery_date", "delivery_day > issue_day"),
            ("total_positive", "totals.grand_total", "totals.grand_total > 0"),
        ],
    },
    # Ranges from the configuration guide.
    "ranges": {
        "numeric": {"totals.grand_total": (1, 100000000)},
        "tax_rate": (0, 1),
        "issue_min": "2000-01-01",
        "issue_max_years": 1,
        "due_max_years": 2,
        "lengths": {"doc.document_no": (3, 50), "doc.vendor": (2, 100)},
        "tax_rates": [0.0, 0.08, 0.10],
        "tax_tolerance": 10.0,
        "payment_days": [0, 30, 60, 90],
        "document_no": {
            INVOICE: r"^(INV|請求)-[0-9]{4,}-[0-9]{3,}$",
            PURCHASE_ORDER: r"^(PO|発注)-[0-9]{4,}-[0-9]{3,}$",
        },
    },
}

_DATE_TEXT = {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"}
_TEXT = {"type": "string"}
_NUMBER = {"type": "number"}


def _cdm_schema(doc_type: str, own: dict) -> dict:
    doc = {
        "type": {"const": doc_type},
        "document_no": _TEXT,
        "issue_date": _DATE_TEXT,
        "currency": {"type": "string", "pattern": r"^[A-Z]{3}$"},
        "schema_version": {"type": "string", "const": SCHEMA_VERSION},
        "vendor": _TEXT,
        "vendor_id": _TEXT,
        **own,
    }
    line = {f: _NUMBER for f in ("qty", "unit_price", "amount", "tax_rate")}
    return {
        "required": ["doc", "lines", "totals"],
        "properties": {
            "doc": {
                "properties": doc,
                "required": ["type", "document_no", "issue_date", "currency", "schema_version"],
            },
            "lines": {"items": {"properties": {"description": _TEXT, **line}}},
            "totals": {"properties": {f: _NUMBER for f in ("subtotal", "tax", "grand_total")}},
        },
    }


CDM_SCHEMA = {
    INVOICE: _cdm_schema(INVOICE, {"due_date": _DATE_TEXT, "customer_id": _TEXT}),
    PURCHASE_ORDER: _cdm_schema(
        PURCHASE_ORDER,
        {"delivery_date": _DATE_TEXT, "supplier_id": _TEXT, "delivery_address": _TEXT},
    ),
}
