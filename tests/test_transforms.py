import pytest
from pyspark.sql import functions as F

from denpyo.functions.transforms import chain_text, register_transform, transform_names

CASES = [
    ("parse_japanese_date", "令和6年1月15日", "2024-01-15"),
    ("parse_japanese_date", "平成30年4月1日", "2018-04-01"),
    ("parse_japanese_date", "昭和63年12月31日", "1988-12-31"),
    ("parse_japanese_date", "大正2年3月4日", "1913-03-04"),
    ("parse_japanese_date", "明治45年7月30日", "1912-07-30"),
    ("parse_japanese_date", "令和６年１月１５日", "2024-01-15"),
    ("parse_japanese_date", "２０２４年１２月３１日", "2024-12-31"),
    ("parse_japanese_date", "R6.1.15", None),
    ("parse_japanese_date", "令和6-01-15", None),
    ("parse_japanese_date", "令和6年13月45日", "2024-13-45"),
    ("parse_japanese_date", "令和元年5月1日", None),
    ("parse_japanese_date", "平成2年1月1日から令和3年2月2日", "2021-02-02"),
    ("zenkaku_to_hankaku", "１２３４５６７８９０", "1234567890"),
    ("zenkaku_to_hankaku", "ＡＢＣａｂｃ", "ABCabc"),
    ("zenkaku_to_hankaku", "－（）￥", "-()\\"),
    ("zenkaku_to_hankaku:x", "Ａ－１", "A－1"),
    ("zenkaku_to_hankaku", "①②③", "①②③"),
    ("fold_circled", "①②③", "123"),
    ("hankaku_to_zenkaku", "aZ9-", "ａＺ９-"),
    ("strip_currency", "¥1,234,567", "1234567"),
    ("strip_currency", "￥1,234,567円", "1234567"),
    ("strip_currency", "1,234,567円税込", "1234567税込"),
    ("strip_currency", "総額¥1,234,567", "総額1234567"),
    ("strip_currency", "$1,234.56", "1234.56"),
    ("to_decimal", "消費税(10%): ¥5,000", "105000.0"),
    ("to_decimal", "abc", "0.0"),
    ("to_decimal:0", "12345678.5", "12345678.0"),
    ("to_date:%Y-%m-%d", "2024-1-5", "2024-01-05"),
    ("to_date:%Y-%m-%d", "令和6年1月15日", "2024-01-15"),
    ("to_date:%Y-%m-%d", "n/a", "n/a"),
    ("to_date:%Y-%m-%d", "", None),
    ("to_date:%d/%m/%Y", "05/01/2024", "2024-01-05"),
    ("to_date", "Jan 5, 2024", "2024-01-05"),
    ("to_date", "5 September 2024", "2024-09-05"),
    ("to_date", "may 05 2024", "2024-05-05"),
    ("to_date", "20240229", "2024-02-29"),
    ("to_date", "20230229", "20230229"),
    ("to_date", "2024.3.9", "2024-03-09"),
    ("to_date", "3/9/2024", "2024-03-09"),
    ("to_date", "2024-03-09T10:20:30", "2024-03-09"),
    ("to_date", "Abc 5, 2024", "Abc 5, 2024"),
    ("parse_japanese_date", "昭和99999999999999999999年1月2日", None),
    ("parse_japanese_date", "令和99999年1月2日", "102017-01-02"),
    ("normalize_phone", "０３－１２３４－５６７８", "03-1234-5678"),
    ("normalize_phone", "03(1234)5678", "0312345678"),
    ("normalize_phone", "03.1234.5678", "0312345678"),
    ("normalize_phone", "０６６－１２３－４５６７", "066-123-4567"),
    ("normalize_postal_code", "〒１００－０００１", "100-0001"),
    ("normalize_postal_code", "1000001", "100-0001"),
    ("extract_postal_code", "〒100-0001 東京都千代田区千代田1-1-1", "100-0001"),
    ("normalize_japanese", "株式会社　サンプル", "株式会社 サンプル"),
    ("normalize_japanese", "項目1\n\n項目2\t項目3", "項目1 項目2 項目3"),
    ("trim", "  　株式会社テスト　  ", "株式会社テスト"),
    ("replace:a|b", "banana", "bbnbnb"),
    ("replace:a", "banana", "banana"),
    (r"regex:(\d+)円", "税500円", "500"),
    ("regex:x", "税500円", "税500円"),
    ("regex:(", "税500円", "税500円"),
    ("divide:0", "10", None),
    ("divide:4", "10", "2.5"),
    ("multiply:x", "10", "10"),
    ("round:0", "2.5", "2.0"),
    ("abs", "-3", "3.0"),
    ("abs", "三", "三"),
    ("default:X", "", "X"),
    ("default:X", None, None),
    ("no_such_transform", "v", "v"),
    ("extract_number", "合計１，２３４．５円", "1234.5"),
    ("final_amount", "合計金額: ¥1,234,567円 + 消費税¥123,456円 = ¥1,358,023円", "1358023"),
    ("remove_spaces", "a 　b\tc", "abc"),
    ("split:;|join:+", "a;b", "a+b"),
    ("upper", "straße", "STRASSE"),
]


def test_cases(spark):
    one = spark.range(1)
    columns = [
        chain_text(F.lit(value).cast("string"), *(
            [chain] if not chain.startswith("split") else chain.split("|"))).alias(f"c{i}")
        for i, (chain, value, _) in enumerate(CASES)
    ]
    wrong = []
    for start in range(0, len(CASES), 20):
        row = one.select(*columns[start:start + 20]).first()
        wrong += [(CASES[start + i], got) for i, got in enumerate(row) if got != CASES[start + i][2]]
    assert not wrong


def test_registered_transform(spark):
    register_transform("shout", lambda c, p: F.concat(F.upper(c), F.lit(p or "!")))
    assert "shout" in transform_names()
    assert spark.range(1).select(chain_text(F.lit("a"), "shout:?", "trim")).first()[0] == "A?"


@pytest.mark.parametrize("number, text", [(1e7, "10000000.0"), (2.5, "2.5"), (12345678.25, "12345678.25")])
def test_number_text(spark, number, text):
    from denpyo.functions.text import plain_number_text

    assert spark.range(1).select(plain_number_text(F.lit(number))).first()[0] == text
