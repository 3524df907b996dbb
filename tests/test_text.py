from datetime import datetime
from decimal import Decimal

from recordmill.functions import penalty as P
from recordmill.functions import text as T


def test_standardize_amount(column):
    given = {
        "158万元": "罚款158.0万元", "500元": "罚款500.0元", "12,000元": "罚款1.2万元", "1,580万元": "罚款580.0万元",
        "1亿元": "1亿元", "11500元": "罚款1.1万元", "12500元": "罚款1.2万元", "罚款 12.50 万元": "罚款12.5万元", "警告": "警告",
    }
    assert column(T.standardize_amount, *given) == list(given.values())


def test_amount_yuan(column):
    assert column(T.amount_yuan, "158万元", "1,580万元", "12,000元", "1亿元", None) == [
        Decimal("1580000.00"), Decimal("15800000.00"), Decimal("12000.00"), None, None,
    ]


def test_format_date(column):
    given = ["2024-7-8", "2024/07/08", "2024年7月8日", "2024-01-15 10:30:00", "待定", "", None, "2024-02-30"]
    assert column(T.format_date, *given) == [
        "2024-07-08", "2024-07-08", "2024-07-08", "2024-01-15 10:30:00", "待定", "", "", "2024-02-30",
    ]


def test_parse_time(column):
    given = ["2024-7-8", "2024/07/08", "2024年7月8日", "2024-01-15 10:30:00", "待定", "", "20240115", "10:30:00"]
    assert column(T.parse_time, *given) == [
        datetime(2024, 7, 8), datetime(2024, 7, 8), datetime(2024, 7, 8), datetime(2024, 1, 15, 10, 30), None, None,
        datetime(2024, 1, 15), None,
    ]


def test_decision_number(column):
    given = {
        "某局公开表（某金罚决字〔2025〕12号-13号）": "某金罚决字〔2025〕12号-13号",
        "某局公开表 某金监罚决字〔2025〕13号、14号": "某金监罚决字〔2025〕13号、14号",
        "某局公开表 某金罚决字〔2025〕1号）": "某金罚决字〔2025〕1号",
        "某金罚决字〔2025〕1号": "某金罚决字〔2025〕1号", "罚决字": "", "某局行政处罚信息公示": "", "": "",
    }
    assert column(T.decision_number, *given) == list(given.values())


def test_bare_numbers_match_a_plain_scan(column):
    """The anchored search finds what scanning from every character finds."""
    import random
    import re

    dice = random.Random(7)
    titles = ["".join(dice.choices(["罚决字", "甲", "）", "(", " ", "1号", "、"], k=dice.randint(1, 12))) for _ in range(300)]
    plain = re.compile(r"([^\s（(]*罚决字[^\s）)]*)")

    def want(title):
        for pattern in (r"[（(]([^）)]*罚决字[^）)]*)[）)]", r"\s(\S*罚决字\S*)"):
            if hit := re.search(pattern, title):
                found = re.sub("[）)]+$", "", hit[1]) if "S" in pattern else hit[1].strip()
                if found:
                    return found
        longest = max(plain.findall(title), key=len, default="")
        return longest if len(longest) > 5 else ""

    assert column(T.decision_number, *titles) == [want(t) for t in titles]


def test_seq_sort_key(column):
    got = column(T.seq_sort_key, "3", "1-2", "x", "1-", "1-2-3", None, "1.5")
    assert [tuple(r) for r in got] == [(3, 0), (1, 2), (9999, 0), (9999, 0), (1, 2), (9999, 0), (9999, 0)]


def test_clean_text(column):
    # Entities are decoded once, after blanks are squeezed: &amp;lt; becomes <.
    assert column(T.clean_text, "　a\xa0 b&nbsp;&amp;lt;c\n", None, "&nbsp;x&nbsp;") == ["a b <c", "", "x"]
    assert column(T.clean_value, " a　&amp;\t", None) == ["a &amp;", None]


TEXT = """合计罚款200万元。其中甲公司50万元。
对赵某警告并罚款7万元
对钱某警告并罚款5万元；对孙某警告
根据《某某保险法》第一百七十条规定，处罚。"""


def test_extract_basis(column):
    assert column(lambda _: P.extract_basis("v"), TEXT, "依据某某管理办法第五条。违反《某某资本规定》。", "无") == [
        "", "某某管理办法第五条；某某资本规定", "",
    ]
    assert column(lambda _: P.extract_basis("v"), "《某某银行业监督管理法》第一条") == ["某某银行业监督管理法"]


def test_extract_content(column):
    assert column(lambda _: P.extract_content("v"), TEXT, "无") == [
        "对赵某警告并罚款7万元；对钱某警告并罚款5万元；对孙某警告；其中甲公司50万元；合计罚款200万元。其中甲公司50万元", "",
    ]


def test_containment_first_related_decides(spark):
    df = spark.sql("SELECT array('罚款甲一', '警告乙二', '罚款甲一警告乙二', '短', '罚款甲一。') AS a")
    assert df.select(P.containment_dedup("a")).first()[0] == ["警告乙二", "罚款甲一警告乙二"]
