"""Page reading and record extraction on hand-written markup with invented names."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions import html as H
from recordmill.operators import links as L
from recordmill.operators import tables as B
from recordmill.sources.pages import read_parts

SITE = "https://records.example.com"


def cell(text, **spans):
    attrs = "".join(f' {k}="{v}"' for k, v in spans.items())
    return f'<td width="78"{attrs}><p class="MsoNormal"><span style="a>b">{text[:1]}</span><b>{text[1:]}</b><o:p></o:p></p></td>'


def table(*rows, css="MsoTableGrid"):
    body = "".join("<tr>" + "".join(c if c.startswith("<td") else cell(c) for c in row) + "</tr>" for row in rows)
    return f'<div><table class="{css}" border="1"><tbody>{body}</tbody></table></div>'


HEADS = ("序号", "当事人名称", "主要违法违规行为", "行政处罚内容", "作出决定机关")
SINGLE = table(HEADS, ("1", "甲资产公司", "未报送信息", "罚款90万元", "某监管局"))
KEYED = table(
    ("行政处罚决定书文号", "某罚决字〔2024〕1号"), ("被处罚当事人", "乙保险公司"), ("主要违法违规事实", "虚列费用"),
    ("行政处罚依据", "《某某保险管理规定》第五条"), ("行政处罚决定", "警告"), ("作出处罚决定的机关名称", "某监管局"),
    ("作出处罚决定的日期", "2024年7月8日"), ("备注", "无"), css="MsoNormalTable",
)
MERGED = table(
    ("序号", "当事人名称", "行政处罚内容", "主要违法违规行为", "作出决定机关"),
    ("1", "丙保险公司", "罚款56万元", cell("给予其他利益", rowspan=2), cell("某监管局", rowspan=2)),
    ("2", "丁某（时任经理）", "警告并罚款14万元"),
)


def records(spark, *pages, compat=False):
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "url string, html string")
    rows = B.extract_nested(df, compat).orderBy(F.col("url").cast("int")).collect()
    return [[r.fields for r in row.records] for row in rows]


def test_single_row(spark):
    (found,) = records(spark, SINGLE)
    assert found == [dict(zip(HEADS, ("1", "甲资产公司", "未报送信息", "罚款90万元", "某监管局")))]


def test_key_value(spark):
    ((fields,),) = records(spark, KEYED)
    assert fields == {
        fixed.DOC_NO: "某罚决字〔2024〕1号", fixed.ENTITY: "乙保险公司", fixed.VIOLATION: "虚列费用",
        fixed.BASIS: "《某某保险管理规定》第五条", fixed.CONTENT: "警告", fixed.AUTHORITY: "某监管局",
        fixed.DECISION_DATE: "2024年7月8日", "备注": "无",
    }


def test_merged_rows_inherit(spark):
    (found,) = records(spark, MERGED)
    assert [(r[fixed.ENTITY], r[fixed.VIOLATION], r[fixed.AUTHORITY], r[fixed.ROW_IN_NOTICE], r[fixed.IS_MULTI]) for r in found] == [
        ("丙保险公司", "给予其他利益", "某监管局", "1", "是"), ("丁某（时任经理）", "给予其他利益", "某监管局", "2", "是"),
    ]
    assert found[1][fixed.SOURCE_SEQ] == "2"


def test_short_rows_and_one_left(spark):
    (found,) = records(spark, table(HEADS, ("合计", "1"), ("2", "戊公司", "x", "警告", "某局")))
    assert [(r[fixed.ENTITY], r[fixed.ROW_IN_NOTICE], r[fixed.IS_MULTI]) for r in found] == [("戊公司", "2", "否")]
    assert records(spark, table(HEADS, ("1", "己公司"))) == [[]]


def test_header_order(spark):
    page = table(("序号", "当事人", "行政处罚依据", "行政处罚决定"), ("1", "庚公司", "某办法", "警告"))
    ((fixed_order,),), ((compat,),) = records(spark, page), records(spark, page, compat=True)
    assert (fixed_order[fixed.BASIS], fixed_order[fixed.CONTENT]) == ("某办法", "警告")
    assert fixed.BASIS not in compat and compat[fixed.CONTENT] == "警告"


def test_first_useful_table_wins(spark):
    page = table(("首页",), css="MsoTableGrid") + KEYED + SINGLE
    plain = "<table><tr><td>首页</td></tr></table>" + SINGLE.replace("MsoTableGrid", "x")
    first, second = records(spark, page, plain)
    assert first[0][fixed.ENTITY] == "乙保险公司" and second[0][fixed.ENTITY] == "甲资产公司"


def test_text_fallbacks(spark):
    page = table(("当事人", "辛公司"), ("说明", "依据某某管理办法第五条。对壬某罚款3万元"))
    ((fields,),) = records(spark, page)
    assert fields[fixed.BASIS].startswith("某某管理办法第五条") and fields[fixed.CONTENT] == "对壬某罚款3万元"
    lone = "<table><tr><td>《某某银行管理办法》第一条</td></tr></table>"
    assert records(spark, lone) == [[{fixed.BASIS: "某某银行管理办法"}]]


def test_expand_inherits_shared_fields(spark):
    heads = ("序号", "当事人名称", "决定机关", "行政处罚决定书文号")
    page = table(heads, ("1", "甲公司", "某局", "某罚决字1号"), ("2", "乙某", "", "某罚决字2号"))
    df = spark.createDataFrame([("u", page.replace("<div>", "<div><span class='time'>发布时间：2024/1/5</span>"))], "url string, html string")
    out = B.expand_multi_record(B.extract_nested(df), F.lit("2025-01-01 00:00:00"), F.lit("标题甲")).orderBy("record_no").collect()
    assert [(r.record_total, r.fields[fixed.AUTHORITY], r.fields[fixed.DOC_NO], r.fields[fixed.PUBLISH_TIME]) for r in out] == [
        (2, "某局", "某罚决字1号", "2024/1/5"), (2, "某局", "某罚决字2号", "2024/1/5"),
    ]


def test_publish_time_falls_back_to_source(spark):
    pages = ["<p>日期：2024-3-1</p><i>发布时间： 2024-3-2</i>", "<p class='x-time'>时间</p>日期:2024/3/4", "无"]
    df = spark.createDataFrame(list(enumerate(pages)), "url int, html string")
    assert [r.publish_time for r in L.extract_publish_time(df).orderBy("url").collect()] == ["2024-3-2", "2024/3/4", ""]


def test_links_keyword_tier_hides_href_tier(spark):
    both = '<a href="/a">某行政处罚信息公示</a><a href="ItemDetail.html?docId=2">另一条</a><a href="">处罚信息</a>'
    only = '<a href="ItemDetail.html?docId=2">另一条</a><a href="/b">其他</a><a href="ItemDetail.html?docId=3"> </a>'
    df = spark.createDataFrame([(1, both), (2, only)], "url int, html string")
    got = {(r.url, r.title, r.detail_url) for r in L.extract_links(df, SITE).collect()}
    assert got == {(1, "某行政处罚信息公示", f"{SITE}/a"), (2, "另一条", f"{SITE}/ItemDetail.html?docId=2")}


def test_link_dates_by_tier(spark):
    pages = [
        "<table><tr><td><a href='/1'>处罚信息甲</a></td><td>第3号 2024-01-02</td></tr></table>",
        "<ul><li><p><a href='/2'>处罚信息乙</a></p><em>2024-02-03</em></li><li>2024-02-04</li></ul>",
        "<section><section><section><section><section><section><a href='/3'>处罚信息丙</a></section></section>"
        "</section></section></section></section><span>2024-03-04</span><span>2024-03-05</span>",
        "<a href='/4'>处罚信息丁</a>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "url int, html string")
    got = [str(r.publish_date) for r in L.extract_links(df, SITE).orderBy("url").collect()]
    assert got == ["2024-01-02", "2024-02-03", "2024-03-04", "None"]


@pytest.mark.parametrize(("href", "want"), [
    ("https://a.example/x", "https://a.example/x"), ("/x/y?q=1#f", f"{SITE}/x/y?q=1#f"), ("x", f"{SITE}/x"),
    ("../a/./b/../c", f"{SITE}/a/c"), ("//b.example/z", "https://b.example/z"), ("?q=1", f"{SITE}?q=1"), ("a/", f"{SITE}/a/"),
])
def test_resolve_url(column, href, want):
    assert column(lambda c: L.resolve_url(c, SITE), href) == [want]


def test_keyword_table(spark):
    page = table(("a", "b")) + table(("某人寿公司", "c"), ("d", ""))
    df = spark.createDataFrame([(1, page), (2, table(("x",)))], "url int, html string")
    assert [(r.url, r.row_no, r.line) for r in B.keyword_table(df).orderBy("row_no").collect()] == [(1, 1, "某人寿公司\tc"), (1, 2, "d")]


def test_bad_markup_gives_rows_not_errors(spark):
    pages = ["", None, "<table><tr><td", "</table></td><td>x", "<table><tr><td>a<td>b<tr><td>c</table>", "<!-- <table><tr><td>x"]
    df = spark.createDataFrame(list(enumerate(pages)), "url int, html string")
    rows = read_parts(df, "tables", "links", "days", "times").orderBy("url").collect()
    assert [[t.rows for t in r.tables] for r in rows] == [[], [], [[[]]], [], [[["a", "b"], ["c"]]], []]


def test_nested_tables_count_for_outer():
    outer, inner = H.table_rows("<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>")
    assert outer["rows"] == [["ab", "b", "c"], ["b"]] and inner["rows"] == [["b"]]


def test_empty_position_takes_reaching_text():
    rows = [["h1", "h2"], ["a", "x"], ["y"], ["", "z"], ["", "w"]]
    spans = [{"row_no": 2, "cell_no": 1, "rowspan": 2, "colspan": 1}]
    assert H.spread(rows, spans) == [["a", "x"], ["a", "y"], ["a", "z"], ["", "w"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=4), min_size=2, max_size=5))
def test_spread_keeps_text_and_width(data):
    width = 5
    rows = [["h"] * width] + [[c[0] for c in row] for row in data]
    spans = [
        {"row_no": y, "cell_no": x, "rowspan": c[1], "colspan": c[2]}
        for y, row in enumerate(data, 2) for x, c in enumerate(row, 1)
    ]
    grid = H.spread(rows, spans)
    assert len(grid) == len(data) and all(len(r) == width for r in grid)
    assert {v for r in grid for v in r if v} <= {c[0] for row in data for c in row}
    assert grid[0][0] == data[0][0][0]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/abtdrspn ='\"!-=class2024-01", max_size=80))
def test_reader_never_fails(markup):
    json.dumps(H.page_parts(markup, ("tables", "links", "days", "times"), False))


def test_stray_quotes_and_wide_spans():
    for markup, tags in (
        ("<td title=5'>A</td><td>it's</td>", ["<td title=5'>", "</td>", "<td>", "</td>"]),
        ("<a href=\"x>y\" title = 'a>b'>", ["<a href=\"x>y\" title = 'a>b'>"]),
        ("<span it's>7\" wide</span>", ["<span it's>", "</span>"]),
    ):
        assert [m.group(0) for m in H._TAG.finditer(markup)] == tags
    assert H._spans(" rowspan=70000 colspan='2000'") == (70000, 2000)
