"""Of a page's tables only the asked fields are built; the cells of flat markup are the same as those of any other."""

from recordmill.functions import html as H
from recordmill.sources.pages import read_parts

PAGE = ("<table class='nav'><tr><td>x</td></tr></table><table class='MsoTableGrid'><tr><td>甲<b>乙</b></td><td>c</td></tr>"
        "<tr><td rowspan='2'>a &amp; b</td><td>1</td></tr><tr><td>2</td></tr></table>")
ROWS = [["甲乙", "c"], ["a & b", "1"], ["2"]]


def test_only_asked_fields_are_read(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "n int, html string")
    one, two = read_parts(pages, "tables", candidates_only=True, fields=("rows", "grid")).orderBy("n").collect()
    assert [t.asDict() for t in one.tables] == [{"rows": ROWS, "grid": [["a & b", "1"], ["a & b", "2"]]}] and two.tables == []


def test_asked_fields_are_those_of_whole_tables(monkeypatch):
    for _ in range(2):
        whole = H.table_rows(PAGE)
        assert [t["rows"] for t in whole] == [[["x"]], ROWS]
        for fields in (("rows",), ("spans",), ("grid",), ("text", "table_no")):
            assert H.table_rows(PAGE, fields=fields) == [{f: t[f] for f in fields} for t in whole]
        monkeypatch.setattr(H, "_flat_boxes", lambda markup: None)
