"""Pages without nested tables are read in one look at each tag: the same parts; and their reading is dealt over many tasks."""

import random

import pytest
from conftest import SF

from recordmill.functions import html as H
from recordmill.sources import fixtures as X

BITS = [
    "<table>", "<TABLE class=\"MsoTableGrid\">", "<table class='x MsoNormalTable'>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th colspan='2'>",
    "</TH>", "<td rowspan=\"2\">", "<p>", "</p>", "<span class=\"ng-binding\">", "<span class=\"time\">", "</span>", "甲 ", "&nbsp;", "x > y", "2001-01-01",
]
ODD = [*BITS, "<tr", "<td", "<", "=", "\"", "='<tr>'", " title=\"a>b\">", "<td:x>", "<!--", "-->", "<div ng-bind=\"x.time\">", "</div>"]


@pytest.mark.parametrize("bits", [BITS, ODD])
def test_flat_markup_gives_the_same_tables(monkeypatch, bits):
    draw = random.Random(3)
    pages = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 30))) for _ in range(4000)]
    quick = [H.table_rows(p) for p in pages]
    monkeypatch.setattr(H, "_flat_boxes", lambda bare: None)
    assert quick == [H.table_rows(p) for p in pages]


def test_only_the_told_element_is_read():
    shown = "<span>a</span><span class=\"time\">b<span>c</span>d</span><span>e</span><p class=\"pub-time\">f"
    assert H.times(shown) == [{"rank": 4, "text": "bcd"}, {"rank": 3, "text": "f"}]


def test_pages_are_dealt_over_several_tasks_a_core(spark):
    assert X.detail_html(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_dealing_runs_no_join_ahead(spark):
    """Only the footers of the four tables read are looked at."""
    spark.sparkContext.setJobGroup("deal", "dealing")
    X.detail_html(spark, SF)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("deal")) <= 4
    spark.sparkContext.setJobGroup("", "")
