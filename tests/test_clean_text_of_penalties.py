"""Sentences without blanks and entities are left as they are; all others take every step."""

from pyspark.sql import functions as F

from recordmill.functions.penalty import clean_sql

CASES = {
    "罚款7万元": "罚款7万元", "": "", "  甲　 乙 ": "甲 乙", "a&nbsp;b": "a b", "&nbsp;a": "a", "&amp;lt;": "<", "a&b": "a&b", " x\x1f": "x",
    "x y": "x y", "x\ny": "x y", "\x85": "", "&nbsp;": "",
}


def test_every_step(column):
    assert column(lambda v: F.expr(clean_sql("v")), *CASES, None) == [*CASES.values(), ""]


def test_steps_stand_behind_one_search():
    assert clean_sql("v").startswith("CASE WHEN v rlike")
