"""Caps cut by counts, and patterns run only where their anchor words are."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions import penalty as P
from recordmill.operators import select as C

ITEMS = "category string, page int, pos int, k int"


@pytest.mark.parametrize("records", [0, 1, 7, 40, 100_000])
def test_cap_equals_the_sorted_head(spark, records):
    """Against a plain sort: pages in several ranges, repeated places, null categories, pages and places."""
    rng = random.Random(records)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 1, 2, 3, 1023, 1024, 5000]), rng.choice([None, 1, 2, 3000]), i) for i in range(300)]
    got = C.record_cap(spark.createDataFrame(rows, ITEMS).repartition(3), records).collect()
    for category in ("a", "b", None):
        want = sorted((r[1] or -1, r[2] or -1) for r in rows if r[0] == category)[:records]
        assert sorted((r.page or -1, r.pos or -1) for r in got if r.category == category) == want
    assert len({r.k for r in got}) == len(got)


def test_cap_of_nothing(spark):
    assert C.record_cap(spark.createDataFrame([], ITEMS), 5).collect() == []


def test_anchors_stand_in_their_patterns():
    for patterns, anchors in (
        (fixed.BASIS_PATTERNS, fixed.BASIS_ANCHORS), (fixed.PERSON_PENALTY_PATTERNS, fixed.PERSON_PENALTY_ANCHORS),
        (fixed.SUMMARY_PATTERNS, fixed.SUMMARY_ANCHORS),
    ):
        assert len(patterns) == len(anchors)
        for pattern, words in zip(patterns, anchors, strict=True):
            plain = re.sub(r"\[[^\]]*\][?*+]*", " ", pattern)  # what stands outside of classes must be matched
            assert all(w in plain for w in words)


def test_anchors_change_nothing(spark, monkeypatch):
    """Texts of random words against the same searches without anchors."""
    words = ["依据", "根据", "按照", "违反了", "《", "》", "银行法", "规定", "办法", "条例", "第三十条", "，", "。", "；", "\n", "对", "张某",
             "警告", "并罚款", "罚款", "5万元", "合计罚款", "其中", "某公司", "事实"]
    rng = random.Random(1)
    rows = [("".join(rng.choices(words, k=rng.randint(0, 14))),) for _ in range(600)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "t string").repartition(2)

    def found():
        return df.select("t", F.expr(P.basis_sql("t")).alias("b"), F.array_join(F.expr(P.dedup_sql(P.sentences_sql("t"))), fixed.JOINER).alias("c"))

    fast = {r.t: (r.b, r.c) for r in df.select("t", P.extract_basis("t").alias("b"), P.extract_content("t").alias("c")).collect()}
    monkeypatch.setattr(P, "_matches", lambda text, pattern, group, anchors: f"regexp_extract_all({text}, r'{pattern}', {group})")
    assert fast == {r.t: (r.b, r.c) for r in found().collect()}
    assert sum(bool(b) for b, _ in fast.values()) > 50 and sum(bool(c) for _, c in fast.values()) > 50
