"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest

from recordmill.llm.html_main import extract_main
from recordmill.llm.langid import language_id
from recordmill.llm.minhash import near_duplicates
from recordmill.llm.neighbours import quality_scores
from recordmill.llm.pieces import round_trip
from recordmill.llm.quality import quality_rules
from recordmill.llm.recount import recount, sample_edits
from recordmill.llm.secrets import redact_secrets, secret_scan
from recordmill.llm.suffixes import remove_repeats
from recordmill.llm.tiling import contaminated_pairs, decontaminate

LONG = "word " * 60000
ROWS = [
    (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "one", "en", "s", 3, None),
    (4, LONG, "en", None, 1, "x"), (5, "same text here for both", None, "s", 1, "x"), (5, "same text here for both", None, "s", 1, "x"),
    (6, " \t\n", "fr", "s", 3, "x"), (7, "12 34 :: 56", "fr", "s", 3, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def labels(spark):
    return spark.createDataFrame([(2, 0, 0), (3, 1, 0), (3, 1, 1), (4, None, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "same text here for both"), (4, "same text here for both")], "item_id long, text string")


OPERATORS = {
    "near_duplicates": lambda s, d: near_duplicates(d),
    "language_id": lambda s, d: language_id(d),
    "secret_scan": lambda s, d: secret_scan(d),
    "redact": lambda s, d: redact_secrets(d),
    "quality_rules": lambda s, d: quality_rules(d),
    "remove_repeats": lambda s, d: remove_repeats(d),
    "round_trip": lambda s, d: round_trip(d),
    "quality_scores": lambda s, d: quality_scores(d, labels(s)),
    "recount": lambda s, d: recount(sample_edits(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, docs, name):
    rows = OPERATORS[name](spark, docs).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5, 5, 6, 7]
    assert len({tuple(map(str, r)) for r in rows if r.doc_id == 5}) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_defined_results(spark, docs):
    near = by_id(near_duplicates(docs))
    assert [(near[i].n_shingles, near[i].component_id) for i in (1, 2, 3, 4, 5, 6)] == [(0, 1), (0, 2), (1, 3), (1, 4), (4, 5), (0, 6)]
    langs = by_id(language_id(docs))
    assert [(langs[i].lang_pred, langs[i].score) for i in (1, 2, 6, 7)] == [("und", 0.0)] * 4
    secrets = by_id(secret_scan(docs))
    assert {(r.n_assign, r.spans, r.base_sha256) for r in secrets.values()} == {(0, "", hashlib.sha256(b"").hexdigest())}
    rules = by_id(quality_rules(docs))
    assert all(r.base_failed and not r.kept for r in rules.values()) and rules[4].n_repeat_words == 60000
    cut = by_id(remove_repeats(docs))
    # the last blank of the long text stands in a string that starts once only if its period differs: it does not
    assert (cut[4].n_bytes, cut[4].n_removed, cut[4].n_spans) == (300000, 300000, 1)
    assert (cut[1].n_bytes, cut[1].kept_sha256) == (0, hashlib.sha256(b"").hexdigest())
    ids = by_id(round_trip(docs))
    assert ids[1].ids is None and ids[2].ids == [] and ids[1].n_ids == 0
    assert all(0 <= r.score <= 1 for r in quality_scores(docs, labels(spark)).collect())


def test_without_labels(spark, docs):
    assert {r.score for r in quality_scores(docs, labels(spark).where("false")).collect()} == {0.5}


def test_benchmark_edges(spark, docs):
    assert [(r.doc_id, r.item_id, r.n_words, r.n_covered) for r in contaminated_pairs(docs, items(spark)).collect()] == [(5, 4, 5, 5)]
    assert contaminated_pairs(docs, items(spark).where("false")).collect() == []
    assert contaminated_pairs(docs.where("false"), items(spark)).collect() == []
    left = decontaminate(docs, items(spark))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 7]


def test_members_that_only_met_a_hub(spark):
    """In the one bucket 1 is the representative in both star rounds and like neither 2 nor 3; these are alike."""
    s, t, u, v = ([f"{c}3x{i}" for i in range(n)] for c, n in (("s", 70), ("t", 20), ("u", 5), ("v", 25)))
    rows = [(i, " ".join(x)) for i, x in enumerate((s + v, s + t, s + t + u), 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1, bands=1, rows=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 2)]


def test_pages(spark):
    rows = [(1, None, None, 1), (2, "u", "", 1), (3, "u", "<p>", 1), (3, "u", "<p>", 1), (4, "u", "no markup", 1),
            (5, "u", "<article>" + "<p>para &amp; text</p>" * 20000 + "</article>", 1), (6, "u", "<div>" * 5000 + "x" + "</p>" * 5000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in extract_main(pages).collect()}
    assert [got[i].text for i in (1, 2, 3)] == ["", "", ""] and got[5].text == "\n".join(["para & text"] * 20000)
    assert got[5].n_chars == len(got[5].text)
    assert extract_main(pages.where("false")).collect() == []
