"""The stages, each against its operator on the input it had."""

import corpus_pipeline as P
from conftest import SF

from recordmill.llm import secrets
from recordmill.llm.minhash import near_duplicates
from recordmill.llm.pieces import read_model
from recordmill.llm.quality import quality_rules
from recordmill.llm.tiling import contaminated_pairs
from recordmill.session import stage


def kept(df):
    return {r.doc_id for r in df.where("kept").collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "sentencepiece"]
    after = []
    for name, step in P.STAGES[:-1]:
        now = stage(step(spark, docs, SF), name)
        assert now.columns == docs.columns
        after.append((docs, now))
        docs = now

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    (a, b), (_, c), (_, d), (_, e) = after
    assert ids(b) == kept(quality_rules(a)) < ids(a)
    assert ids(c) == kept(near_duplicates(b, k=5)) < ids(b)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(d) == ids(c) - ids(contaminated_pairs(c, bench))
    assert {(r.doc_id, r.text) for r in e.collect()} == {(r.doc_id, secrets.redact(r.text)) for r in d.collect()}
    model, texts = read_model(), {r.doc_id: r.text for r in e.collect()}
    rows = P.run(spark, SF).collect()
    assert len(rows) == len(texts) and all(model.decode(r.ids) == texts[r.doc_id] for r in rows)


def test_rows_are_judged_one_by_one(spark):
    """Null doc_ids, two texts of one doc_id, repeated rows."""
    def words(name, n=30):
        return " ".join(f"{name}{i}" for i in range(n))

    def run(step, *rows):
        docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
        return sorted(((r.doc_id, r.text) for r in stage(step(spark, docs, SF), "out").collect()), key=str)

    a, b, c = words("a"), words("b"), words("c")
    assert run(P._quality, (None, a), (None, "few"), (7, b), (7, "too short"), (8, c), (8, c)) == [(7, b), (8, c), (8, c), (None, a)]
    near = b + " more"
    assert run(P._near_dedup, (None, a), (None, a), (7, b), (7, c), (3, near), (8, words("d")), (8, words("d"))) == [
        (3, near), (7, c), (8, words("d")), (None, a)]
    item = next(x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if x.text and len(x.text.split()) >= 8)
    assert run(P._decontaminate, (9, item), (9, a), (None, item), (None, b)) == [(9, a), (None, b)]


def test_columns_of_any_name_go_through(spark):
    """Columns named like the stages' own, empty tables, null and very long texts."""
    schema = "doc_id long, text string, lang string, source string, _row int, `group` string, `n.m` int, _ROW_ int, id int, kept int, rows int"
    long = " ".join(f"w{i}" for i in range(60000))
    docs = spark.createDataFrame([
        (1, long, "en", "s", 5, "g", 7, 8, 9, 1, 2), (2, None, None, None, 6, None, 8, None, 1, None, 3), (3, "", "en", None, 6, "", 8, 4, 1, 0, 3)], schema)
    for name, step in P.STAGES[:-1]:
        assert stage(step(spark, docs.where("false"), SF), name).collect() == []
        got = stage(step(spark, docs, SF), name)
        assert got.columns == docs.columns
        want = [1] if name == "quality_rules" else [1, 2, 3]
        assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if r.doc_id in want), key=str)
    assert {(r.doc_id, r.n_ids > 0, r.ids is None) for r in P.STAGES[-1][1](spark, docs, SF).collect()} == {
        (1, True, False), (2, False, True), (3, False, False)}
