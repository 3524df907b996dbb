"""The ledger kept in parts: any history of batches, merges and repeats ends where single upserts end."""

import random

import pytest
from pyspark.sql import functions as F
from test_ledger import ledger, party

from recordmill.operators import master as M
from recordmill.operators import reshape as R
from recordmill.sources import ledger as K

DAYS = ["2024-01-01", "2024-01-01 10:00:00", "2024/02/03", "2024年3月4日", "", "待定"]


def numbered(df):
    return sorted((r.seq_no, r.entity_name, r.title, r.publish_time) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 3])
def test_random_histories(spark, tmp_path, seed):
    r, root = random.Random(seed), f"{tmp_path}/m"
    master = ledger(spark).limit(0)
    for i in range(4):
        rows = [party(r.choice("甲乙丙丁戊己") if r.random() < 0.9 else "", str(r.randint(0, 4)) if r.random() < 0.9 else "", "", title=f"{i}-{k}",
                      publish_time=r.choice(DAYS[4:] if seed == 3 else DAYS), crawl_time=f"2025-01-0{i + 1}") for k in range(r.choice([0, 1, 7, 25]))]
        batch = ledger(spark, *rows)
        want = M.upsert_counts(master, batch).first()
        got = K.append(spark, root, batch, i).first()
        assert (got.before_count, got.after_count, got.inserted, got.removed_blank) == (want.before_count, want.after_count, want.inserted, want.removed_blank)
        master = spark.createDataFrame(M.upsert_master(master, batch).collect(), R.ledger_projection(M.upsert_master(master, batch)).schema)
        if r.random() < 0.5:
            K.compact(spark, root)
        assert K.append(spark, root, batch.withColumn("title", F.lit("again")), r.randint(0, i)).first().inserted == 0
    assert numbered(K.read(spark, root)) == numbered(master)
    K.compact(spark, root)
    K.vacuum(spark, root)
    assert numbered(K.read(spark, root)) == numbered(master)
    assert len(K.manifest(spark, root)["parts"]) <= 1 and K.manifest(spark, root)["batches"] == [[0, 3]]


def test_readers_go_on_while_parts_are_merged(spark, tmp_path):
    root = f"{tmp_path}/m"
    for i in range(3):
        K.append(spark, root, ledger(spark, party(f"{i}", publish_time="2024-01-01"), party("same")), i)
    state = K.manifest(spark, root)
    reader = K.read(spark, root, state)
    assert K.compact(spark, root) and K.compact(spark, root) is None
    assert len(reader.collect()) == 4 == K.read(spark, root).count() and len(state["parts"]) == 3
    assert K.vacuum(spark, root) == 12 and K.vacuum(spark, root) == 0
    assert K.append(spark, root, ledger(spark, party("0"), party("new")), 1).first().inserted == 0  # redelivered after the merge
    assert K.append(spark, root, ledger(spark, party("0"), party("new")), 3).first().inserted == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that finds its manifest taken looks again, and adds nothing the other one has added."""
    root, real, other = f"{tmp_path}/m", K._commit, ledger(spark, party("x"), party("y"))

    def late(spark_, root_, state):
        monkeypatch.setattr(K, "_commit", real)
        K.append(spark_, root_, other, 7)
        return real(spark_, root_, state)

    monkeypatch.setattr(K, "_commit", late)
    assert K.append(spark, root, ledger(spark, party("y"), party("z")), 8).first().inserted == 1
    assert sorted(r.entity_name for r in K.read(spark, root).collect()) == ["x", "y", "z"]


def test_an_empty_ledger(spark, tmp_path):
    assert K.read(spark, f"{tmp_path}/none").collect() == [] and not K.is_kept(spark, f"{tmp_path}/none")
    assert K.append(spark, f"{tmp_path}/m", ledger(spark).limit(0)).first()[:] == (0, 0, 0, 0, 0, 0)
    assert K.read(spark, f"{tmp_path}/m").collect() == []


def test_one_time_column_orders(spark):
    """Rows of one publish day, and rows without a readable one, stand by position whatever their crawl times say."""
    df = ledger(spark, *[{"publish_time": p, "crawl_time": c} for p, c in [
        ("2024-01-01", "2024-05-01"), ("2024-01-01", "2024-06-01"), ("", "2024-09-01"), ("待定", "2024-12-01"), ("2024-02-01", "")]])
    assert [r.ingest_pos for r in R.sort_by_time(df).collect()] == [4, 0, 1, 2, 3]
    assert [r.ingest_pos for r in R.renumber(df).orderBy("seq_no").collect()] == [4, 0, 1, 2, 3]


def test_numbers_by_counts(spark, monkeypatch):
    """Against a plain sort, with cells of two places, groups, nulls and times that hold most rows."""
    monkeypatch.setattr(R, "PLACE_BITS", 1)
    monkeypatch.setattr(R, "RANGE_BITS", 1)
    r = random.Random(4)
    rows = [(r.choice(["g", "h", None]), r.choice([None, None, None, 1, 2, 86400, 90000]), r.randint(0, 3), k) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, s long, a int, k int").withColumn("t", F.timestamp_seconds("s"))
    for by, newest, order, place in ([], "t", ["k"], None), (["g"], "t", ["a", "k"], "k"), (["g"], None, ["k"], None), ([], None, ["a", "k"], "k"):
        got = {x.k: x.no for x in R.number_by_counts(df, order, "no", by, newest, place).collect()}
        seen, want = {}, {}
        for row in sorted(rows, key=lambda x: ((x[1] is None, -(x[1] or 0)) if newest else 0, x[2] if "a" in order else 0, x[3])):
            group = row[0] if by else ""
            want[row[3]] = seen[group] = seen.get(group, 0) + 1
        assert got == want
