"""Rows of one publish time, and those without one, ordered by crawl time where both times order."""

from recordmill.operators import reshape as R
from recordmill.sources import ledger as K

ROWS = [
    (0, "待定", "2024-01-01"), (1, "", "2024-03-01"), (2, "2023-05-05", "2024-01-01"), (3, "2023-05-05", "2024-02-01"),
    (4, "待定", ""), (5, None, "2024-03-01"), (6, "2024-06-01", ""),
]
ORDER = [6, 3, 2, 1, 5, 0, 4]


def _rows(spark, rows):
    return spark.createDataFrame([(k, p, c, f"e{k}", f"u{k}") for k, p, c in rows],
                                 "ingest_pos bigint, publish_time string, crawl_time string, entity_name string, detail_url string")


def _filled(df):
    from pyspark.sql import functions as F

    from recordmill.operators.master import LEDGER_TEXT

    return df.select("ingest_pos", *[c if c in df.columns else F.lit("").alias(c) for c in LEDGER_TEXT])


def test_crawl_time_comes_second(spark):
    numbered = R.renumber(_rows(spark, ROWS), both_times=True).orderBy("seq_no").collect()
    assert [r.ingest_pos for r in numbered] == ORDER and [r.seq_no for r in numbered] == list(range(1, 8))


def test_ledger_of_both_times(spark, tmp_path):
    root = f"{tmp_path}/m"
    df = _filled(_rows(spark, ROWS))
    K.append(spark, root, df.where("ingest_pos % 2 = 1"), both_times=True)
    K.append(spark, root, df.where("ingest_pos % 2 = 0"))  # the first append decided
    K.compact(spark, root)
    assert [r.entity_name for r in K.read(spark, root).orderBy("seq_no").collect()] == [f"e{k}" for k in ORDER]


def test_large_batches_of_both_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "AT_ONCE", 1)
    root = f"{tmp_path}/m"
    K.append(spark, root, _filled(_rows(spark, ROWS)), both_times=True)
    assert [r.entity_name for r in K.read(spark, root).orderBy("seq_no").collect()] == [f"e{k}" for k in ORDER]
