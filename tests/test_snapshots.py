"""Dated copies of the ledger: names, order and retention."""

from datetime import datetime

import pytest

from recordmill.sources import store as A

WHEN = datetime(2025, 1, 2, 3)


def _rows(spark, n):
    values = [(i, *[f"v{n}"] * (len(A.LEDGER_SCHEMA) - 1)) for i in range(n)]
    return spark.createDataFrame(values, A.LEDGER_SCHEMA)


def test_copies_of_one_second_stay_apart_and_the_last_counts(spark, tmp_path):
    root = f"{tmp_path}/m"
    for n in (3, 2, 1):
        A.write_snapshot(_rows(spark, n), root, WHEN)
    assert len(list((tmp_path / "m").iterdir())) == 3
    assert A.latest_snapshot(spark, root).count() == 1


def test_old_copies_go_and_unfinished_ones_stay(spark, tmp_path):
    root = f"{tmp_path}/m"
    _rows(spark, 5).write.parquet(f"{root}/snapshot_ts={A.snapshot_name(WHEN)}")  # a name without a moment is older
    (tmp_path / "m" / "snapshot_ts=20990101_000000").mkdir()
    A.write_snapshot(_rows(spark, 4), root, WHEN)
    A.write_snapshot(_rows(spark, 3), root, WHEN.replace(day=3), keep=2)
    assert len(list((tmp_path / "m").iterdir())) == 3 and A.latest_snapshot(spark, root).count() == 3
    A.write_snapshot(_rows(spark, 2), root, WHEN.replace(day=4), keep=1)
    assert len(list((tmp_path / "m").iterdir())) == 2 and A.latest_snapshot(spark, root).count() == 2
    with pytest.raises(ValueError):
        A.write_snapshot(_rows(spark, 1), root, WHEN, keep=0)
