"""An append writes the ledger's rows once as a part: no staged copy beside it, and none of the new rows while the ledger is empty."""

from recordmill.operators.master import LEDGER_TEXT
from recordmill.sources import ledger as K


def test_rows_of_a_part_are_written_once(spark, tmp_path, monkeypatch):
    staged = []
    whole = K.stage
    monkeypatch.setattr(K, "stage", lambda df, label="stage": staged.append(label) or whole(df, label))
    root = str(tmp_path / "ledger")

    def batch(*names):
        rows = [(i, *["2001-01-01" if c in ("publish_time", "crawl_time") else n for c in LEDGER_TEXT]) for i, n in enumerate(names, 1)]
        return spark.createDataFrame(rows, ["ingest_pos", *LEDGER_TEXT])

    K.append(spark, root, batch("a", "b", "a"), both_times=True)
    assert staged == ["batch", "first"]
    K.append(spark, root, batch("b", "c", None), both_times=True)
    assert staged[2:] == ["batch", "first", "new"]
    rows = K.read(spark, root).orderBy("seq_no").collect()
    assert [(r.seq_no, r.entity_name) for r in rows] == [(1, "a"), (2, "b"), (3, "c")]
