"""Plans keep their shape: what reaches the scan, what is shuffled, where Python runs."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from recordmill.operators import master as M
from recordmill.operators import reshape as R
from recordmill.operators import select as C
from recordmill.operators import tables as B
from recordmill.plans.queries import QUERIES
from recordmill.sources import fixtures as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e9_dedup_business_key", "e10_dedup_fallback"])
def test_rank_limits_apply_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert re.search(r"WindowGroupLimit.*Partial", text) and "SinglePartition" not in text


@pytest.mark.parametrize("name", ["c8_take_while_recent", "e1_process_category"])
def test_numbering_needs_no_window_over_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Window" not in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["e5_sort_by_time", "e8_renumber"])
def test_numbers_come_from_counts(spark, name):
    """Rows are hashed by cell and ranked within it; nothing is range-partitioned, gathered or computed twice."""
    text = plan(QUERIES[name](spark, SF))
    assert "rangepartitioning" not in text and "SinglePartition" not in text and "orders.parquet" not in text
    ranked = re.findall(r"row_number\(\) windowspecdefinition\(([^\]]*)", text)
    assert ranked and all("_cell" in r for r in ranked)


@pytest.mark.parametrize("n", [25, 5000])
def test_a_cap_of_any_size_gathers_no_category(spark, n):
    text = plan(C.record_cap(X.list_items(spark, SF), n))
    assert "Window" not in text and "SinglePartition" not in text


def test_extraction_is_one_pass_without_a_shuffle(spark, tmp_path):
    pages = X.detail_html(spark, SF).select("url", "html", "title")
    pages.write.parquet(f"{tmp_path}/pages")
    out = B.expand_multi_record(B.extract_nested(spark.read.parquet(f"{tmp_path}/pages")), F.lit("t"), F.col("title"))
    text = plan(out)
    assert text.count("MapInArrow") == 1 and "Exchange" not in text


def test_date_windows_reach_the_scan(spark, tmp_path):
    X.notices(spark, SF).withColumnRenamed("order_day", "publish_date").write.partitionBy("category").parquet(f"{tmp_path}/n")
    stored = spark.read.parquet(f"{tmp_path}/n")
    text = plan(C.list_date_window(C.filter_categories(stored, "1"), *C.month_window(1996, 12)).select("ingest_pos"))
    assert "PushedFilters: [IsNotNull(publish_date), GreaterThanOrEqual(publish_date,1996-12-01)" in text
    assert re.search(r"PartitionFilters: \[[^\]]*category", text)
    assert "ReadSchema: struct<ingest_pos:bigint,publish_date:date>" in text


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("f2_master_stats", "f3_quality_report", "f5_kpis", "f7_daily_trend", "e13_upsert_counts"):
        assert "partial_" in plan(QUERIES[name](spark, SF)), name


def test_appending_reads_only_keys_of_the_master(spark, tmp_path):
    rows = R.fill_decision_number(X.notices(spark, SF))
    rows.write.parquet(f"{tmp_path}/m")
    text = plan(M.new_records(spark.read.parquet(f"{tmp_path}/m"), rows))
    schemas = re.findall(r"ReadSchema: (\S+)", text)
    assert "struct<entity_name:string,decision_document_number:string,decision_authority:string>" in schemas


def test_no_query_crosses_or_pins_locally(spark):
    import pathlib

    package = pathlib.Path(__file__).parent.parent / "recordmill"
    for path in package.rglob("*.py"):
        words = ["crossJoin", "localCheckpoint", ".toPandas(", "F.broadcast("]
        if path.parent.name != "llm":  # models of bounded size are gathered there: terms, the labelled sample, languages
            words.append(".collect()")
        assert not [w for w in words if w in path.read_text()], path



def test_a_small_batch_reads_little_of_the_ledger(spark, tmp_path):
    """Parts whose filter has none of the batch's keys are not read, and of the others only the batch's buckets of the keys."""
    from recordmill.sources import ledger

    rows = R.fill_decision_number(X.notices(spark, SF))
    for i in range(4):
        ledger.append(spark, f"{tmp_path}/m", rows.where(F.col("ingest_pos") % 4 == i))
    one = rows.where("ingest_pos = 1")
    state = ledger.manifest(spark, f"{tmp_path}/m")
    keys = ledger.candidate_keys(spark, f"{tmp_path}/m", state, one)
    assert keys.count() >= 1 and len(keys.inputFiles()) >= 1
    read = [f for f in keys.inputFiles() if "/bucket=" in f]
    folders = {f.split("/bucket=")[1].split("/")[0] for f in read}
    parts = {f.split("/part=")[1].split("/")[0] for f in read}
    assert len(parts) < 4
    text = plan(keys)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text) and "Exchange" not in text
    assert len(folders) > 0
    unknown = one.withColumn("entity_name", F.lit("nobody has this name"))
    before = len(list(tmp_path.rglob("*.parquet")))
    assert ledger.append(spark, f"{tmp_path}/m", one).first().inserted == 0
    assert len(list(tmp_path.rglob("*.parquet"))) == before  # nothing is written for a batch without news
    assert ledger.append(spark, f"{tmp_path}/m", unknown).first().inserted == 1
    text = plan(ledger.read(spark, f"{tmp_path}/m"))
    assert "Window" not in text and "Sort " not in text and "rangepartitioning" not in text
