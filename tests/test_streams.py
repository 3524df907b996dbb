from datetime import datetime

from conftest import SF
from pyspark.sql import functions as F

from recordmill.operators import master as M
from recordmill.operators import reshape as R
from recordmill.sources import fixtures as X
from recordmill.streaming import ingest as G


def test_stream_equals_batch(spark, tmp_path):
    """Several batches, one delivered again, end where a single upsert ends."""
    rows = R.fill_decision_number(X.notices(spark, SF)).withColumn("part", (F.col("ingest_pos") / 500).cast("int"))
    for i in range(3):
        rows.where(F.col("part") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        G.start_ingest(stream, f"{tmp_path}/ledger", f"{tmp_path}/check").awaitTermination()
    G.append_batch(rows.where("part = 2"), 2, f"{tmp_path}/ledger")  # redelivered

    batch = M.upsert_master(rows.limit(0), rows).drop("seq_no")
    got = G.read_ingested(spark, f"{tmp_path}/ledger")
    assert sorted(map(tuple, got.drop("seq_no").collect())) == sorted(map(tuple, batch.collect()))
    assert got.agg(F.max("seq_no"), F.countDistinct("seq_no")).first()[:] == (got.count(), got.count())


def test_log_lines(spark):
    lines = [
        "2025-06-01 10:00:00,123 - crawl - INFO - 正在处理 甲",
        "2025-06-01 10:00:02,000 - crawl - INFO - 智能爬取完成，2025年5月共获得: 37 条",
        "2025-06-01 10:00:01,000 - crawl - ERROR - 正在处理 乙", "no log line",
    ]
    logs = G.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).withColumn("line_no", F.monotonically_increasing_id())
    assert logs.count() == 3 and logs.agg(F.min("ts")).first()[0] == datetime(2025, 6, 1, 10, 0, 0, 123000)
    row = G.run_log_extract(logs).first()
    assert (row.current_task, row.total_records) == ("正在处理 乙", 37)
    assert [r.message for r in G.log_tail(logs, 1).collect()] == [lines[1].split(" - ", 3)[3]]


def test_stream_dedup(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:05:00"), ("b", "2025-01-01 00:01:00")], "k string, t string")
    rows.select("k", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, t timestamp").parquet(f"{tmp_path}/in")
    query = G.stream_dedup(stream, ["k"], "t", "1 hour").writeStream.format("memory").queryName("kept").option(
        "checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.k for r in spark.table("kept").collect()) == ["a", "b"]


def test_late_rows_are_marked_not_dropped(spark, tmp_path):
    """First, repeat, late and a key whose state is older than the watermark, over three batches."""
    batches = [[("a", 0, "2025-01-01"), ("a", 1, "2025-01-02"), ("b", 2, "2025-01-10")], [("a", 3, "2025-01-09"), ("c", 4, "2025-01-03"), ("b", 5, "2025-01-10")],
               [("b", 6, "2025-03-01"), ("d", 7, "2025-01-01")], [("b", 8, "2025-03-02"), ("a", 9, "2025-03-02"), ("d", 10, "2025-01-01")]]
    for rows in batches:
        spark.createDataFrame(rows, "k string, ingest_pos long, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ingest_pos long, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    marked = G.mark_repeats(stream, ["k"], "t", "5 days")
    with G.without_empty_batches(spark):
        query = marked.writeStream.format("memory").queryName("marked").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.ingest_pos: r.mark for r in spark.table("marked").collect()}
    assert got == {0: "first", 1: "repeat", 2: "first", 3: "repeat", 4: "late", 5: "repeat", 6: "repeat", 7: "late", 8: "first", 9: "first", 10: "late"}
