"""Marking a stream costs a call for every bucket of keys, not for every key."""

from pyspark.sql import functions as F

from recordmill.streaming import ingest as G


def test_a_bucket_holds_many_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "STATE_BUCKETS", 2, raising=False)
    for batch, first in enumerate((0, 150)):  # the second file repeats half of the keys; a null key is a key
        rows = spark.range(first, first + 300).selectExpr(
            "IF(id % 50 = 0, NULL, string(id)) AS k", f"id + {batch} * 1000 AS ingest_pos", "timestamp'2025-01-01' AS t")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ingest_pos long, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    marked = G.mark_repeats(stream, ["k"], "t", "5 days")
    with G.without_empty_batches(spark):
        query = marked.writeStream.format("memory").queryName("many").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("many")
    assert got.count() == 600 and got.where("mark = 'first'").count() == got.where("k IS NOT NULL").select("k").distinct().count() + 1
    assert [r.ingest_pos for r in got.where("mark = 'first' AND k IS NULL").collect()] == [0]
    states = sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
    assert states == 2
    assert got.where(F.col("mark") == "late").count() == 0
