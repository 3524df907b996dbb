"""The ledger as a stream: appended batches, bounded repeats, daily counts, run logs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from recordmill import fixed
from recordmill.operators.master import PRIMARY_KEY
from recordmill.sources import ledger

STATE_BUCKETS = 1024  # fixed for the life of a checkpoint


def append_batch(batch: DataFrame, batch_id: int, root: str, compact_every: int | None = None, both_times: bool = False) -> None:
    """Append the rows the ledger lacks as this batch's own part; a redelivered batch changes nothing, merged or not.

    Of earlier parts only those are read whose key filter has one of the batch's keys. After every ``compact_every`` batches
    the parts are merged into one.
    """
    ledger.append(batch.sparkSession, root, batch, batch_id, both_times=both_times)
    if compact_every and batch_id % compact_every == compact_every - 1:
        ledger.compact(batch.sparkSession, root)


def start_ingest(
    records: DataFrame, root: str, checkpoint: str, compact_every: int | None = None, both_times: bool = False, **trigger,
) -> StreamingQuery:
    """Upsert every arriving batch of ledger rows; by default drains what is there and stops."""
    return (
        records.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, root, compact_every, both_times))
        .start()
    )


def read_ingested(spark: SparkSession, root: str) -> DataFrame:
    """The ledger the stream has built, numbered newest first."""
    return ledger.read(spark, root)


def stream_dedup(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Drop keys seen within the watermark, and rows older than it; ``mark_repeats`` keeps the latter."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def mark_repeats(stream: DataFrame, keys: list[str], time: str, within: str, order: str = "ingest_pos", live: str | None = None) -> DataFrame:
    """``stream`` with ``mark``: 'first' of its key, 'repeat' of one that came at most ``within`` before the watermark, or 'late'.

    No row is dropped: late ones, older than the watermark, are for the ledger's own dedup. Of one batch the row of smallest
    ``order`` is first; of a key with very many rows at once several may be marked so, each smaller than those before. The
    state is one time per key and goes when it is ``within`` behind the watermark, or when the key has not come for ``live``
    (by default ``within``) of processing time. Keys are dealt into ``STATE_BUCKETS`` buckets, each a call and a state of its
    own, so a batch costs a call for every bucket it touches, not for every key.
    To be started inside ``without_empty_batches``.
    """
    within_ms, live_ms = (_milliseconds(x) for x in (within, live or within))
    names = stream.columns
    key, bucket = (_free(name, names) for name in ("_key", "_bucket"))

    def marked(_, chunks, state):
        if state.hasTimedOut:  # no key of the bucket has come for so long
            state.remove()
            return
        watermark, now = state.getCurrentWatermarkMs(), state.getCurrentProcessingTimeMs()
        held = {k: (at, until) for k, at, until in zip(*state.get, strict=True) if at + within_ms >= watermark} if state.exists else {}
        least = {}  # the smallest place of a key marked first in this batch: chunks of a large group come in any order
        firsts, came = {}, set()
        for chunk in chunks:
            at, place, who = chunk[time].to_numpy().astype("datetime64[ms]").astype("int64"), chunk[order].to_numpy(), chunk[key].to_numpy()
            marks = np.where(at < watermark, "late", "repeat").astype(object)
            best = {}
            for i in np.flatnonzero(at >= watermark):
                k = who[i]
                if k not in held and (k not in best or place[i] < place[best[k]]):
                    best[k] = i
            for k, i in best.items():
                if k not in least or place[i] < least[k]:
                    least[k], marks[i], firsts[k] = place[i], "first", int(at[i])
            came.update(who)
            yield chunk[names].assign(mark=marks)
        kept = {k: (at, now + live_ms if k in came else until) for k, (at, until) in held.items() if k in came or until > now}
        kept.update({k: (at, now + live_ms) for k, at in firsts.items()})
        if kept:
            state.update((list(kept), [at for at, _ in kept.values()], [until for _, until in kept.values()]))
            state.setTimeoutDuration(live_ms)
        elif state.exists:
            state.remove()

    schema = T.StructType([*stream.schema.fields, T.StructField("mark", T.StringType())])
    whole = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    dealt = stream.withWatermark(time, within).withColumn(key, whole).withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(STATE_BUCKETS)))
    return dealt.groupBy(bucket).applyInPandasWithState(
        marked, schema, "keys array<string>, at array<bigint>, until array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _milliseconds(interval: str) -> int:
    """A number and a unit, as watermarks have them."""
    n, unit = interval.split()
    return int(timedelta(**{f"{unit.removesuffix('s')}s": float(n)}) / timedelta(milliseconds=1))


def start_deduplicated(records: DataFrame, root: str, checkpoint: str, time: str, within: str, **trigger) -> StreamingQuery:
    """Ingest a stream that repeats much: repeats seen within the watermark are dropped by key, first and late rows go to the ledger, which is exact."""
    marked = mark_repeats(records, list(PRIMARY_KEY), time, within)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch.where("mark <> 'repeat'").drop("mark"), batch_id, root)

    with without_empty_batches(records.sparkSession):
        return marked.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


@contextmanager
def without_empty_batches(spark: SparkSession) -> Iterator[None]:
    """Queries started inside run no batch without data: with a state that ends by the clock, such batches would never end."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def daily_trend_stream(stream: DataFrame, time: str, within: str) -> DataFrame:
    """Rows per day over tumbling one-day windows."""
    return (
        stream.withWatermark(time, within)
        .groupBy(F.window(time, "1 day").alias("w"))
        .agg(F.count("*").alias("records"))
        .select(F.col("w.start").cast("date").alias("day"), "records")
    )


def parse_log(lines: DataFrame) -> DataFrame:
    """Log text ``time - logger - level - message`` in column ``value`` to log rows."""
    part = r"^(\S+ \S+) - (.*?) - ([A-Z]+) - (.*)$"

    def group(i: int):
        return F.regexp_extract("value", part, i)

    when = F.replace(group(1), F.lit(","), F.lit(".")).try_cast("timestamp")
    return lines.where(F.col("value").rlike(part)).select(
        when.alias("ts"), group(2).alias("logger"), group(3).alias("level"), group(4).alias("message")
    )


def run_log_extract(logs: DataFrame) -> DataFrame:
    """Latest task message and latest finished record count, per logger."""
    done = F.when(
        F.col("message").contains(fixed.DONE_MARK),
        F.nullif(F.regexp_extract("message", fixed.DONE_COUNT, 1), F.lit("")).try_cast("bigint"),
    )
    task = F.when(F.col("message").contains(fixed.TASK_MARK), F.col("message"))
    at = F.struct("ts", "line_no")
    return (
        logs.select("logger", at.alias("at"), task.alias("task"), done.alias("done"))
        .groupBy("logger")
        .agg(
            F.max_by("task", F.when(F.col("task").isNotNull(), F.col("at"))).alias("current_task"),
            F.max_by("done", F.when(F.col("done").isNotNull(), F.col("at"))).alias("total_records"),
        )
    )


def log_tail(logs: DataFrame, n: int = 250) -> DataFrame:
    """The newest ``n`` entries; each task keeps only its own newest ``n``."""
    return logs.orderBy(F.col("ts").desc(), F.col("line_no").desc()).limit(n)
