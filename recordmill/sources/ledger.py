"""The kept master: appended parts, found by key through small filters, numbered from counts.

First-wins means that a stored row never changes, so an upsert appends a part with the batch's new rows. Beside its rows a
part has its keys, dealt into buckets by hash; a filter, 64 bits for every key; and counts per publish time (in a ledger of
both times, per publish and crawl time). An upsert reads the filters, then of the parts they do not exclude the buckets that
the batch touches. A row is stored with its rank among the rows of its time, which later rows never change; how many rows are newer comes from the counts when the ledger is
read. What is live stands in a numbered manifest that is never overwritten, so readers of an older one go on undisturbed
while parts are added or merged.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.functions import text as X
from recordmill.operators.master import LEDGER_TEXT, PRIMARY_KEY, first_wins, has_key
from recordmill.operators.reshape import ADDED, first_step, ledger_projection, number_by_counts, renumber
from recordmill.session import stage

BUCKETS = 32
AT_ONCE = 1 << 20          # rows of one time that a task may rank; larger batches are numbered from counts
EMPTY = {"version": 0, "parts": [], "batches": []}

_KEYS = ", ".join(f"{c} string" for c in PRIMARY_KEY) + ", bucket int"
_BITS = "words bigint, word bigint, bits bigint"


# --- manifests ------------------------------------------------------------------------------


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    return jvm, base, base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest complete manifest, or an empty one: version, live parts, and the runs of batch numbers that are in."""
    jvm, base, fs = _files(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    done = sorted(n for n in names if n.endswith(".json"))
    if not done:
        return dict(EMPTY)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(base, done[-1]))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, state: dict) -> bool:
    """Make ``state`` the next manifest; false if another writer was first. A rename makes it whole at once."""
    jvm, base, fs = _files(spark, root)
    fs.mkdirs(base)
    path = jvm.org.apache.hadoop.fs.Path
    draft, final = path(base, f"_{uuid.uuid4().hex}"), path(base, f"{state['version']:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        return False
    return True


def _covers(state: dict, batch_id: int) -> bool:
    return any(first <= batch_id <= last for first, last in state["batches"])


def _with_batch(batches: list[list[int]], batch_id: int | None) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted([*batches, *([[batch_id, batch_id]] if batch_id is not None else [])]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


# --- parts ----------------------------------------------------------------------------------


def _read(spark: SparkSession, root: str, kind: str, parts: list[dict], schema) -> DataFrame:
    """A table of the given parts only; their folders are named, none other is listed."""
    paths = [f"{root}/{kind}/part={p['name']}" for p in parts if p["rows"]]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*paths)


def _times(state: dict) -> list[str]:
    """The times that order a ledger, fixed by its first append."""
    return state.get("times", ["published"])


def _counts_schema(times: list[str]) -> str:
    return ", ".join([*(f"{c} timestamp" for c in times), "n bigint"])


def _same(times: list[str], other: str) -> list:
    return [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in times]


def _row_schema(parts: list[dict], times: list[str]) -> T.StructType:
    added = [c for c in ADDED if any(c in p["added"] for p in parts)]
    fields = [T.StructField(c, T.StringType()) for c in LEDGER_TEXT]
    fields += [T.StructField(c, T.DataType.fromDDL(ADDED[c])) for c in added]
    return T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ("ingest_pos", "batch_id")),
                         *(T.StructField(c, T.TimestampType()) for c in times), T.StructField("place", T.LongType())])


def _hash():
    return F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in PRIMARY_KEY])


def _word(words: int):
    return F.pmod(F.shiftright(_hash(), 6), F.lit(words))


def _bit():
    return F.expr("shiftleft(1L, cast(pmod(hash, 64) as int))")


def _write_part(rows: DataFrame, root: str, name: str, n: int, times: list[str]) -> None:
    """Rows, keys by bucket, filter and counts of one part; the rows are computed once and read back for the others."""
    words = 1 << max(n - 1, 1).bit_length()
    path = f"{root}/rows/part={name}"
    rows.write.mode("overwrite").parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    keys = rows.select(*PRIMARY_KEY)
    keys.withColumn("bucket", F.pmod(_hash(), F.lit(BUCKETS)).cast("int")).repartition("bucket").write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{root}/keys/part={name}")
    marks = keys.select(_word(words).alias("word"), _hash().alias("hash"))
    marks.groupBy("word").agg(F.bit_or(_bit()).alias("bits")).select(F.lit(words).cast("bigint").alias("words"), "word", "bits").write.mode(
        "overwrite").parquet(f"{root}/bits/part={name}")
    rows.groupBy(*times).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/counts/part={name}")


def candidate_keys(spark: SparkSession, root: str, state: dict, batch: DataFrame) -> DataFrame:
    """Stored keys that may equal one of the batch's: only parts whose filter has one of them, and of those the batch's buckets.

    What comes to the driver is names of parts and buckets.
    """
    parts = [p for p in state["parts"] if p["rows"]]
    sizes = sorted({p["words"] for p in parts})
    if not sizes:
        return _read(spark, root, "keys", [], _KEYS)
    wanted = batch.select(F.explode(F.array(*[F.struct(F.lit(w).cast("bigint").alias("words"), _word(w).alias("word")) for w in sizes])).alias("at"), _hash().alias("hash"))
    wanted = wanted.select("at.words", "at.word", _bit().alias("bit"))
    bits = _read(spark, root, "bits", parts, f"{_BITS}, part string")
    hit = bits.join(wanted, ["words", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("part").distinct()
    names = {r.part for r in hit.toLocalIterator()}
    buckets = [r.bucket for r in batch.select(F.pmod(_hash(), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().toLocalIterator()]
    keys = _read(spark, root, "keys", [p for p in parts if p["name"] in names], _KEYS)
    return keys.where(F.col("bucket").isin(buckets)).select(*PRIMARY_KEY)


def append(
    spark: SparkSession, root: str, batch: DataFrame, batch_id: int | None = None, at: datetime | None = None, both_times: bool = False,
) -> DataFrame:
    """Append the rows of ``batch`` that the ledger lacks; returns the counts of ``upsert_counts``.

    A numbered batch that is already in changes nothing. Parts are written before the manifest that names them, so what a
    lost writer leaves behind is never read. The batch is computed once. The first append decides whether the ledger is ordered
    by publish time alone or by ``both_times``, the crawl time coming second.
    """
    for _ in range(100):
        state = manifest(spark, root)
        before = sum(p["rows"] for p in state["parts"])
        if batch_id is not None and _covers(state, batch_id):
            return _counts(spark, before, before, 0, 0)
        times = _times(state) if state["parts"] else ["published", "crawled"] if both_times else ["published"]
        parsed = {"published": "publish_time", "crawled": "crawl_time"}
        added = [c for c in ADDED if c in batch.columns]
        position = F.col("ingest_pos" if "ingest_pos" in batch.columns else "seq_no").cast("bigint").alias("ingest_pos")
        rows = stage(batch.select(
            *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEDGER_TEXT], *[F.col(c).cast(ADDED[c]).alias(c) for c in added], position,
            *[X.parse_time(F.col(parsed[c])).alias(c) for c in times]), "batch")
        sizes = rows.agg(F.count("*").alias("rows"), F.count_if(~has_key(list(PRIMARY_KEY))).alias("blank")).first()
        named = stage(first_wins(rows, list(PRIMARY_KEY), "ingest_pos"), "first")
        new = stage(named.join(candidate_keys(spark, root, state, named), list(PRIMARY_KEY), "left_anti"), "new") if before else named
        n, dated = new.agg(F.count("*").alias("n"), F.count("published").alias("dated")).first()
        part = {"name": uuid.uuid4().hex, "rows": n, "words": 1 << max(n - 1, 1).bit_length(), "added": added, "dated": dated,
                "at": at.isoformat() if at else None}
        if n:
            earlier = _read(spark, root, "counts", state["parts"], _counts_schema(times)).join(
                new.select(*[F.col(c).alias(f"_of_{c}") for c in times]).distinct(), _same(times, "_of_"), "left_semi")
            earlier = earlier.groupBy(*[F.col(c).alias(f"_of_{c}") for c in times]).agg(F.sum("n").alias("_before"))
            if n <= AT_ONCE:
                ranked = new.withColumn("rank", F.row_number().over(W.partitionBy(*times).orderBy("ingest_pos")))
            else:
                ranked = number_by_counts(new, ["ingest_pos"], by=times, name="rank")
            placed = ranked.join(earlier, _same(times, "_of_"), "left").withColumns({
                "place": F.coalesce("_before", F.lit(0)) + F.col("rank"), "batch_id": F.lit(state["version"] if batch_id is None else batch_id).cast("bigint")})
            _write_part(placed.select(*LEDGER_TEXT, *added, "ingest_pos", "batch_id", *times, "place"), root, part["name"], n, times)
        after = {"version": state["version"] + 1, "parts": [*state["parts"], part], "batches": _with_batch(state["batches"], batch_id), "times": times}
        if _commit(spark, root, after):
            return _counts(spark, before, before + n, sizes["rows"] - n, sizes["blank"])
    raise RuntimeError(f"other writers kept changing {root}")


def _counts(spark: SparkSession, before: int, after: int, removed: int, blank: int) -> DataFrame:
    return spark.createDataFrame(
        [(before, after, after - before, after - before, removed, blank)],
        "before_count bigint, after_count bigint, net_new bigint, inserted bigint, removed bigint, removed_blank bigint")


def compact(spark: SparkSession, root: str) -> str | None:
    """Merge all live parts into one; their folders stay for readers of earlier manifests until ``vacuum``. Returns its name, if there was work.

    Parts that a writer adds meanwhile stay as they are; if another merge was first, this one is given up.
    """
    state = manifest(spark, root)
    merged = [p for p in state["parts"] if p["rows"]]
    if len(merged) < 2:
        return None
    rows = _read(spark, root, "rows", merged, _row_schema(merged, _times(state)))
    n = sum(p["rows"] for p in merged)
    part = {"name": uuid.uuid4().hex, "rows": n, "words": 1 << max(n - 1, 1).bit_length(),
            "added": [c for c in ADDED if any(c in p["added"] for p in merged)], "dated": max(p["dated"] for p in merged), "at": merged[-1]["at"]}
    _write_part(rows, root, part["name"], n, _times(state))
    gone = {p["name"] for p in state["parts"]}
    for _ in range(100):
        now = manifest(spark, root)
        if not gone <= {p["name"] for p in now["parts"]}:
            return None
        if _commit(spark, root, {**now, "version": now["version"] + 1, "parts": [part, *(p for p in now["parts"] if p["name"] not in gone)]}):
            return part["name"]
    raise RuntimeError(f"other writers kept changing {root}")


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete the folders that none of the ``keep`` newest manifests names, and the manifests before those; returns how many folders.

    To be run while no writer is at work, whose part is not named yet.
    """
    jvm, base, fs = _files(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    names = sorted(s.getPath().getName() for s in fs.listStatus(base) if s.getPath().getName().endswith(".json")) if fs.exists(base) else []
    live = set()
    for name in names[-keep:]:
        stream = fs.open(path(base, name))
        live |= {p["name"] for p in json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]}
        stream.close()
    gone = 0
    for kind in ("rows", "keys", "bits", "counts"):
        folder = path(f"{root}/{kind}")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName().removeprefix("part=") not in live:
                gone += fs.delete(status.getPath(), True)
    for name in names[:-keep]:
        fs.delete(path(base, name), False)
    return gone


def read(spark: SparkSession, root: str, state: dict | None = None) -> DataFrame:
    """The ledger of the newest (or the given) manifest, numbered newest first: no row is sorted or ranked.

    A row's number is how many rows are newer, from prefix sums over the counts of times, plus its rank in its own.
    Without any readable publish time the crawl time orders, as in ``renumber``; in a ledger of both times it always comes second.
    """
    state = state or manifest(spark, root)
    times = _times(state)
    rows = _read(spark, root, "rows", state["parts"], _row_schema(state["parts"], times))
    if times == ["published"] and not any(p["dated"] for p in state["parts"]):
        return ledger_projection(renumber(rows, "batch_id", "ingest_pos"), added=True)
    counts = _read(spark, root, "counts", state["parts"], _counts_schema(times)).groupBy(*times).agg(F.sum("n").alias("n"))
    day = stage(counts.withColumn("day", first_step(times)), "times")
    newer_days = W.orderBy(F.col("day").desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    days = stage(day.groupBy("day").agg(F.sum("n").alias("n")).withColumn("newer", F.coalesce(F.sum("n").over(newer_days), F.lit(0))).drop("n"), "days")
    within = W.partitionBy("day").orderBy(*[F.col(c).desc_nulls_last() for c in times]).rowsBetween(W.unboundedPreceding, -1)
    same = day.withColumn("in_day", F.coalesce(F.sum("n").over(within), F.lit(0))).join(days.withColumnRenamed("day", "_day"), F.col("day").eqNullSafe(F.col("_day")))
    starts = stage(same.select(*[F.col(c).alias(f"_at_{c}") for c in times], (F.col("newer") + F.col("in_day")).alias("_newer")), "starts")
    numbered = rows.join(starts, _same(times, "_at_")).withColumn("seq_no", F.col("_newer") + F.col("place"))
    return ledger_projection(numbered, added=True)


def is_kept(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` holds a ledger of parts."""
    _, base, fs = _files(spark, root)
    return fs.exists(base)

