"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_BATCH_BYTES = 4 << 20
TASKS_PER_SPLIT = 6

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()
_open: list[list[str]] = []      # paths written inside each ``passing`` block that is open


def build_session(app: str = "recordmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on, and this package on the executors' path."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # Pages are large: a batch sent to Python ends at this size, however few rows it holds. Both sides keep memory for several batches.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="recordmill-code-")) / package.name
        spark.sparkContext.addPyFile(
            shutil.make_archive(str(archive), "zip", root_dir=package.parent, base_dir=package.name)
        )
        _shipped.add(app)
    return spark


def widen(df: DataFrame) -> DataFrame:
    """Spread few input splits over the cluster ahead of costly per-row work.

    Input that already has a split per core, as any large table does, is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """Deal rows ahead of work that costs far more than moving them, as reading markup does: several tasks a core, more for larger inputs.

    A join's partitions are sized for its bytes, so a few tasks would get all the work. ``source`` is the table, as read, that the rows
    come from: its splits are known from its files, while asking a join for its own would run its shuffles ahead of the query.
    """
    splits = max(df.sparkSession.sparkContext.defaultParallelism, source.rdd.getNumPartitions())
    return df.repartition(TASKS_PER_SPLIT * splits)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="recordmill-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    What follows no longer recomputes its input when an executor is lost, sees the same
    non-deterministic ids on every read, prunes columns, and knows the real size, so Spark's
    own threshold decides whether a join side may be broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for paths in _open[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stage`` writes inside the block are deleted at its end.

    What is to outlive the block must have been written elsewhere by then; a result that still reads a staged table must not leave it.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
