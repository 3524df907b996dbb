"""The ledger and its reports on disk: snapshots, appended batches, text files."""

from __future__ import annotations

import time
import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill import fixed
from recordmill.functions import text as X
from recordmill.operators.reshape import ADDED, category_rank, number_rows
from recordmill.operators.stats import category_dim
from recordmill.session import delete
from recordmill.sources import ledger

RECORD_END = "\x1e"

LEDGER_SCHEMA = T.StructType([
    T.StructField(name, T.LongType() if name == "seq_no" else T.StringType())
    for name in fixed.LEDGER_FIELDS.values()
])


def scan_master(spark: SparkSession, path: str, schema: T.StructType = LEDGER_SCHEMA) -> DataFrame:
    """A stored ledger, or an empty one with the same columns where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def with_added(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """``schema`` and those of the added columns that any file of the stored ledger has."""
    try:
        stored = spark.read.option("mergeSchema", True).parquet(path).columns
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return schema
    return T.StructType(schema.fields + [T.StructField(c, T.DataType.fromDDL(t)) for c, t in ADDED.items() if c in stored])


# --- snapshots ------------------------------------------------------------------------------


def snapshot_name(ts: datetime) -> str:
    return ts.strftime("%Y%m%d_%H%M%S")


def write_snapshot(df: DataFrame, root: str, ts: datetime, keep: int | None = None) -> None:
    """A new dated copy beside the earlier ones, named by its time, the moment of writing and a random part.

    So no listing picks the name: writers of one second never meet, and the later one's copy is the newer. With ``keep`` only
    so many complete copies, the newest, stay once this one is complete; copies that are still being written are left alone.
    """
    if keep is not None and keep < 1:
        raise ValueError("at least the copy just written is kept")
    spark = df.sparkSession
    df.write.parquet(f"{root}/snapshot_ts={snapshot_name(ts)}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
    for old in _complete(spark, root)[:-keep] if keep else ():
        delete(spark, f"{root}/{old}")


def _complete(spark: SparkSession, root: str) -> list[str]:
    """Folders of the copies whose writing ended, oldest first."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    return sorted(
        f for f in folders
        if f.startswith("snapshot_ts=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{f}/_SUCCESS"))
    )


def latest_snapshot(spark: SparkSession, root: str, schema: T.StructType = LEDGER_SCHEMA) -> DataFrame:
    """The newest complete copy, only whose folder is read; or the ledger that is kept there in parts."""
    if ledger.is_kept(spark, root):
        return ledger.read(spark, root)
    done = _complete(spark, root)
    path = f"{root}/{done[-1]}" if done else f"{root}/none"
    return scan_master(spark, path, with_added(spark, path, schema))


# --- reports --------------------------------------------------------------------------------


def write_report(main: DataFrame, stats: DataFrame, path: str) -> None:
    """The ledger and its statistics as two tables of one report."""
    main.write.mode("overwrite").parquet(f"{path}/main")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def write_by_category(df: DataFrame, path: str, categories=fixed.CATEGORIES) -> None:
    """One folder of rows per category, and a count for every category, empty ones too.

    Each task writes its own file per category, so a large category has many writers.
    """
    df.write.mode("overwrite").partitionBy("category").parquet(f"{path}/rows")
    counts = df.groupBy("category").agg(F.count("*").alias("n"))
    category_dim(df.sparkSession, categories).join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("records")
    ).write.mode("overwrite").parquet(f"{path}/counts")


def export_text(df: DataFrame, *order: str) -> DataFrame:
    """One text per record as ``(file_key, category, body)``; of equal keys the last record wins.

    Records stand by category rank, then by the ``order`` columns (``ingest_pos`` by default). The key is the title with unsafe characters replaced, or category and position without one.
    """
    placed = number_rows(df, [F.col(c) for c in order or ("ingest_pos",)], name="_position", by=["category"])
    fallback = F.concat_ws("_", F.col("category"), F.col("_position").cast("string"))
    key = F.regexp_replace(X.first_nonempty(F.col("title"), fallback), fixed.UNSAFE_IN_NAME, "_")
    columns = {**fixed.LEDGER_FIELDS, fixed.SEQ: "source_seq"}
    lines = [
        F.concat(F.lit(f"{label}\t"), F.coalesce(F.col(columns[label]).cast("string"), F.lit("")))
        for label in fixed.TEXT_REPORT_FIELDS
    ]
    body = F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n"))
    last = F.row_number().over(
        W.partitionBy("file_key").orderBy(category_rank(F.col("category")).desc(), F.col("_position").desc())
    )
    return (
        placed.withColumn("file_key", key)
        .withColumn("_last", last).where(F.col("_last") == 1)
        .select("file_key", "category", body.alias("body"))
    )


def write_text(texts: DataFrame, path: str) -> None:
    """Text reports below one folder per category, many to a file: the key's line, then the body, then a record separator.

    Line breaks in a key, and separators inside texts, become blanks.
    """
    key = F.regexp_replace("file_key", r"[\r\n\x1E]", " ")
    body = F.translate("body", RECORD_END, " ")
    texts.select("category", F.concat(key, F.lit("\n"), body).alias("value")).write.mode("overwrite").partitionBy(
        "category").option("lineSep", RECORD_END).text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(file_key, category, body)`` of the reports ``write_text`` wrote."""
    stored = spark.read.schema("value string, category string").option("lineSep", RECORD_END).text(path)
    return stored.select(
        F.substring_index("value", "\n", 1).alias("file_key"), "category", F.expr("substr(value, instr(value, '\n') + 1)").alias("body"))


# --- labelled text files --------------------------------------------------------------------


def read_labelled_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(file, line_no, line)`` of small text files, whole files at a time."""
    whole = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_name").alias("file"), F.split("value", r"\r?\n").alias("lines")
    )
    return whole.select("file", F.posexplode("lines").alias("line_no", "line"))


def _one_tab(line: Column) -> Column:
    """Tabs stay only after a part that names a label."""
    def part(p):
        return F.when(X.contains_any(p, fixed.LABELLED_FIELDS), F.concat(p, F.lit("\t"))).otherwise(p)

    return X.strip(F.array_join(F.transform(F.split(line, "\t"), part), ""))


def labelled_lines_to_row(lines: DataFrame) -> DataFrame:
    """One row per file with a column per label: the text after the label, the last line winning.

    A line belongs to the first label, in list order, that it contains. Lines are dealt by file before
    they are sorted for the maximum by line number, so a task sorts one partition of the shuffle, not
    all lines of its input split.
    """
    label = F.coalesce(*[F.when(F.col("clean").contains(x), F.lit(x)) for x in fixed.LABELLED_FIELDS])
    value = X.strip(F.expr("substr(clean, instr(clean, label) + length(label))"))
    labelled = lines.select("file", "line_no", _one_tab(F.col("line")).alias("clean")).withColumn("label", label)
    last = [
        F.coalesce(F.expr(f"max_by(value, line_no) FILTER (WHERE label = '{x}')"), F.lit("")).alias(x)
        for x in fixed.LABELLED_FIELDS
    ]
    return labelled.select("file", "line_no", "label", value.alias("value")).repartition("file").groupBy("file").agg(*last)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("seq_no").limit(n)
