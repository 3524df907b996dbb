"""Cleaning of a training corpus in stages; each works on all that the one before kept.

Stages that remove documents decide row by row: the operators see a number of the row in place of its doc_id. So a null doc_id, or one
doc_id with several texts, is judged like any other row, and of repeated rows with words near-duplicate removal keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm.minhash import near_duplicates
from recordmill.llm.pieces import round_trip
from recordmill.llm.quality import quality_rules
from recordmill.llm.secrets import redact_secrets
from recordmill.llm.tables import table
from recordmill.llm.tiling import contaminated_pairs
from recordmill.session import delete, passing, prepare, scratch_path, stage

SHINGLE = 5  # words


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do null and empty texts, which have too few words."""
    prepare(spark)
    rows, seen, number = _numbered(docs)
    return rows.join(_rows(quality_rules(seen).where("kept"), number), number, "left_semi").select(*_all(docs))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id (a null one last). Null and empty texts stay."""
    prepare(spark)
    rows, seen, number = _numbered(docs)
    grouped = near_duplicates(seen, k=SHINGLE).select(F.col("doc_id").alias(number), F.col("component_id").alias("group"))
    grouped = grouped.join(rows.select(number, "doc_id"), number).select("group", F.col("doc_id").alias("id"), F.col(number).alias("at"))
    kept = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "at")).alias("first"))
    return rows.join(kept.select(F.col("first.at").alias(number)), number, "left_semi").select(*_all(docs))


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay.

    The found numbers are staged: Spark knows how few they are, and the texts need not be shuffled to leave them out.
    """
    rows, seen, number = _numbered(docs)
    found = stage(_rows(contaminated_pairs(seen, table(prepare(spark), sf_dir, "benchmark")), number).distinct(), "found")
    return rows.join(found, number, "left_anti").select(*_all(docs))


def _redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay, null and empty texts as they are."""
    prepare(spark)
    return redact_secrets(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to; a row for every row, also for null texts (null ids), empty ones and repeated rows."""
    prepare(spark)
    return round_trip(docs)


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The rows with a number each, written once so that it stays; doc_id and text with that number as doc_id; the number's name."""
    number, taken = "_row", {c.lower() for c in docs.columns}
    while number in taken:
        number += "_"
    rows = stage(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    return rows, rows.drop("doc_id").withColumnRenamed(number, "doc_id"), number


def _rows(judged: DataFrame, number: str) -> DataFrame:
    return judged.select(F.col("doc_id").alias(number))


def _all(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [
    ("quality_rules", _quality),
    ("minhash_near_dedup", _near_dedup),
    ("benchmark_decontamination", _decontaminate),
    ("secret_scan", _redact),
    ("sentencepiece", _encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a written table before the next stage reads it.

    What a stage staged for itself is deleted when its result is written, and a result when the next one is.
    """
    docs, held = table(prepare(spark), sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        path = scratch_path(spark, name)
        with passing(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        if held:
            delete(spark, held)
        docs, held = spark.read.schema(docs.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
