"""The two pieces of Spark set-up that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the named columns of ``docs``, whatever else it carries; one input split per core or more."""
    from recordmill.session import widen

    return widen(docs.select("doc_id", "text", *more))


def bucket(column: str, n: int):
    """crc32 of an id's decimal text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``counts``, a staged table of distinct ``keys`` and the number ``n`` of ``rows`` that hold each.

    Keys of more than one part in HOT_KEYS of all these rows are fewer than HOT_KEYS, so their staged table is small at
    any size of input and Spark broadcasts it: their rows stay where they lie. All others are shuffled, none of them large. No row is left out.
    """
    from recordmill.session import stage

    total = counts.agg(F.sum(n)).first()[0] or 0
    many = F.col(n) * HOT_KEYS > total
    hot = stage(counts.where(many).drop(n), "hot")
    others = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys, how).unionByName(others.join(counts.where(~many).drop(n), keys, how))
