"""First-wins deduplication and upkeep of the master ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions import text as T
from recordmill.operators.reshape import ADDED, ledger_projection, renumber
from recordmill.session import stage

PRIMARY_KEY = ("entity_name", "decision_authority", "decision_document_number")
FALLBACK_KEY = ("entity_name", "violation_behavior", "punishment_content")
LEDGER_TEXT = [c for c in fixed.LEDGER_FIELDS.values() if c != "seq_no"]


def business_key(columns: list[str]) -> list[str]:
    """Two or more of the primary columns, else what there is of the fallback ones."""
    primary = [c for c in PRIMARY_KEY if c in columns]
    return primary if len(primary) >= 2 else [c for c in FALLBACK_KEY if c in columns]


def has_key(key: list[str]) -> Column:
    """At least one key column holds more than blanks; tried in key order, costly ones last."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")).rlike(T.NOT_BLANK) for c in key])


def first_wins(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row, in ``order``, of each key; rows with an all-blank key are removed.

    Null and '' are the same key value. The rank filter becomes a per-partition group limit
    below the shuffle, so of a key that holds a third of all rows each task sends one row.
    """
    if not key:
        return df
    values = [F.coalesce(F.col(c), F.lit("")) for c in key]
    rank = F.row_number().over(W.partitionBy(*values).orderBy(*order))
    return df.where(has_key(key)).withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def dedup(df: DataFrame, *order: str) -> DataFrame:
    """First-wins on the business key the columns at hand allow."""
    return first_wins(df, business_key(df.columns), *(order or ("ingest_pos",)))


def merge_new(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows plus the new ones whose key is not there yet; keyless new rows always come.

    Keyless rows stay out of the join, where they would all meet in one task.
    """
    keyless = T.is_blank(F.col(key))
    taken = existing.where(~keyless).select(F.col(key).alias("_taken")).distinct()
    fresh = new.where(~keyless).join(taken, F.col(key) == F.col("_taken"), "left_anti")
    return existing.unionByName(new.where(keyless), allowMissingColumns=True).unionByName(
        fresh, allowMissingColumns=True
    )


def master_and_batch(master: DataFrame, batch: DataFrame) -> DataFrame:
    """Both sides with ``source`` (0 master, 1 batch) ahead of ``ingest_pos`` in precedence.

    Of the columns beside the twelve, those that either side has come along, null on the other.
    """
    added = {c: t for c, t in ADDED.items() if c in master.columns or c in batch.columns}

    def side(df: DataFrame, source: int) -> DataFrame:
        position = F.col("ingest_pos" if "ingest_pos" in df.columns else "seq_no").cast("bigint")
        placed = df.withColumn("_position", position)
        text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEDGER_TEXT]
        more = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in added.items()]
        return placed.select(*text, *more, F.lit(source).alias("source"), F.col("_position").alias("ingest_pos"))

    return side(master, 0).unionByName(side(batch, 1))


def upsert_master(master: DataFrame, batch: DataFrame) -> DataFrame:
    """The new master: existing rows win, newest first, renumbered, twelve columns and what is added to them."""
    merged = first_wins(master_and_batch(master, batch), list(PRIMARY_KEY), "source", "ingest_pos")
    return ledger_projection(renumber(merged, "source", "ingest_pos"), added=True)


def new_records(master: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch the master lacks, for appending.

    A master kept by this rule has no repeats, so appending gives what the full upsert gives.
    Only the master's key columns are read, and first cut to keys of the batch. The batch's own
    first rows are staged: used twice, computed once, and of a known size, so Spark broadcasts
    them while they are small, and the master is not shuffled then.
    """
    key = list(PRIMARY_KEY)
    values = {f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in key}
    named = stage(first_wins(batch, key, "ingest_pos"), "batch").withColumns(values)
    wanted = named.select(*values)
    taken = master.select(*[v.alias(n) for n, v in values.items()]).join(wanted, list(values), "left_semi")
    return named.join(taken, list(values), "left_anti").drop(*values)


def upsert_counts(master: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: sizes before and after, their difference, true inserts, and rows removed."""
    rows = master_and_batch(master, batch)
    per_key = (
        rows.withColumn("keyed", has_key(list(PRIMARY_KEY)))
        .groupBy("keyed", *[F.coalesce(F.col(c), F.lit("")) for c in PRIMARY_KEY])
        .agg(
            F.count_if(F.col("source") == 0).alias("old_rows"),
            F.count("*").alias("all_rows"),
            F.min("source").alias("first_source"),
        )
    )
    kept = F.col("keyed")
    after = F.count_if(kept)
    before = F.coalesce(F.sum("old_rows"), F.lit(0))
    return per_key.agg(
        before.alias("before_count"),
        after.alias("after_count"),
        (after - before).alias("net_new"),
        F.count_if(kept & (F.col("first_source") == 1)).alias("inserted"),
        (F.coalesce(F.sum("all_rows"), F.lit(0)) - after).alias("removed"),
        F.coalesce(F.sum(F.when(~kept, F.col("all_rows"))), F.lit(0)).alias("removed_blank"),
    )
