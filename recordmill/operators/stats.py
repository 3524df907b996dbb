"""Totals, completeness, quality and trends. Every aggregate combines map-side."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions import text as T

REQUIRED = ("entity_name", "punishment_content", "decision_authority")


def category_dim(spark: SparkSession, categories=fixed.CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(categories, 1)], "category string, position int")


def _percent(part: Column, whole: Column) -> Column:
    """Percent text with one decimal; format_number rounds the exact double half-even."""
    return F.replace(F.format_number(part / whole * 100, 1), F.lit(","), F.lit(""))


def _with_total(per: DataFrame) -> DataFrame:
    """Per-category counters plus their sum as a total row, there even for no rows at all."""
    counters = [c for c in per.columns if c != "category"]
    total = per.agg(
        F.lit(fixed.TOTAL_LABEL).alias("category"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters],
    )
    return per.withColumn("is_total", F.lit(False)).unionByName(total.withColumn("is_total", F.lit(True)))


def summary_by_category(df: DataFrame, categories=fixed.CATEGORIES) -> DataFrame:
    """Rows per requested category, zeros included, and a total over all rows."""
    counts = df.groupBy("category").agg(F.count("*").alias("n"))
    dim = category_dim(df.sparkSession, categories)
    per = dim.join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("records"), "position"
    )
    total = counts.agg(
        F.lit(fixed.TOTAL_LABEL).alias("category"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.lit(len(categories) + 1).alias("position"),
    )
    return per.unionByName(total)


def complete(*columns: str) -> Column:
    flags = [~T.is_blank(F.col(c)) for c in columns]
    out = flags[0]
    for flag in flags[1:]:
        out = out & flag
    return out


def master_stats(df: DataFrame, net_new: int, now: datetime) -> DataFrame:
    """Metric rows: categories by size, total, new this month, complete records with their share.

    One scan and one aggregate; the totals add up the per-category counts.
    """
    per = df.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(complete(*REQUIRED)).alias("full")
    )
    rolled = _with_total(per)
    stamp = F.lit(now.strftime("%Y-%m-%d %H:%M:%S"))
    month = F.lit(f"{now.year:04d}年{now.month:02d}月{fixed.NEW_SUFFIX}")

    def metric(rank: int, name: Column, records: Column, note: Column, pct: Column) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"), name.alias("metric"), records.cast("bigint").alias("records"),
            note.alias("note"), pct.cast("decimal(5,1)").alias("pct"),
        )

    none = F.lit(None)
    n = F.col("n")
    pct = _percent(F.col("full"), F.nullif(n, F.lit(0)))
    note = F.concat(F.lit("完整性: "), pct, F.lit("%"))
    of_total = F.array(
        metric(2, F.lit(fixed.TOTAL_LABEL), n, stamp, none),
        metric(3, month, F.lit(net_new), stamp, none),
        metric(4, F.lit(fixed.COMPLETE_LABEL), F.col("full"), note, pct),
    )
    rows = F.when(~F.col("is_total"), F.array(metric(1, F.col("category"), n, stamp, none))).when(
        n > 0, of_total
    ).otherwise(F.slice(of_total, 1, 2))
    return rolled.select(F.explode(rows).alias("m")).select("m.*")


def quality_report(df: DataFrame) -> DataFrame:
    """Per category and in total: missing names, penalties, authorities, and valid records.

    Takes collected maps (column ``fields``, either spelling of a name) or ledger columns.
    """
    if "fields" in df.columns:
        def of(*names: str) -> Column:
            return T.first_nonempty(*[F.try_element_at("fields", F.lit(x)) for x in names]) == ""

        name, penalty = of(fixed.ENTITY, "当事人"), of(fixed.CONTENT, "处罚内容")
        authority = of(fixed.AUTHORITY, "决定机关")
    else:
        name, penalty, authority = (T.is_blank(F.col(c)) for c in REQUIRED)
    flags = df.select("category", name.alias("name"), penalty.alias("penalty"), authority.alias("authority"))
    per = flags.groupBy("category").agg(
        F.count("*").alias("total"),
        F.count_if("name").alias("missing_name"),
        F.count_if("penalty").alias("missing_punishment"),
        F.count_if("authority").alias("missing_authority"),
        F.count_if(~F.col("name") & ~F.col("penalty")).alias("valid_records"),
    )
    return _with_total(per).drop("is_total")


def issue_messages(category: Column) -> Column:
    """Messages of a report row: missing names, then missing penalties."""
    def issue(counter: str, suffix: str) -> Column:
        return F.when(F.col(counter) > 0, F.concat(category, F.lit(": "), F.col(counter).cast("string"), F.lit(suffix)))

    return F.array_compact(F.array(
        issue("missing_name", fixed.MISSING_NAME_ISSUE),
        issue("missing_punishment", fixed.MISSING_PENALTY_ISSUE),
    ))


def quality_issues(report: DataFrame) -> DataFrame:
    """One row per message, categories only."""
    per = report.where(F.col("category") != fixed.TOTAL_LABEL)
    return per.select("category", F.explode(issue_messages(F.col("category"))).alias("issue"))


def kpis(df: DataFrame) -> DataFrame:
    """Rows, distinct categories and entities, and the latest publish time.

    Rows are first counted per category and entity, so the distinct counts run on that.
    """
    pairs = df.groupBy("category", "entity_name").agg(
        F.count("*").alias("n"), F.max(T.parse_time(F.col("publish_time"))).alias("latest")
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.countDistinct(F.nullif("category", F.lit(""))).alias("categories"),
        F.countDistinct(F.nullif("entity_name", F.lit(""))).alias("entities"),
        F.date_format(F.max("latest"), "yyyy-MM-dd").alias("latest_day"),
    )


def category_distribution(df: DataFrame) -> DataFrame:
    """Count and share per category; the total comes from the counts, not the rows."""
    rolled = df.groupBy("category").agg(F.count("*").alias("records"))
    total = rolled.agg(F.sum("records")).scalar()
    return rolled.withColumn("pct", _percent(F.col("records"), total).cast("decimal(5,1)"))


def daily_trend(df: DataFrame) -> DataFrame:
    """Rows per publish day, ascending; rows without a readable day are left out."""
    day = T.parse_time(F.col("publish_time")).cast("date")
    return (
        df.select(day.alias("day")).where(F.col("day").isNotNull())
        .groupBy("day").agg(F.count("*").alias("records")).orderBy("day")
    )


def records_per_notice(df: DataFrame) -> DataFrame:
    return df.groupBy("detail_url").agg(F.count("*").alias("records"))
