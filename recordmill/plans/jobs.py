"""Whole runs: pages to ledger rows, upkeep of the stored master, and its analysis."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.operators import links as L
from recordmill.operators import master as M
from recordmill.operators import reshape as R
from recordmill.operators import select as C
from recordmill.operators import stats as S
from recordmill.operators import tables as B
from recordmill.session import stage
from recordmill.sources import ledger as K
from recordmill.sources import store as A


def collect_records(
    list_pages: DataFrame, detail_pages: DataFrame, site: str, mode: str, today: date, crawl_time: str,
    categories: str | None = None, max_pages: int | None = None, max_records: int | None = None,
    init_year: int = fixed.INIT_YEAR,
) -> DataFrame:
    """Raw records of the notices a run selects.

    List pages ``(url, category, page, html)``; detail pages ``(url, html)``. Windows, and
    caps where asked for, come before the join. A run that does not take everything first cuts the detail pages to its
    addresses, so only their markup is parsed; the address list is staged, and Spark broadcasts
    it when its real size allows. A full run parses every page where it lies.
    """
    items = stage(C.select_for_run(
        L.extract_links(list_pages, site), mode, today, categories, max_pages, max_records, init_year), "items")
    takes_all = max_pages is None and max_records is None and C.run_window(mode, today, init_year)[0] is None
    if takes_all and len(C.resolve_categories(categories)) == len(fixed.CATEGORIES):
        pages = detail_pages
    else:
        pages = detail_pages.join(items.select(F.col("detail_url").alias("url")), "url", "left_semi")
    nested = B.extract_nested(pages)
    records = B.expand_multi_record(nested, F.lit(crawl_time), F.lit(""))
    joined = B.join_list_detail(items, records)
    listed_title = F.create_map(F.lit(fixed.TITLE), F.try_element_at("fields", F.lit("title")))
    return joined.withColumn("fields", F.map_concat("fields", listed_title))


def pages_to_ledger(
    list_pages: DataFrame, detail_pages: DataFrame, site: str, mode: str, today: date, crawl_time: str,
    categories: str | None = None, max_pages: int | None = None, max_records: int | None = None,
    init_year: int = fixed.INIT_YEAR,
) -> DataFrame:
    """The run's ledger: cleaned, deduplicated, newest first, numbered; decision date, amount and other fields beside the twelve columns."""
    raw = collect_records(list_pages, detail_pages, site, mode, today, crawl_time, categories, max_pages, max_records, init_year)
    raw = raw.withColumn("exact", R.exact_amount(F.col("fields")))
    cleaned = R.clean_records(raw.withColumn("fields", F.map_concat("fields", F.create_map(F.lit(fixed.CATEGORY), F.col("category")))))
    rows = R.canonicalize(cleaned.withColumn("amount_yuan", F.col("exact")), "page", "pos", "record_no")
    place = ("category", "page", "pos", "record_no")
    return R.ledger_projection(R.renumber(M.first_wins(rows, list(M.PRIMARY_KEY), *place), *place), added=True)


def update_master(spark: SparkSession, root: str, batch: DataFrame, now: datetime) -> DataFrame:
    """Upsert a run's rows into the stored master at the time ``now``; returns its counts. What is read and written follows the batch.

    A folder that holds dated copies only is taken over first: its newest copy becomes the first part.
    """
    if not K.is_kept(spark, root):
        K.append(spark, root, A.latest_snapshot(spark, root), at=now)
    return K.append(spark, root, batch, at=now)


def process_and_save(
    records: DataFrame, path: str, now: datetime, master_root: str | None = None, text_export: bool = False
) -> DataFrame:
    """Save a run's collected records as a report; returns their quality report.

    Takes ``(ingest_pos, category, fields[, additional])``. The report holds every record, newest
    first; only the master, updated when ``master_root`` is given, drops repeats.
    """
    spark = records.sparkSession
    if "additional" not in records.columns:
        records = records.withColumn("additional", F.lit(None).cast("array<map<string,string>>"))
    records = stage(records, "records")
    place = ("category_no", "position", "part")
    rows = R.canonicalize(R.process_category(records), "position", "part").withColumn(
        "category_no", R.category_rank(F.col("category"))
    )
    rows = stage(rows, "rows")
    main = R.ledger_projection(R.renumber(rows, *place), added=True)
    stats = S.summary_by_category(rows).withColumn("updated", F.lit(now.strftime("%Y-%m-%d %H:%M:%S")))
    A.write_report(main, stats, f"{path}/report")
    if master_root:
        update_master(spark, master_root, spark.read.parquet(f"{path}/report/main"), now)
    if text_export:
        A.write_text(A.export_text(rows, "position", "part"), f"{path}/texts")
    return S.quality_report(records)


def save_report(ledger: DataFrame, path: str, now: datetime, net_new: int = 0) -> None:
    """The ledger with its statistics."""
    A.write_report(ledger, S.master_stats(ledger, net_new, now), path)


def analysis(ledger: DataFrame) -> DataFrame:
    """Quality counters and issues per category in one result."""
    messages = F.array_join(S.issue_messages(F.col("category")), "；")
    is_total = F.col("category") == fixed.TOTAL_LABEL
    return S.quality_report(ledger).withColumn("issues", F.when(is_total, F.lit("")).otherwise(messages))
