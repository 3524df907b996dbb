"""Which records a run takes: categories, caps, dates and windows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions import text as T
from recordmill.operators.reshape import number_by_counts
from recordmill.session import stage


def resolve_categories(arg: str | None) -> list[str]:
    """Names or aliases, comma separated; unknown ones are ignored, and none at all means every one."""
    asked = [part.strip() for part in (arg or "").split(",")]
    known = {**{c: c for c in fixed.CATEGORIES}, **fixed.CATEGORY_ALIASES}
    found = dict.fromkeys(known[a] for a in asked if a in known)
    return list(found) or list(fixed.CATEGORIES)


def filter_categories(df: DataFrame, arg: str | None) -> DataFrame:
    """A plain IN list, so a partitioned ledger reads only those folders."""
    return df.where(F.col("category").isin(*resolve_categories(arg)))


def page_cap(df: DataFrame, pages: int | None) -> DataFrame:
    return df if pages is None else df.where(F.col("page") <= pages)


def record_cap(df: DataFrame, records: int | None) -> DataFrame:
    """The first ``records`` items of each category in order of page and ``pos``, however many; null pages come first.

    Items are counted per page and range of pages. Prefix sums tell the range, then the page, in which a category's cap falls;
    only the items of that page are numbered. No item is sorted or written otherwise, but ``df`` is read three times, once
    for its categories and pages alone: it should be a stored table.
    """
    if records is None:
        return df
    pages = stage(df.groupBy("category", "page").agg(F.count("*").alias("_n")), "pages")
    pages = pages.withColumn("_range", F.shiftright(F.col("page").cast("bigint"), _PAGE_BITS))
    ranges = pages.groupBy("category", "_range").agg(F.sum("_n").alias("_n"))
    cut = _crossing(ranges.withColumn("_ahead", F.lit(0)), "_range", records)
    cut = _crossing(_beside(pages, cut, "_range").select("category", "page", "_n", F.col("_before").alias("_ahead")), "page", records)
    cut = stage(cut, "cuts")
    rest = [f"`{c}`" for c in df.columns]
    reached = df.join(_named(cut), F.col("category").eqNullSafe(F.col("_of_category")), "left")
    before = F.col("_before").isNull() | (F.col("page") < F.col("_of_page")) | (F.col("page").isNull() & F.col("_of_page").isNotNull())
    numbered = number_by_counts(_beside(df, cut, "page").select(*rest, "_before"), ["pos"], "_rank", by=["category"])
    last = stage(numbered.where(F.col("_before") + F.col("_rank") <= records).select(*rest), "last")
    return reached.where(before).select(*rest).unionByName(last)


_PAGE_BITS = 10  # pages of a range


def _crossing(counts: DataFrame, at: str, records: int) -> DataFrame:
    """Of each category the place ``at`` whose items take it to the cap, and how many come ``_before``; none for smaller categories."""
    earlier = W.partitionBy("category").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_ahead") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    first = F.greatest(F.lit(records), F.lit(1))  # a cap of none falls on the first item
    return counts.withColumn("_before", before).where(
        (F.col("_before") < first) & (F.col("_before") + F.col("_n") >= first)).select("category", at, "_before")


def _named(cut: DataFrame) -> DataFrame:
    return cut.withColumnsRenamed({c: f"_of_{c}" for c in cut.columns if c != "_before"})


def _beside(rows: DataFrame, cut: DataFrame, at: str) -> DataFrame:
    """The rows at their category's cut."""
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("category", at)]
    return rows.join(_named(cut), same)


def filter_year(df: DataFrame, year: int) -> DataFrame:
    """The year's digits occur in the publish or crawl text; undated rows stay."""
    digits = str(year)
    publish, crawl = (F.coalesce(F.col(c), F.lit("")) for c in ("publish_time", "crawl_time"))
    undated = (publish == "") & (crawl == "")
    return df.where(publish.contains(digits) | crawl.contains(digits) | undated)


def filter_month(df: DataFrame, year: int, month: int) -> DataFrame:
    """Publish (else crawl) time lies in the month; unreadable text must contain 'Y-m'; undated rows go."""
    text = T.first_nonempty(F.col("publish_time"), F.col("crawl_time"))
    when = T.strict_time(text)
    start, end = month_window(year, month)
    inside = (when >= _instant(start)) & (when < _instant(end))
    return df.where(F.when(when.isNotNull(), inside).otherwise(text.contains(f"{year}-{month:02d}")))


def filter_last_days(df: DataFrame, days: int, now: datetime) -> DataFrame:
    """Publish time within ``days`` before ``now``; rows without one stay, unreadable ones go."""
    text = F.coalesce(F.col("publish_time"), F.lit(""))
    return df.where((text == "") | (T.strict_time(text) >= _instant(now - timedelta(days=days))))


def _instant(when: date | datetime) -> Column:
    """Read in the session's zone; a datetime literal would be read in the driver's."""
    return F.lit(when.isoformat()).cast("timestamp")


def month_window(year: int, month: int) -> tuple[date, date]:
    return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1)


def day_window(day: date) -> tuple[date, date]:
    return day, day + timedelta(days=1)


def year_window(year: int) -> tuple[date, date]:
    return date(year, 1, 1), date(year + 1, 1, 1)


def list_date_window(items: DataFrame, start: date, end: date) -> DataFrame:
    """List rows dated in [start, end); a DATE range that reaches the scan."""
    return items.where((F.col("publish_date") >= F.lit(start)) & (F.col("publish_date") < F.lit(end)))


def take_while_recent(items: DataFrame, start: date) -> DataFrame:
    """Per category, in page order, the rows before the first one older than ``start``.

    The first old place per category is a partial minimum, so no category is gathered or sorted.
    """
    place = F.struct(F.col("page").cast("bigint").alias("page"), F.col("pos").cast("bigint").alias("pos"))
    first_old = stage(
        items.where(F.col("publish_date") < F.lit(start))
        .groupBy(F.col("category").alias("_category")).agg(F.min(place).alias("_stop")),
        "stops",
    )
    before = F.col("_stop").isNull() | (place < F.col("_stop"))
    return (
        items.join(first_old, F.col("category").eqNullSafe(F.col("_category")), "left")
        .where(before & F.col("publish_date").isNotNull()).select(*items.columns)
    )


def run_window(mode: str, today: date, init_year: int = fixed.INIT_YEAR) -> tuple[date | None, date | None]:
    """Half-open day window of a run mode; (None, None) is everything."""
    if mode not in fixed.RUN_CAPS:
        raise ValueError(f"unknown run mode {mode!r}")
    if mode == "init":
        return year_window(init_year)
    if mode == "monthly":
        last = today.replace(day=1) - timedelta(days=1)
        return month_window(last.year, last.month)
    if mode == "daily":
        return day_window(today - timedelta(days=1))
    return None, None


def tag_run_modes(items: DataFrame, today: date, modes=tuple(fixed.RUN_CAPS)) -> DataFrame:
    """One row per item and run mode whose window holds it; no join, the windows are literals."""
    def inside(mode: str):
        start, end = run_window(mode, today)
        day = F.col("publish_date")
        hit = F.lit(True) if start is None else (day >= F.lit(start)) & (day < F.lit(end))
        return F.when(hit, F.lit(mode))

    hits = F.array_compact(F.array(*[inside(m) for m in modes]))
    return items.withColumn("mode", F.explode(hits))


def select_for_run(
    items: DataFrame, mode: str, today: date, categories: str | None = None,
    max_pages: int | None = None, max_records: int | None = None, init_year: int = fixed.INIT_YEAR,
) -> DataFrame:
    """The list items a run takes: category and date window; caps only where asked for, on the items of the window."""
    start, end = run_window(mode, today, init_year)
    out = filter_categories(items, categories)
    if start is not None:
        out = list_date_window(out, start, end)
    return record_cap(page_cap(out, max_pages), max_records)
