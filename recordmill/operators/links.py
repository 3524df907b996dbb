"""List pages: which links to follow and what date each carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions.text import contains_any, first_nonempty
from recordmill.sources.pages import read_parts


def chosen_links(links: Column, keywords=fixed.LINK_KEYWORDS, href_part: str = fixed.DETAIL_HREF) -> Column:
    """Links whose text holds a keyword; only if a page has none, those whose address holds ``href_part``."""
    by_text = F.filter(links, lambda a: contains_any(a["text"], keywords))
    by_href = F.filter(links, lambda a: a["href"].contains(href_part))
    chosen = F.when(F.size(by_text) > 0, by_text).otherwise(by_href)
    return F.filter(chosen, lambda a: (a["href"] != "") & (a["text"] != ""))


def resolve_url(href: Column, base: str) -> Column:
    """Absolute address of a link on a site; ``base`` is the site's scheme and host."""
    base = base.rstrip("/")
    scheme = base.split("//", 1)[0]
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.substr(href, F.length(path) + 1)
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    climbed = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    folder = F.when(path.rlike(r"(^|/)\.{0,2}$") & (F.size(climbed) > 0), F.lit("/")).otherwise(F.lit(""))
    on_site = F.concat(F.lit(base + "/"), F.array_join(climbed, "/"), folder, tail)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(scheme), href))
        .when(path == "", F.concat(F.lit(base), href))
        .otherwise(on_site)
    )


def page_dates(days: Column) -> Column:
    """Distinct dates of a page, newest first."""
    return F.sort_array(F.array_distinct(days), asc=False)


def link_day(link: Column, days: Column, place: Column) -> Column:
    """Date of a link: its row's cells, its row, the nearest enclosing element, else the page's nth date."""
    nth = F.get(days, place - 1)
    return F.coalesce(link["cell_day"], link["row_day"], link["near_day"], nth).try_cast("date")


def extract_links(
    pages: DataFrame, base: str, keywords=fixed.LINK_KEYWORDS, href_part: str = fixed.DETAIL_HREF
) -> DataFrame:
    """One row per followed link: the page's columns, ``title``, ``detail_url``, ``pos``, ``publish_date``.

    Everything happens inside the page's own row, so nothing is shuffled. ``pos`` counts the
    followed links of the page from 1.
    """
    kept = [c for c in pages.columns if c != "html"]
    parts = read_parts(pages, "links", "days")
    return (
        parts.select(
            *kept, "days", F.posexplode_outer(chosen_links(F.col("links"), keywords, href_part)).alias("_at", "_link")
        )
        .where(F.col("_link").isNotNull())
        .select(
            *kept,
            F.col("_link.text").alias("title"),
            resolve_url(F.col("_link.href"), base).alias("detail_url"),
            (F.col("_at") + 1).alias("pos"),
            link_day(F.col("_link"), F.col("days"), F.col("_at") + 1).alias("publish_date"),
        )
    )


def label_time(times: Column) -> Column:
    """Date in the most telling time-labelled element that holds one; '' if there is none."""
    ordered = F.array_sort(F.transform(times, lambda t, i: F.struct(t["rank"].alias("rank"), i.alias("i"), t["text"].alias("text"))))
    found = F.transform(
        F.filter(ordered, lambda t: t["text"].contains(fixed.TIME_LABEL)),
        lambda t: F.regexp_extract(t["text"], f"({fixed.LOOSE_DAY})", 1),
    )
    return F.coalesce(F.get(F.filter(found, lambda d: d != ""), F.lit(0)), F.lit(""))


def source_time(html: Column) -> Column:
    """Date after a time label anywhere in the markup, trying the labels in order; '' if none."""
    return first_nonempty(
        *[F.regexp_extract(html, rf"{label}[：:]\s*({fixed.LOOSE_DAY})", 1) for label in fixed.SOURCE_TIME_LABELS]
    )


def extract_publish_time(pages: DataFrame) -> DataFrame:
    """Page columns without the markup, plus ``publish_time`` text."""
    kept = [c for c in pages.columns if c != "html"]
    parts = read_parts(pages.withColumn("_source_time", source_time(F.col("html"))), "times")
    return parts.select(*kept, first_nonempty(label_time(F.col("times")), F.col("_source_time")).alias("publish_time"))
