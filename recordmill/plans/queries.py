"""Every operator as a query over the whole benchmark tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions import penalty as P
from recordmill.functions import text as T
from recordmill.operators import links as L
from recordmill.operators import master as M
from recordmill.operators import reshape as R
from recordmill.operators import select as C
from recordmill.operators import stats as S
from recordmill.operators import tables as B
from recordmill.plans import jobs
from recordmill.session import prepare, scratch_path, spread, widen
from recordmill.sources import fixtures as X
from recordmill.sources import ledger as K
from recordmill.sources import store as A
from recordmill.sources.pages import read_parts, scan_pages
from recordmill.streaming import ingest as G

TODAY = date(2000, 3, 15)
NOW = datetime(2001, 8, 1, 12, 0, 0)
CRAWLED = "2025-01-01 00:00:00"

QUERIES: dict = {}


def query(fn):
    """Register under the function's name; settings are made before the first use."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


def _clean_notices(spark, sf) -> DataFrame:
    """Notices as finished ledger rows."""
    n = X.notices(spark, sf).withColumns({
        "violation_behavior": T.clean_value(F.col("violation_behavior")),
        "entity_name": F.coalesce("entity_name", F.lit("")),
    })
    return R.fill_decision_number(n)


def _stored(df: DataFrame) -> DataFrame:
    """What a master of the end of 1998 holds."""
    return df.where(F.col("order_day") < F.lit(date(1999, 1, 1)))


def _arriving(df: DataFrame) -> DataFrame:
    """A later collection from 1997 on, overlapping the master by two years."""
    return df.where(F.col("order_day") >= F.lit(date(1997, 1, 1)))


def _details(spark, sf) -> DataFrame:
    return B.expand_multi_record(B.extract_nested(X.detail_html(spark, sf)), F.lit(CRAWLED), F.col("title"))


def _field(name: str, column: str = "fields"):
    return F.coalesce(F.try_element_at(column, F.lit(name)), F.lit(""))


# --- A: sources and sinks -------------------------------------------------------------------


@query
def a1_scan_pages(spark, sf):
    return scan_pages(spark, f"{sf}/pages.parquet").select("url", F.length("html").cast("bigint").alias("html_chars"))


@query
def a2_scan_master(spark, sf):
    root = scratch_path(spark, "master")
    R.ledger_projection(_clean_notices(spark, sf).withColumn("seq_no", F.col("ingest_pos"))).write.parquet(root)
    both = A.scan_master(spark, root).unionByName(A.scan_master(spark, f"{root}-missing"))
    return both.groupBy("category").agg(F.count("*").alias("records"), F.max("seq_no").alias("last_no"))


@query
def a3_write_report(spark, sf):
    root = scratch_path(spark, "report")
    n = _clean_notices(spark, sf)
    A.write_report(R.ledger_projection(n.withColumn("seq_no", F.col("ingest_pos"))), S.master_stats(n, 0, NOW), root)
    main = spark.read.parquet(f"{root}/main").agg(F.count("*").alias("row_count")).withColumn("part", F.lit("main"))
    stats = spark.read.parquet(f"{root}/stats").agg(F.count("*").alias("row_count")).withColumn("part", F.lit("stats"))
    return main.unionByName(stats)


@query
def a4_write_by_category(spark, sf):
    root = scratch_path(spark, "sheets")
    A.write_by_category(_clean_notices(spark, sf), root, (*fixed.CATEGORIES, "其他"))
    rows = spark.read.parquet(f"{root}/rows").groupBy("category").agg(F.max("ingest_pos").alias("last_pos"))
    return spark.read.parquet(f"{root}/counts").join(rows, "category", "left")


@query
def a5_export_text(spark, sf):
    root = scratch_path(spark, "texts")
    A.write_text(A.export_text(_clean_notices(spark, sf)), root)
    return A.read_text(spark, root).select("file_key", "body")


@query
def a6_snapshot(spark, sf):
    root = scratch_path(spark, "snapshots")
    n = _clean_notices(spark, sf).withColumn("seq_no", F.col("ingest_pos"))
    A.write_snapshot(R.ledger_projection(_stored(n)), root, datetime(2025, 1, 1))
    A.write_snapshot(R.ledger_projection(n), root, datetime(2025, 1, 2))
    return A.latest_snapshot(spark, root).groupBy("category").agg(
        F.count("*").alias("records"), F.min("seq_no").alias("first_no")
    )


@query
def a7_labelled_lines(spark, sf):
    return A.labelled_lines_to_row(X.labelled_lines(spark, sf)).select(
        "file",
        F.col("行政处罚决定书文号").alias("doc_no"),
        F.col("被处罚当事人").alias("entity"),
        F.col("作出处罚决定的机关名称").alias("authority"),
        F.col("作出处罚决定的日期").alias("day"),
    )


@query
def a8_preview(spark, sf):
    return A.preview(R.ledger_projection(R.renumber(_clean_notices(spark, sf)))).select("seq_no", "detail_url")


# --- B: pages to records --------------------------------------------------------------------


@query
def b1_extract_links(spark, sf):
    return L.extract_links(X.list_html(spark, sf), X.SITE).select("category", "page", "title", "detail_url")


@query
def b1_extract_links_pages(spark, sf):
    pages = widen(scan_pages(spark, f"{sf}/pages.parquet"))
    chosen = L.extract_links(pages, X.SITE, keywords=("the", "un"), href_part="/d")
    return chosen.groupBy("url").agg(F.count("*").alias("links"), F.max("detail_url").alias("last_url"))


@query
def b2_resolve_url(spark, sf):
    return X.notices(spark, sf).select("ingest_pos", L.resolve_url(F.col("detail_url"), X.SITE).alias("detail_url"))


@query
def b3_page_dates(spark, sf):
    days = read_parts(X.list_html(spark, sf), "days")
    return days.select("category", "page", F.array_join(L.page_dates(F.col("days")), ",").alias("dates"))


@query
def b4_link_publish_date(spark, sf):
    return L.extract_links(X.list_html(spark, sf), X.SITE).select("detail_url", "publish_date")


@query
def b5_extract_publish_time(spark, sf):
    return L.extract_publish_time(X.detail_html(spark, sf)).select("ingest_pos", "publish_time")


@query
def b6_select_table(spark, sf):
    pages = read_parts(X.detail_html(spark, sf), "tables", fields=("table_no", "marked", "classes"))
    first = F.get(B.select_table(F.col("tables")), F.lit(0))
    single = B.select_single_table(F.col("tables"))
    return pages.select(
        "ingest_pos", F.size("tables").cast("bigint").alias("tables"),
        first["table_no"].cast("bigint").alias("table_no"), single["classes"].alias("classes"),
    )


@query
def b7_explode_cells(spark, sf):
    return B.explode_cells(X.detail_html(spark, sf)).select(
        "ingest_pos", *[F.col(c).cast("bigint").alias(c) for c in ("table_no", "row_no", "cell_no", "rowspan", "colspan")],
        "text",
    )


def _chosen_table(spark, sf, *fields: str) -> DataFrame:
    pages = read_parts(X.detail_html(spark, sf), "tables", candidates_only=True, fields=fields)
    return pages.select("ingest_pos", F.get("tables", F.lit(0)).alias("table"))


@query
def b8_classify_layout(spark, sf):
    pages = read_parts(X.detail_html(spark, sf), "tables", fields=("rows",))
    return pages.select("ingest_pos", F.posexplode("tables").alias("at", "table")).select(
        "ingest_pos", (F.col("at") + 1).cast("bigint").alias("table_no"), B.classify_layout("table").alias("layout")
    )


@query
def b9_map_header(spark, sf):
    table = F.col("table")
    labels = F.transform(table["rows"], lambda r: F.get(r, F.lit(0)))
    heads = F.when(B.classify_layout("table") == "key_value", labels).otherwise(B.header(table))
    named = _chosen_table(spark, sf, "rows").select(F.explode(heads).alias("header"))
    counted = named.groupBy("header").agg(F.count("*").alias("cells"))
    return counted.select(
        "header", "cells",
        B.map_header("header").alias("field"),
        B.map_header("header", compat=True).alias("compat_field"),
        B.map_label("header").alias("label_field"),
    )


def _record_columns(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep,
        _field(fixed.SEQ).alias("seq"), _field(fixed.ENTITY).alias("entity"), _field(fixed.VIOLATION).alias("violation"),
        _field(fixed.CONTENT).alias("content"), _field(fixed.AUTHORITY).alias("authority"),
    )


@query
def b10_parse_horizontal_single(spark, sf):
    horizontal = B.classify_layout("table") == "horizontal"
    tables = _chosen_table(spark, sf, "rows", "grid").where(horizontal & (F.size("table.rows") == 2))
    rows = B.with_horizontal(tables, "table", "records").select("ingest_pos", F.explode_outer("records").alias("r"))
    return _record_columns(rows.select("ingest_pos", F.col("r.fields").alias("fields")), "ingest_pos")


@query
def b11_parse_horizontal_multi(spark, sf):
    tables = read_parts(X.multi_html(spark, sf), "tables", fields=("rows", "grid")).select("group_no", F.get("tables", F.lit(0)).alias("table"))
    rows = B.with_horizontal(tables, "table", "records").select(
        "group_no", F.size("records").cast("bigint").alias("record_total"), F.explode_outer("records").alias("r")
    )
    flat = rows.select("group_no", "record_total", F.col("r.fields").alias("fields"))
    return flat.select(
        "group_no", "record_total",
        _field(fixed.ROW_IN_NOTICE).alias("row_in_notice"), _field(fixed.IS_MULTI).alias("is_multi"),
        _field(fixed.SOURCE_SEQ).alias("source_seq"), _field(fixed.ENTITY).alias("entity"),
        _field(fixed.CONTENT).alias("content"), _field(fixed.AUTHORITY).alias("authority"), _field(fixed.BASIS).alias("basis"),
    )


@query
def b12_has_merged_cells(spark, sf):
    return _chosen_table(spark, sf, "spans").select("ingest_pos", B.has_merged_cells(F.col("table")).alias("merged"))


@query
def b13_expand_spans(spark, sf):
    grids = _chosen_table(spark, sf, "grid").select("ingest_pos", F.posexplode("table.grid").alias("y", "row"))
    return grids.select("ingest_pos", "y", F.posexplode("row").alias("x", "text")).select(
        "ingest_pos", (F.col("y") + 1).cast("bigint").alias("row_no"), (F.col("x") + 1).cast("bigint").alias("col_no"), "text"
    )


@query
def b14_parse_key_value(spark, sf):
    tables = _chosen_table(spark, sf, "rows").where(B.classify_layout("table") == "key_value")
    flat = tables.select("ingest_pos", B.parse_key_value("table").alias("fields"))
    return _record_columns(flat, "ingest_pos", "fields").select(
        "ingest_pos", "entity", "violation", "content", "authority",
        _field(fixed.BASIS).alias("basis"), _field(fixed.DOC_NO).alias("doc_no"),
        T.strict_day(_field(fixed.DECISION_DATE)).alias("decided"),
    )


@query
def b15_extract_basis(spark, sf):
    n = X.notices(spark, sf).withColumn("entity_or_x", T.first_nonempty(F.col("entity_name"), F.lit("某机构")))
    return n.withColumn("finding", X.finding_text()).select("ingest_pos", P.extract_basis("finding").alias("basis"))


@query
def b16_extract_content(spark, sf):
    n = spread(X.notices(spark, sf), X.table(spark, sf, "orders")).withColumn("entity_or_x", T.first_nonempty(F.col("entity_name"), F.lit("某机构")))
    return n.withColumn("finding", X.penalty_text()).select("ingest_pos", P.extract_content("finding").alias("content"))


@query
def b17_containment_dedup(spark, sf):
    k = F.col("ingest_pos").cast("string")
    sentences = F.array(
        F.concat(F.lit("罚款甲"), k), F.concat(F.lit("警告乙"), k, F.lit("。")), F.concat(F.lit("对丙罚款甲"), k, F.lit("，")),
        F.concat(F.lit("乙"), k), F.lit("警告"), F.concat(F.lit("；警告乙"), k),
    )
    n = X.notices(spark, sf).withColumn("sentences", sentences)
    return n.select("ingest_pos", F.array_join(P.containment_dedup("sentences"), "|").alias("kept"))


@query
def b18_overlay_fallbacks(spark, sf):
    n = X.notices(spark, sf)
    table = F.create_map(F.lit(fixed.ENTITY), F.coalesce("entity_name", F.lit("")), F.lit(fixed.CONTENT), F.col("punishment_content"))
    table = F.when(F.col("punishment_basis") != "", F.map_concat(table, F.create_map(F.lit(fixed.BASIS), F.col("punishment_basis")))).otherwise(table)
    merged = B.overlay_content(B.overlay_basis(table, F.col("title")), F.col("decision_authority"))
    flat = n.select("ingest_pos", merged.alias("fields"))
    return flat.select("ingest_pos", _field(fixed.BASIS).alias("basis"), _field(fixed.CONTENT).alias("content"))


@query
def b19_keyword_table(spark, sf):
    return B.keyword_table(X.detail_html(spark, sf), "警告").select(
        "ingest_pos", F.col("row_no").cast("bigint").alias("row_no"), "line"
    )


@query
def b20_expand_multi_record(spark, sf):
    d = _details(spark, sf)
    return _record_columns(d, "ingest_pos", "record_no", "record_total", "fields").select(
        "ingest_pos", F.col("record_no").cast("bigint").alias("record_no"),
        F.col("record_total").cast("bigint").alias("record_total"), "entity", "violation", "content", "authority",
        _field(fixed.TITLE).alias("title"), _field(fixed.PUBLISH_TIME).alias("publish_time"),
    )


@query
def b21_join_list_detail(spark, sf):
    items = X.list_items(spark, sf).withColumn("detail_url", L.resolve_url(F.col("detail_url"), X.SITE))
    joined = B.join_list_detail(items, _details(spark, sf))
    return joined.select(
        "url", "category", F.col("page").cast("bigint").alias("page"), F.col("record_no").cast("bigint").alias("record_no"),
        _field(fixed.ENTITY).alias("entity"), _field("publish_date").alias("listed_on"), _field(fixed.CRAWL_TIME).alias("crawl_time"),
    )


# --- C: selection ---------------------------------------------------------------------------


@query
def c1_resolve_categories(spark, sf):
    kept = C.filter_categories(X.notices(spark, sf), "zhongju, 3 ,unknown")
    return kept.groupBy("category").agg(F.count("*").alias("records"))


@query
def c2_page_cap(spark, sf):
    return C.page_cap(X.list_items(spark, sf), 3).select("category", "ingest_pos", F.col("page").cast("bigint").alias("page"))


@query
def c3_record_cap(spark, sf):
    return C.record_cap(X.list_items(spark, sf), 25).select("category", "ingest_pos")


@query
def c4_filter_year(spark, sf):
    return C.filter_year(X.notices(spark, sf), 1996).select("ingest_pos", "publish_time")


@query
def c5_filter_month(spark, sf):
    return C.filter_month(X.notices(spark, sf), 1996, 12).select("ingest_pos", "publish_time")


@query
def c6_filter_last_days(spark, sf):
    return C.filter_last_days(X.notices(spark, sf), 400, NOW).select("ingest_pos", "publish_time")


@query
def c7_list_date_window(spark, sf):
    start, end = C.month_window(1996, 12)
    return C.list_date_window(X.list_items(spark, sf), start, end).select("category", "ingest_pos", "publish_date")


@query
def c8_take_while_recent(spark, sf):
    return C.take_while_recent(X.list_items(spark, sf), date(2001, 6, 1)).select("category", "ingest_pos", "publish_date")


@query
def c9_run_window(spark, sf):
    items = X.notices(spark, sf).withColumnRenamed("order_day", "publish_date")
    return C.tag_run_modes(items, TODAY).groupBy("mode", "category").agg(F.count("*").alias("records"))


# --- D: scalar functions --------------------------------------------------------------------


@query
def d1_normalize_fields(spark, sf):
    raw = X.raw_records(spark, sf).withColumn("fields", R.normalize_fields(F.col("fields")))
    return raw.select(
        "ingest_pos", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("names"), _field(fixed.ENTITY).alias("entity")
    )


@query
def d2_clean_text(spark, sf):
    docs = widen(X.table(spark, sf, "documents"))
    clean = T.clean_text(F.concat(F.lit("　"), F.col("text"), F.lit(" &nbsp;&amp;lt;\t")))
    return docs.select("doc_id", clean.alias("clean")).select("doc_id", F.length("clean").cast("bigint").alias("chars"), F.md5("clean").alias("md5"))


@query
def d3_clean_value(spark, sf):
    return X.notices(spark, sf).select("ingest_pos", T.clean_value(F.col("violation_behavior")).alias("violation"))


@query
def d4_standardize_amount(spark, sf):
    c = F.col("punishment_content")
    return X.notices(spark, sf).select(
        "ingest_pos", T.standardize_amount(c).alias("amount_text"), T.amount_yuan(c).cast("string").alias("amount_yuan")
    )


@query
def d5_format_date(spark, sf):
    return X.notices(spark, sf).select("ingest_pos", T.format_date(F.col("publish_time")).alias("day"))


@query
def d6_parse_time(spark, sf):
    return X.notices(spark, sf).select(
        "ingest_pos", F.date_format(T.parse_time(F.col("publish_time")), "yyyy-MM-dd HH:mm:ss").alias("published")
    )


@query
def d7_decision_number(spark, sf):
    return X.notices(spark, sf).select("ingest_pos", T.decision_number(F.col("title")).alias("doc_no"))


@query
def d8_seq_sort_key(spark, sf):
    k = F.col("ingest_pos")
    seq = F.when(k % 3 == 0, F.concat((k % 50).cast("string"), F.lit("-"), (k % 7).cast("string"))).otherwise(F.col("source_seq"))
    key = T.seq_sort_key(seq)
    return X.notices(spark, sf).select("ingest_pos", key["major"].alias("major"), key["minor"].alias("minor"))


@query
def d9_first_nonempty(spark, sf):
    return X.notices(spark, sf).select(
        "ingest_pos", T.first_nonempty(F.col("publish_time"), F.col("entity_name"), F.col("decision_document_number")).alias("first")
    )


@query
def d10_fill_decision_number(spark, sf):
    n = X.notices(spark, sf)
    given = F.when(F.col("ingest_pos") % 2 == 0, F.lit("已有")).otherwise(F.lit(""))
    return R.fill_decision_number(n.withColumn("decision_document_number", given)).select("ingest_pos", "decision_document_number")


@query
def d_clean_records(spark, sf):
    cleaned = R.clean_records(X.raw_records(spark, sf))
    return cleaned.select(
        "ingest_pos", _field("罚款金额").alias("amount_text"), F.col("amount_yuan").cast("string").alias("amount_yuan"),
        _field(fixed.VIOLATION).alias("violation"), _field(fixed.CONTENT).alias("content"),
    )


# --- E: reshaping, order, dedup, upsert -----------------------------------------------------


@query
def e1_process_category(spark, sf):
    rows = R.process_category(X.nested_records(spark, sf))
    return rows.select(
        "ingest_pos", "position", F.col("part").cast("bigint").alias("part"), _field(fixed.SEQ).alias("seq"),
        _field(fixed.ENTITY).alias("entity"), _field(fixed.TITLE).alias("title"), _field(fixed.CATEGORY).alias("category"),
    )


@query
def e2_union_categories(spark, sf):
    n = X.notices(spark, sf)
    parts = [n.where(F.col("category") == c).drop("source_seq" if i else "title") for i, c in enumerate(fixed.CATEGORIES)]
    return R.union_categories(*parts).groupBy("category").agg(
        F.count("*").alias("records"), F.count("title").alias("titles"), F.count("source_seq").alias("numbers")
    )


@query
def e3_standardize_columns(spark, sf):
    n = X.notices(spark, sf).select(
        "ingest_pos", F.col("title").alias(fixed.TITLE), F.col("entity_name").alias(fixed.ENTITY), F.col("category").alias(fixed.CATEGORY)
    )
    out = R.standardize_columns(n)
    return out.select(
        "ingest_pos", F.col(fixed.ENTITY).alias("entity"), F.col(fixed.VIOLATION).alias("violation"),
        F.lit(",".join(out.columns)).alias("layout"),
    )


@query
def e4_canonicalize(spark, sf):
    rows = R.canonicalize(R.clean_records(X.raw_records(spark, sf)), "ingest_pos")
    flat = R.ledger_projection(rows.withColumn("seq_no", F.col("ingest_pos")))
    return flat.withColumn("layout", F.lit(",".join(flat.columns)))


def _mixed_seq() -> Column:
    """Plain, two-part and blank sequence numbers."""
    k = F.col("ingest_pos")
    return F.when(k % 5 == 0, F.concat((k / 5).cast("bigint").cast("string"), F.lit("-1"))).otherwise(F.col("source_seq"))


@query
def e5_sort_by_time(spark, sf):
    n = R.with_time_keys(X.notices(spark, sf).select("ingest_pos", "publish_time", "crawl_time"))
    return R.number_by_counts(n, ["ingest_pos"], name="place", newest=["_published", "_crawled"]).select("place", "ingest_pos")


@query
def e6_sort_by_category_seq(spark, sf):
    n = X.notices(spark, sf).select("ingest_pos", "category", _mixed_seq().alias("source_seq"))
    placed = R.number_rows(R.with_category_seq_keys(n), R.category_seq_order(), name="place")
    return placed.select("ingest_pos", "category", "source_seq", "place")


@query
def e7_sort_by_seq(spark, sf):
    n = X.notices(spark, sf).select("ingest_pos", _mixed_seq().alias("source_seq"))
    return R.number_rows(R.with_seq_keys(n), R.seq_order(), name="place").select("ingest_pos", "source_seq", "place")


@query
def e8_renumber(spark, sf):
    return R.renumber(_clean_notices(spark, sf), both_times=True).select("seq_no", "ingest_pos")


@query
def e9_dedup_business_key(spark, sf):
    return M.dedup(_clean_notices(spark, sf)).select("ingest_pos", "entity_name", "decision_document_number", "decision_authority")


@query
def e10_dedup_fallback(spark, sf):
    n = _clean_notices(spark, sf).drop("decision_document_number", "decision_authority")
    return M.dedup(n).select("ingest_pos", "entity_name", "violation_behavior", "punishment_content")


@query
def e11_merge_new(spark, sf):
    n = X.notices(spark, sf).select("ingest_pos", "source_seq", "order_day")
    old = _stored(n).withColumn("side", F.lit("old"))
    new = _arriving(n).withColumn("side", F.lit("new"))
    return M.merge_new(old, new, "source_seq").drop("order_day")


@query
def e12_upsert_master(spark, sf):
    root = scratch_path(spark, "master")
    for side in (_stored, _arriving):
        K.append(spark, root, side(_clean_notices(spark, sf)), both_times=True)
    return K.read(spark, root)


@query
def e13_upsert_counts(spark, sf):
    return M.upsert_counts(_stored(_clean_notices(spark, sf)), _arriving(_clean_notices(spark, sf)))


@query
def e12_full_upsert(spark, sf):
    return M.upsert_master(_stored(_clean_notices(spark, sf)), _arriving(_clean_notices(spark, sf)))


# --- F: aggregates --------------------------------------------------------------------------


@query
def f1_summary_by_category(spark, sf):
    return S.summary_by_category(X.notices(spark, sf), (*fixed.CATEGORIES, "其他")).drop("position")


@query
def f2_master_stats(spark, sf):
    return S.master_stats(_clean_notices(spark, sf), 42, NOW).withColumns({
        "rank": F.col("rank").cast("bigint"), "pct": F.col("pct").cast("string"),
    })


@query
def f3_quality_report(spark, sf):
    return S.quality_report(X.raw_records(spark, sf))


@query
def f4_quality_issues(spark, sf):
    return S.quality_issues(S.quality_report(X.raw_records(spark, sf)))


@query
def f5_kpis(spark, sf):
    return S.kpis(X.notices(spark, sf))


@query
def f6_category_distribution(spark, sf):
    return S.category_distribution(X.notices(spark, sf)).withColumn("pct", F.col("pct").cast("string"))


@query
def f7_daily_trend(spark, sf):
    return S.daily_trend(X.notices(spark, sf))


@query
def f8_records_per_notice(spark, sf):
    return S.records_per_notice(_details(spark, sf).withColumn("detail_url", F.col("url")))


# --- G: streams and run logs ----------------------------------------------------------------


def _stream_table(spark, sf, name: str) -> DataFrame:
    """The table as a file stream, spread over the cores where its files are too few."""
    at_rest = X.table(spark, sf, name)
    stream = spark.readStream.schema(at_rest.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    cores = spark.sparkContext.defaultParallelism
    return stream.repartition(cores) if at_rest.rdd.getNumPartitions() < cores else stream


def _arriving_files(spark, sf, n: int) -> tuple[DataFrame, DataFrame]:
    """The orders as a stream of ``n`` files, one a batch, in the order of their keys; and the last of them at rest."""
    source = scratch_path(spark, "orders")
    orders = X.table(spark, sf, "orders")
    top = orders.agg(F.max("o_orderkey").alias("k")).first().k or 0
    for i in range(n):
        part = orders.where((F.col("o_orderkey") >= (top + 1) * i // n) & (F.col("o_orderkey") < (top + 1) * (i + 1) // n))
        part.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(source), part


@query
def g1_incremental_ingest(spark, sf):
    """Five files, one a batch, merged after every second batch; the last batch comes twice."""
    root = scratch_path(spark, "ledger")
    stream, last = _arriving_files(spark, sf, 5)
    n = R.fill_decision_number(X.notices(spark, sf, orders=stream))
    G.start_ingest(n, root, scratch_path(spark, "checkpoint"), compact_every=2, both_times=True).awaitTermination()
    again = X.notices(spark, sf, orders=last)
    G.append_batch(R.fill_decision_number(again), 4, root)
    return G.read_ingested(spark, root).select("seq_no", "detail_url", "decision_document_number")


def _drain(stream: DataFrame, spark, mode: str) -> DataFrame:
    root = scratch_path(spark, "drained")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    (
        stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    )
    return spark.read.parquet(root)


@query
def g2_stream_dedup(spark, sf):
    events = _stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = G.stream_dedup(events.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")
    return _drain(kept, spark, "append").select("user_id", "event_type")


@query
def g2_stream_late_rows(spark, sf):
    """Three files of six years each, under a watermark of a year: late rows reach the ledger too."""
    root = scratch_path(spark, "ledger")
    n = X.notices(spark, sf, orders=_arriving_files(spark, sf, 3)[0]).withColumn("ordered", F.col("order_day").cast("timestamp"))
    G.start_deduplicated(R.fill_decision_number(n), root, scratch_path(spark, "checkpoint"), "ordered", "365 days").awaitTermination()
    return G.read_ingested(spark, root).select("seq_no", "detail_url", "decision_document_number")


@query
def g3_daily_trend_stream(spark, sf):
    events = _stream_table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    per_day = _drain(G.daily_trend_stream(events, "ts", "1 day"), spark, "update")
    return per_day.groupBy("day").agg(F.max_by("records", "batch_id").alias("records"))


@query
def g4_run_log_extract(spark, sf):
    return G.run_log_extract(X.log_lines(spark, sf))


@query
def g5_log_tail(spark, sf):
    return G.log_tail(X.log_lines(spark, sf), 250).select("line_no", "level", "message")


# --- whole runs -----------------------------------------------------------------------------


@query
def run_pages_to_ledger(spark, sf):
    """List and detail pages to the finished ledger, as one monthly run does."""
    return jobs.pages_to_ledger(
        X.list_html(spark, sf), X.detail_html(spark, sf).select("url", "html"), X.SITE, "monthly", date(2001, 7, 10), CRAWLED
    ).select("seq_no", "title", "entity_name", "punishment_content", "decision_document_number", "category", "detail_url")


@query
def run_analysis(spark, sf):
    return jobs.analysis(_clean_notices(spark, sf))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, deduplicate, order and number the notices."""
    prepare(spark)
    return R.ledger_projection(R.renumber(M.dedup(_clean_notices(spark, sf_dir))))
