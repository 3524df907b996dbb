"""Detail pages: from table cells to notice records.

A page's tables travel as one nested column, so picking, classifying and mapping them are
array expressions on that row; no step needs a shuffle. A record is a map of field names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions.penalty import any_sql, basis_sql, content_sql
from recordmill.functions.text import first_nonempty
from recordmill.operators.links import label_time, source_time
from recordmill.sources.pages import read_parts

RECORD = "struct<record_no:int,fields:map<string,string>>"
NO_FIELDS = "map<string,string>"


def explode_cells(pages: DataFrame) -> DataFrame:
    """Every table cell of every page in long form, counted from 1."""
    kept = [c for c in pages.columns if c != "html"]
    tables = read_parts(pages, "tables", fields=("table_no", "rows", "spans")).select(*kept, F.explode("tables").alias("t"))
    rows = tables.select(*kept, "t.table_no", "t.spans", F.posexplode("t.rows").alias("row_at", "cells"))
    cells = rows.select(*kept, "table_no", "spans", "row_at", F.posexplode("cells").alias("cell_at", "text"))
    here = F.get(
        F.filter("spans", lambda s: (s["row_no"] == F.col("row_at") + 1) & (s["cell_no"] == F.col("cell_at") + 1)),
        F.lit(0),
    )
    one = F.lit(1)
    return cells.withColumn("here", here).select(
        *kept, "table_no",
        (F.col("row_at") + 1).alias("row_no"),
        (F.col("cell_at") + 1).alias("cell_no"),
        "text",
        F.coalesce("here.rowspan", one).alias("rowspan"),
        F.coalesce("here.colspan", one).alias("colspan"),
    )


def header(table: Column) -> Column:
    return F.get(table["rows"], F.lit(0))


def data_rows(table: Column) -> Column:
    return F.slice(table["rows"], F.lit(2), F.greatest(F.size(table["rows"]), F.lit(1)))


def layout_sql(table: str) -> str:
    telling = f"exists(get({table}.rows, 0), h -> {any_sql('h', fixed.HORIZONTAL_HINTS)})"
    return (
        f"CASE WHEN size({table}.rows) < 2 THEN 'none'"
        f" WHEN size(get({table}.rows, 0)) >= 3 AND {telling} THEN 'horizontal' ELSE 'key_value' END"
    )


def classify_layout(table: str) -> Column:
    """'none' below two rows; 'horizontal' for three or more headers one of which is telling; else 'key_value'."""
    return F.expr(layout_sql(table))


def has_merged_cells(table: Column) -> Column:
    """Any data cell spans rows or columns."""
    return F.exists(table["spans"], lambda s: s["row_no"] > 1)


def header_sql(head: str, compat: bool = False) -> str:
    order = fixed.HEADER_ORDER_COMPAT if compat else fixed.HEADER_ORDER
    cases = " ".join(f"WHEN {any_sql(head, fixed.HEADER_WORDS[f])} THEN '{f}'" for f in order)
    return f"CASE {cases} ELSE {head} END"


def map_header(head: str, compat: bool = False) -> Column:
    """Field of a column header; an unknown header is its own field.

    By default specific headers come before the general penalty words; ``compat`` tries the
    general ones first, which files basis, number, authority and date columns under content.
    """
    return F.expr(header_sql(head, compat))


def label_sql(label: str) -> str:
    cases = []
    for field, spellings in fixed.LABELS.items():
        quoted = ", ".join(f"'{s}'" for s in spellings)
        cases.append(f"WHEN {label} IN ({quoted}) THEN '{field}'")
    for field, words, barred in fixed.LABEL_WORDS:
        but = f" AND NOT {any_sql(label, barred)}" if barred else ""
        cases.append(f"WHEN {any_sql(label, words)}{but} THEN '{field}'")
    return f"CASE {' '.join(cases)} ELSE {label} END"


def map_label(label: str) -> Column:
    """Field of a row label: exact spelling, else contained words, else the label itself."""
    return F.expr(label_sql(label))


def _fields(names: Column, values: Column) -> Column:
    """Map of names to values; of equal names the later wins. Pairs without a value are skipped."""
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("key"), v.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull()))


def _record(no: Column, fields: Column) -> Column:
    return F.struct(no.cast("int").alias("record_no"), fields.alias("fields"))


def parse_plain_rows(table: Column, names: Column) -> Column:
    """A record per data row with at least as many cells as there are headers; shorter rows are skipped."""
    width = F.size(names)
    numbered = F.transform(
        data_rows(table), lambda row, i: F.struct((i + 1).alias("no"), row.alias("cells"))
    )
    whole = F.filter(numbered, lambda r: F.size(r["cells"]) >= width)
    return F.transform(whole, lambda r: _record(r["no"], _fields(names, F.slice(r["cells"], F.lit(1), width))))


def parse_merged_rows(table: Column, names: Column) -> Column:
    """A record per grid row that names an entity; empty positions give no field."""
    numbered = F.transform(
        table["grid"],
        lambda row, i: _record(i + 1, _fields(names, F.transform(row, lambda v: F.nullif(v, F.lit(""))))),
    )
    return F.filter(
        numbered, lambda r: F.trim(F.coalesce(F.try_element_at(r["fields"], F.lit(fixed.ENTITY)), F.lit(""))) != ""
    )


def mark_places(records: Column) -> Column:
    """Rows of one notice told apart: own sequence text, row in the notice, whether there are several."""
    several = F.when(F.size(records) > 1, F.lit(fixed.YES)).otherwise(F.lit(fixed.NO))

    def place(r):
        seq = F.map_filter(r["fields"], lambda k, _: k == fixed.SEQ)
        source = F.transform_keys(seq, lambda _, __: F.lit(fixed.SOURCE_SEQ))
        marks = F.create_map(
            F.lit(fixed.ROW_IN_NOTICE), r["record_no"].cast("string"), F.lit(fixed.IS_MULTI), several
        )
        return _record(r["record_no"], F.map_concat(r["fields"], source, marks))

    return F.transform(records, place)


def with_horizontal(df: DataFrame, table: str, out: str, compat: bool = False) -> DataFrame:
    """Adds the records of a table with a header row; with several data rows they are marked.

    Each step is its own column, so headers are mapped and rows are read once per table.
    """
    t = F.col(table)
    rows = F.when(t["grid"].isNotNull(), parse_merged_rows(t, F.col("_names"))).otherwise(
        parse_plain_rows(t, F.col("_names"))
    )
    marked = F.when(F.size(t["rows"]) > 2, mark_places(F.col("_rows"))).otherwise(F.col("_rows"))
    return (
        df.withColumn("_names", F.expr(f"transform(get({table}.rows, 0), h -> {header_sql('h', compat)})"))
        .withColumn("_rows", rows).withColumn(out, marked).drop("_names", "_rows")
    )


def parse_key_value(table: str) -> Column:
    """Fields of a two-column table: first cell names, second holds; blanks skipped, the last wins."""
    filled = f"filter({table}.rows, r -> size(r) >= 2 AND get(r, 0) <> '' AND get(r, 1) <> '')"
    return F.expr(
        f"map_from_entries(transform({filled}, r -> struct({label_sql('get(r, 0)')} AS key, get(r, 1) AS value)))"
    )


def overlay_basis(fields: Column, basis: Column) -> Column:
    """A basis found in the text under the table's own fields."""
    found = F.when(basis != "", F.create_map(F.lit(fixed.BASIS), basis)).otherwise(F.create_map().cast(NO_FIELDS))
    return F.map_concat(found, fields)


def overlay_content(fields: Column, content: Column) -> Column:
    """Penalty sentences found in the text where the fields have no content of their own."""
    own = first_nonempty(F.try_element_at(fields, F.lit(fixed.CONTENT)))
    found = F.create_map(F.lit(fixed.CONTENT), F.when(own == "", content).otherwise(own))
    return F.when((own != "") | (content != ""), F.map_concat(fields, found)).otherwise(fields)


def with_records(df: DataFrame, table: str = "table", out: str = "records", compat: bool = False) -> DataFrame:
    """Adds all records of one table; the first also carries what the table's text alone tells.

    The steps are separate columns because lambdas share no work: what is used twice is
    computed once, below. Only horizontal tables have their headers mapped and rows read.
    """
    lone = F.lit(None).cast("int")
    is_kv = F.col("_layout") == "key_value"
    own_content = first_nonempty(F.try_element_at("_down", F.lit(fixed.CONTENT)))
    across = F.transform(
        F.when(F.col("_layout") == "horizontal", F.col("_across")),
        lambda r, i: F.when(i == 0, _record(r["record_no"], overlay_basis(r["fields"], F.col("_basis")))).otherwise(r),
    )
    alone = overlay_basis(F.coalesce("_down", F.create_map().cast(NO_FIELDS)), F.col("_basis"))
    single = F.filter(F.array(_record(lone, F.col("_alone"))), lambda r: F.size(F.map_keys(r["fields"])) > 0)
    return (
        with_horizontal(df.withColumn("_layout", classify_layout(table)).withColumn("_wide", F.when(F.col("_layout") == "horizontal", F.col(table))),
                        "_wide", "_across", compat)
        .withColumn("_basis", F.expr(basis_sql(f"{table}.text")))
        .withColumn("_down", F.when(is_kv, parse_key_value(table)))
        .withColumn("_content", F.when(is_kv & (own_content == ""), F.expr(content_sql(f"{table}.text"))).otherwise(F.lit("")))
        .withColumn("_alone", overlay_content(alone, F.col("_content")))
        .withColumn(out, F.when(F.size(across) > 0, across).otherwise(single))
        .drop("_across", "_layout", "_wide", "_basis", "_down", "_content", "_alone")
    )


def data_sql(table: str, compat: bool = False) -> str:
    """Whether a table gives any record; its text is searched only when its cells give none."""
    full_row = f"exists(slice({table}.rows, 2, greatest(size({table}.rows), 1)), r -> size(r) >= size(get({table}.rows, 0)))"
    is_entity = f"transform(get({table}.rows, 0), h -> {header_sql('h', compat)} = '{fixed.ENTITY}')"
    named = f"exists({table}.grid, row -> exists(zip_with(row, {is_entity}, (v, e) -> e AND trim(v) <> ''), x -> x))"
    pair = f"exists({table}.rows, r -> size(r) >= 2 AND get(r, 0) <> '' AND get(r, 1) <> '')"
    cells = (
        f"CASE {layout_sql(table)} WHEN 'horizontal' THEN CASE WHEN {table}.grid IS NULL THEN {full_row}"
        f" ELSE coalesce({named}, false) END WHEN 'key_value' THEN {pair} ELSE false END"
    )
    by_content = f"({layout_sql(table)} = 'key_value' AND {content_sql(f'{table}.text')} <> '')"
    return f"({cells} OR {basis_sql(f'{table}.text')} <> '' OR {by_content})"


def select_table(tables: Column) -> Column:
    """The tables to try, in page order: those of a marked class, or all if there is none."""
    marked = F.filter(tables, lambda t: t["marked"])
    return F.when(F.size(marked) > 0, marked).otherwise(tables)


def select_single_table(tables: Column) -> Column:
    """The one table of a page: first of the first marked class present, else the first of all."""
    def first_of(name: str) -> Column:
        return F.get(F.filter(tables, lambda t: F.array_contains(F.split(t["classes"], r"\s+"), name)), F.lit(0))

    firsts = [first_of(name) for name in fixed.TABLE_CLASSES]
    return F.coalesce(*firsts, F.get(tables, F.lit(0)))


def extract_nested(pages: DataFrame, compat: bool = False) -> DataFrame:
    """Page columns without the markup, ``publish_time`` and the ``records`` of the first table that has any.

    Pages without records keep an empty list. Filtering on ``records`` here would make the
    optimizer push the whole parse into the predicate and run it twice.
    """
    kept = [c for c in pages.columns if c != "html"]
    with_source = pages.withColumn("_source_time", source_time(F.col("html")))
    parts = read_parts(with_source, "times", "tables", candidates_only=True, fields=("table_no", "text", "rows", "grid"))
    hit = F.expr(f"CASE WHEN size(tables) = 1 THEN get(tables, 0) ELSE get(filter(tables, t -> {data_sql('t', compat)}), 0) END")
    chosen = parts.select(
        *kept,
        first_nonempty(label_time(F.col("times")), F.col("_source_time")).alias("publish_time"),
        hit.alias("table"),
    )
    return with_records(chosen, "table", "records", compat).select(
        *kept, "publish_time", F.col("table.table_no").alias("table_no"), "records"
    )


def expand_multi_record(nested: DataFrame, crawl_time: Column, title: Column) -> DataFrame:
    """One row per record of a notice: ``record_no``, ``record_total``, ``fields``.

    On the first record the page's own facts win; further ones keep their own fields and take
    the shared ones from the first where theirs are absent or empty.
    """
    base = F.create_map(
        F.lit(fixed.CRAWL_TIME), crawl_time, F.lit(fixed.DETAIL_URL), F.col("url"),
        F.lit(fixed.TITLE), title, F.lit(fixed.PUBLISH_TIME), F.col("publish_time"),
    )
    kept = [c for c in nested.columns if c not in ("records", "publish_time")]
    rows = nested.select(
        *kept, base.alias("_base"),
        F.get("records", F.lit(0))["fields"].alias("_main"),
        F.size("records").alias("record_total"),
        F.posexplode_outer("records").alias("_at", "_record"),
    ).where(F.col("_record").isNotNull())
    own = F.col("_record.fields")
    combined = F.map_concat("_base", own)
    shared = F.map_filter(
        "_main",
        lambda k, v: k.isin(*fixed.SHARED_FIELDS) & (first_nonempty(F.try_element_at(combined, k)) == ""),
    )
    fields = F.when(F.col("_at") == 0, F.map_concat(own, "_base")).otherwise(F.map_concat(combined, shared))
    return rows.select(*kept, (F.col("_at") + 1).alias("record_no"), "record_total", fields.alias("fields"))


def keyword_table(pages: DataFrame, keyword: str = fixed.TABLE_KEYWORD) -> DataFrame:
    """Rows of each page's first table that has a row with the keyword, cells joined by tabs."""
    kept = [c for c in pages.columns if c != "html"]
    lines = F.transform(
        F.col("tables"),
        lambda t: F.transform(
            t["rows"],
            lambda r: F.array_join(F.filter(r, lambda x: x != ""), "\t"),
        ),
    )
    first = F.get(F.filter(lines, lambda rows: F.exists(rows, lambda x: x.contains(keyword))), F.lit(0))
    rows = read_parts(pages, "tables", fields=("rows",)).select(*kept, F.posexplode_outer(first).alias("_at", "line"))
    return rows.where(F.col("line").isNotNull()).select(*kept, (F.col("_at") + 1).alias("row_no"), "line")


def join_list_detail(items: DataFrame, details: DataFrame) -> DataFrame:
    """List items with the records of their detail page; the record's fields win.

    Items without an address or without records drop out. An item's columns come as ``item``
    fields under the record's. Both sides are plain equi-join inputs: Spark broadcasts a small
    list, and splits an address with very many rows at run time.
    """
    listed = items.where(F.col("detail_url").isNotNull() & (F.col("detail_url") != ""))
    names = [c for c in ("title", "detail_url", "category", "page", "publish_date") if c in items.columns]
    item = F.create_map(*[x for c in names for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    left = listed.select(
        F.col("detail_url").alias("_url"), item.alias("_item"), *[c for c in ("category", "page", "pos") if c in items.columns]
    )
    right = details.select(F.col("url"), "record_no", "record_total", F.col("fields").alias("_own"))
    return left.join(right, F.col("_url") == F.col("url")).select(
        "url", *[c for c in ("category", "page", "pos") if c in items.columns], "record_no", "record_total",
        F.map_concat("_item", "_own").alias("fields"),
    )
