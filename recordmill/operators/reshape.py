"""Record maps to ledger rows, ordering and row numbers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions import text as T
from recordmill.session import stage

# What a row carries beside the twelve ledger columns, and its types.
ADDED = {"decision_date": "date", "amount_yuan": "decimal(18,2)", "extras": "map<string,string>"}

_SLOT_BITS = 33  # monotonically_increasing_id: partition above, row below
PLACE_BITS = 16  # rows of one time are numbered in ranges of so many positions
RANGE_BITS = 10  # and without a time so many ranges make one step of the prefix sums


# --- field maps -----------------------------------------------------------------------------


def normalize_fields(fields: Column) -> Column:
    """Accepted spellings become canonical names; other keys pass; a later key wins."""
    other = {alias: name for alias, name in fixed.FIELD_ALIASES.items() if alias != name}
    renames = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])
    # One hashed look tells most names from aliases; the map is searched one by one.
    return F.transform_keys(fields, lambda k, _: F.when(k.isin(*other), F.try_element_at(renames, k)).otherwise(k))


def clean_fields(fields: Column) -> Column:
    """Canonical names, clean values, and amount fields in one form."""
    def value(key, raw):
        clean = F.when(raw.rlike(T.BLANK), T.clean_value(raw)).otherwise(raw)
        is_amount = key.isin(*fixed.AMOUNT_FIELDS) & clean.contains("元")
        return F.when(is_amount, _once(clean, T.standardize_amount)).otherwise(clean)

    return F.transform_values(normalize_fields(fields), value)


def exact_amount(fields: Column) -> Column:
    """The amount of a record as collected; its cleaned text is rounded to tenths of 万元 and splits at thousands separators."""
    def text(named):
        return T.first_nonempty(*[T.clean_value(F.try_element_at(named, F.lit(f))) for f in fixed.AMOUNT_FIELDS])

    return _once(_once(normalize_fields(fields), text), lambda t: F.when(t.contains("元"), T.amount_yuan(t)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used: expressions inside a lambda share no work."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_records(records: DataFrame) -> DataFrame:
    """Raw record maps (column ``fields``) cleaned in place, with a typed amount beside them."""
    cleaned = records.withColumn("fields", clean_fields(F.col("fields")))
    raw_amount = T.first_nonempty(*[F.try_element_at("fields", F.lit(f)) for f in fixed.AMOUNT_FIELDS])
    return cleaned.withColumn("amount_yuan", T.amount_yuan(raw_amount))


def process_category(records: DataFrame) -> DataFrame:
    """Flatten nested records: additional rows 'i-1', 'i-2', ... then their main row.

    Input ``(ingest_pos, category, fields, additional)``; i is the 1-based position of the main
    record in its category, also the sequence number where a record brings none. Output adds
    ``position``, ``part`` (rank inside the notice, main row last) and ``amount_yuan``.
    """
    placed = number_rows(records, [F.col("ingest_pos")], name="position", by=["category"])
    main = clean_fields(F.col("fields"))
    i = F.col("position").cast("string")
    own_seq = T.first_nonempty(F.try_element_at("main", F.lit(fixed.SEQ)), i)

    def extra(item, j):
        cleaned = clean_fields(item)
        inherited = F.map_filter(
            F.col("main"), lambda k, _: k.isin(fixed.TITLE, fixed.DETAIL_URL, fixed.CRAWL_TIME)
        )
        number = F.concat(i, F.lit("-"), (j + 1).cast("string"))
        return row(F.map_concat(inherited, cleaned, F.create_map(F.lit(fixed.SEQ), number)), item)

    def row(cleaned, raw):
        return F.struct(cleaned.alias("fields"), exact_amount(raw).alias("amount_yuan"))

    rows = F.concat(
        F.transform(F.coalesce("additional", F.array().cast("array<map<string,string>>")), extra),
        F.array(row(F.map_concat("main", F.create_map(F.lit(fixed.SEQ), own_seq)), F.col("fields"))),
    )
    return (
        placed.withColumn("main", main)
        .select("ingest_pos", "category", "position", F.posexplode(rows).alias("part", "row"))
        .select("ingest_pos", "category", "position", "part", "row.fields", "row.amount_yuan")
        .withColumn("fields", F.map_concat("fields", F.create_map(F.lit(fixed.CATEGORY), F.col("category"))))
    )


def canonicalize(records: DataFrame, *keep: str) -> DataFrame:
    """Record maps to the twelve ledger columns, '' where absent, document number from the title.

    Fields outside the ledger stay in ``extras``, an unreadable decision date too; ``decision_date``, ``amount_yuan`` (as given, or
    else from the fields) and ``source_seq`` are kept.
    """
    def field(*names: str) -> Column:
        return T.first_nonempty(*[F.try_element_at("fields", F.lit(n)) for n in names])

    more = {fixed.DETAIL_URL: ("detail_url",), fixed.TITLE: ("title",)}
    columns = [
        field(name, *more.get(name, ())).alias("source_seq" if name == fixed.SEQ else column)
        for name, column in fixed.LEDGER_FIELDS.items()
    ]
    known = [*fixed.LEDGER_FIELDS, "detail_url", "title", fixed.DECISION_DATE]
    extras = F.map_filter(
        "fields", lambda k, v: ~k.isin(known) | (k == fixed.DECISION_DATE) & (v != "") & T.strict_day(v).isNull())
    amount = F.col("amount_yuan") if "amount_yuan" in records.columns else exact_amount(F.col("fields"))
    flat = records.select(
        *keep, *columns,
        T.strict_day(field(fixed.DECISION_DATE)).alias("decision_date"),
        amount.alias("amount_yuan"),
        extras.alias("extras"),
    )
    return fill_decision_number(flat)


def fill_decision_number(df: DataFrame) -> DataFrame:
    """Document number from the title where the column is blank."""
    given = F.col("decision_document_number")
    number = F.when(T.is_blank(given), F.coalesce(T.decision_number(F.col("title")), F.lit(""))).otherwise(given)
    return df.withColumn("decision_document_number", number)


def ledger_projection(df: DataFrame, added: bool = False) -> DataFrame:
    """Exactly the twelve ledger columns in order; absent or null text becomes ''. With ``added``, those of ``ADDED`` that are there follow."""
    def column(name: str) -> Column:
        if name not in df.columns:
            return F.lit("").alias(name)
        if name == "seq_no":
            return F.col(name)
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    more = [c for c in ADDED if added and c in df.columns]
    return df.select(*[column(c) for c in fixed.LEDGER_FIELDS.values()], *more)


def standardize_columns(df: DataFrame) -> DataFrame:
    """The older layout: its eleven columns first ('' if missing), any others after."""
    first = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in fixed.STANDARD_FIELDS]
    return df.select(*first, *[c for c in df.columns if c not in fixed.STANDARD_FIELDS])


def union_categories(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- order ----------------------------------------------------------------------------------


def with_time_key(df: DataFrame) -> DataFrame:
    """``_when``, the parsed time that orders the table: the publish time, or the crawl time where no row at all has a publish time.

    One column is chosen for the whole table; whether any row has a publish time is known from the first that does.
    """
    published = not df.where(~T.is_blank(F.col("publish_time"))).limit(1).isEmpty()
    return df.withColumn("_when", T.parse_time(F.col("publish_time" if published else "crawl_time")))


def with_time_keys(df: DataFrame) -> DataFrame:
    """``_published`` and ``_crawled``, both parsed: for an order in which the crawl time decides where publish times are equal or unreadable."""
    return df.withColumns({"_published": T.parse_time(F.col("publish_time")), "_crawled": T.parse_time(F.col("crawl_time"))})


def first_step(times: list[str]) -> Column:
    """The day of a row in an order by ``times``, newest first: its first time's, else (far below all of those) its second one's, else null."""
    if len(times) == 1:
        return F.to_date(times[0])
    day, later = (F.unix_date(F.to_date(c)).cast("bigint") for c in times)
    return F.coalesce(day, later - F.lit(1 << 40))


def sort_by_time(df: DataFrame, *ties: str) -> DataFrame:
    """Newest first by the time that orders the table, unreadable ones last; the tie columns (by default the position) make the order total."""
    keys = [F.col(c).asc() for c in ties or ("ingest_pos",)]
    return with_time_key(df).orderBy(F.col("_when").desc_nulls_last(), *keys).drop("_when")


def category_rank(category: Column) -> Column:
    ranks = F.create_map(*[x for i, c in enumerate(fixed.CATEGORIES, 1) for x in (F.lit(c), F.lit(i))])
    return F.coalesce(F.try_element_at(ranks, category), F.lit(len(fixed.CATEGORIES) + 1))


def with_category_seq_keys(df: DataFrame) -> DataFrame:
    seq = T.strip(F.col("source_seq"))
    key = T.seq_sort_key(seq)
    return df.withColumns({
        "_category_no": category_rank(F.col("category")),
        "_major": key["major"],
        "_minor": F.when(~seq.rlike("^[0-9]+$"), key["minor"]),
    })


def category_seq_order() -> list[Column]:
    """Category rank, then n before n-1, n-2, ...; unreadable numbers last."""
    return [F.col("_category_no"), F.col("_major"), F.col("_minor").asc_nulls_first(), F.col("ingest_pos")]


def sort_by_category_seq(df: DataFrame) -> DataFrame:
    return with_category_seq_keys(df).orderBy(*category_seq_order()).drop("_category_no", "_major", "_minor")


def with_seq_keys(df: DataFrame) -> DataFrame:
    key = T.seq_sort_key(F.col("source_seq"))
    return df.withColumns({"_major": key["major"], "_minor": key["minor"]})


def seq_order() -> list[Column]:
    return [F.col("_major"), F.col("_minor"), F.col("ingest_pos")]


def sort_by_seq(df: DataFrame) -> DataFrame:
    return with_seq_keys(df).orderBy(*seq_order()).drop("_major", "_minor")


# --- row numbers ----------------------------------------------------------------------------


def number_rows(df: DataFrame, order: list[Column], name: str = "seq_no", by: list[str] | None = None) -> DataFrame:
    """Contiguous 1..n in ``order`` (per ``by`` group) without gathering rows in one task.

    Rows are range-partitioned on the whole order, so a group of any size spreads over many
    tasks, and are written once with their place. Only the run lengths, one per partition and
    group, are summed up to give each run its start. ``order`` should be total, and name plain
    columns: a sort evaluates an expression again in every comparison.
    """
    by = by or []
    keys = [*[F.col(c) for c in by], *order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    rows = stage(placed, "rows").withColumn("_run", F.shiftright("_slot", _SLOT_BITS))
    runs = rows.groupBy(*by, "_run").agg(F.min("_slot").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = stage(
        runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), "runs"
    )
    starts = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_run").alias("_r"), "_first", "_before")
    match = [F.col("_run") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    number = F.col("_slot") - F.col("_first") + F.col("_before") + 1
    return rows.join(starts, match).select(*df.columns, number.alias(name))


def number_by_counts(
    df: DataFrame, order: list[str], name: str = "seq_no", by: list[str] | None = None, newest: str | list[str] | None = None,
    place: str | None = None,
) -> DataFrame:
    """Contiguous 1..n (per ``by`` group), newest first by the time ``newest`` (or by the first and then the second of two) if given, then by
    the columns of ``order``.

    Rows are counted per cell: group, times, the columns before ``place`` and a range of 2 ** PLACE_BITS values of ``place``, a
    whole number (the first of ``order`` unless told). A cell's start comes from prefix sums over those counts, a row's rank
    from its own cell, which a group, day or null time of any size has many of. The input is computed and written once; the
    rows are hashed once by cell, and nothing is sampled or sorted as a whole. ``order`` should be total.
    """
    by = by or []
    newest = [newest] if isinstance(newest, str) else newest or []
    place = place or order[0]
    ahead = order[: order.index(place)]
    rows = stage(df, "rows").withColumn("_cell", F.shiftright(F.col(place).cast("bigint"), PLACE_BITS))
    cell = [*by, *newest, *ahead, "_cell"]
    first = first_step(newest) if newest else F.col(ahead[0]) if ahead else F.shiftright("_cell", RANGE_BITS)

    def down(c: str, newest_first: bool) -> Column:
        return F.col(c).desc_nulls_last() if newest_first else F.col(c).asc()

    def earlier(window):
        return F.coalesce(F.sum("_n").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    counts = stage(rows.groupBy(*cell).agg(F.count("*").alias("_n")).withColumn("_first", first), "counts")
    sums = counts.groupBy(*by, "_first").agg(F.sum("_n").alias("_n"))
    sums = stage(sums.withColumn("_ahead", earlier(W.partitionBy(*by).orderBy(down("_first", bool(newest))))).drop("_n"), "sums")
    inside = W.partitionBy(*by, "_first").orderBy(*[down(c, c in newest) for c in cell[len(by) :]])

    def same(keys: list[str]) -> list[Column]:
        return [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]

    def renamed(table: DataFrame, keys: list[str]) -> DataFrame:
        return table.withColumnsRenamed({c: f"_of_{c}" for c in keys})

    starts = counts.withColumn("_inside", earlier(inside)).join(renamed(sums, [*by, "_first"]), same([*by, "_first"]))
    starts = stage(starts.select(*cell, (F.col("_ahead") + F.col("_inside")).alias("_start")), "starts")
    rank = F.row_number().over(W.partitionBy(*cell).orderBy(*order[len(ahead) :]))
    numbered = rows.withColumn("_rank", rank).join(renamed(starts, cell), same(cell))
    return numbered.select(*df.columns, (F.col("_start") + F.col("_rank")).alias(name))


def renumber(df: DataFrame, *ties: str, place: str | None = None, both_times: bool = False) -> DataFrame:
    """Fresh contiguous ``seq_no`` 1..n, newest first, replacing any old numbers; ``place`` is the whole number among the ties that spreads rows of one time.

    With ``both_times`` the crawl time orders rows of one publish time, and those without a readable one.
    """
    ties = ties or ("ingest_pos",)
    whole = place or next((c for c in ties if c in ("ingest_pos", "position", "page")), ties[0])
    if both_times:
        keys = ["_published", "_crawled"]
        return number_by_counts(with_time_keys(df.drop("seq_no")), list(ties), newest=keys, place=whole).drop(*keys)
    return number_by_counts(with_time_key(stage(df.drop("seq_no"), "dated")), list(ties), newest="_when", place=whole).drop("_when")
