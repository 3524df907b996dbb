"""Notice-shaped views over the benchmark tables, so every operator has whole tables to run on.

Formulas are listed in FIXTURES.md; the oracle SQL computes the same values in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.operators.reshape import number_rows
from recordmill.session import spread, widen

SITE = "https://records.example.com"
PAGE_ROWS = 20
GROUP_ROWS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One penalty record per order, under the ledger's column names."""
    o = widen(table(spark, sf_dir, "orders")) if orders is None else orders
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    first, second, third = fixed.CATEGORIES
    number = "concat('〔', date_format(day, 'yyyy'), '〕', k % 97, '号')"
    plain, bureau = (f"concat('N', n_nationkey, '{mark}', {number})" for mark in ("金罚决字", "金监罚决字"))
    return rows.selectExpr("*", "o_orderkey AS k", "cast(o_orderdate AS timestamp) AS day", "n_name AS nation").selectExpr(
        "k AS ingest_pos",
        "CASE WHEN k % 7 = 0 THEN '' ELSE string(k) END AS source_seq",
        f"""CASE WHEN k % 10 = 9 THEN concat(nation, '行政处罚信息公示')
            WHEN k % 3 = 0 THEN concat(nation, '行政处罚信息公开表（', {plain}, '）')
            WHEN k % 3 = 1 THEN concat(nation, '行政处罚信息公开表 ', {bureau}) ELSE {plain} END AS title""",
        "CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN NULL ELSE c_name END AS entity_name",
        "concat('\u3000', replace(o_orderpriority, ' ', '\u00a0 ')) AS violation_behavior",
        "CASE WHEN k % 4 = 0 THEN '' ELSE concat('《', nation, '管理办法》第', k % 60 + 1, '条') END AS punishment_basis",
        """CASE WHEN k % 17 = 0 THEN '' WHEN k % 3 = 0 THEN concat('罚款', k % 500, '万元')
           WHEN k % 3 = 1 THEN concat('罚款', k * 37 % 99999, '元') ELSE '警告' END AS punishment_content""",
        "'' AS decision_document_number",
        "nation AS decision_authority",
        """CASE k % 5 WHEN 0 THEN date_format(day, 'yyyy-MM-dd') WHEN 1 THEN date_format(day, 'yyyy/MM/dd')
           WHEN 2 THEN date_format(day, "yyyy'年'MM'月'dd'日'") WHEN 3 THEN date_format(day, 'yyyy-MM-dd HH:mm:ss')
           ELSE '' END AS publish_time""",
        f"CASE n_regionkey % 3 WHEN 0 THEN '{first}' WHEN 1 THEN '{second}' ELSE '{third}' END AS category",
        "date_format(date_add(date(day), 1), 'yyyy-MM-dd HH:mm:ss') AS crawl_time",
        f"""concat(CASE WHEN k % 2 = 0 THEN '{SITE}' ELSE '' END, '/cn/view/pages/ItemDetail.html?docId=', k) AS detail_url""",
        "date(day) AS order_day",
    )


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices as they stand on list pages: newest first per category, PAGE_ROWS to a page."""
    n = notices(spark, sf_dir).select("ingest_pos", "category", "title", "detail_url", "order_day")
    order = [F.col("order_day").desc(), F.col("ingest_pos")]
    ranked = number_rows(n, order, name="rank", by=["category"])
    at = F.col("rank") - 1
    return ranked.select(
        "ingest_pos", "category", "title", "detail_url",
        F.col("order_day").alias("publish_date"),
        (F.floor(at / PAGE_ROWS) + 1).alias("page"),
        (at % PAGE_ROWS + 1).alias("pos"),
    )


def list_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered list page per (category, page)."""
    row = F.concat(
        F.lit('<tr><td><a href="'), F.col("detail_url"), F.lit('">'), F.col("title"), F.lit("</a></td><td>"),
        F.col("publish_date").cast("string"), F.lit("</td></tr>"),
    )
    cells = F.array_sort(F.collect_list(F.struct("pos", row.alias("tr"))))
    return (
        list_items(spark, sf_dir)
        .groupBy("category", "page")
        .agg(cells.alias("rows"))
        .select(
            F.concat(F.col("category"), F.lit("/"), F.col("page").cast("string")).alias("url"),
            "category", "page",
            F.concat(
                F.lit("<html><body><table class=\"list\"><tbody>"),
                F.array_join(F.transform("rows", lambda r: r["tr"]), "\n"),
                F.lit("</tbody></table></body></html>"),
            ).alias("html"),
        )
    )


def _tag(name: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


def _row_sql(*cells: str, attrs: dict[int, str] | None = None) -> str:
    """SQL for one table row; each cell is an SQL string expression."""
    given = attrs or {}
    tds = ", ".join(f"'<td{given.get(i, '')}>', {cell}, '</td>'" for i, cell in enumerate(cells))
    return f"concat('<tr>', {tds}, '</tr>')"


def detail_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered notice per order: k%3 picks a one-row, a two-column or a merged two-row table."""
    names = ("序号", "当事人名称", "主要违法违规行为", "行政处罚内容", "作出决定机关")
    heads = _row_sql(*[f"'<p><span>{h[:2]}</span><span>{h[2:]}</span></p>'" for h in names])
    shared = ("violation_behavior", "punishment_content", "decision_authority")
    single = f"concat({heads}, {_row_sql('string(k)', 'party', *shared)})"
    pairs = {
        "行政处罚决定书文号": "concat('N罚决字', k)", "被处罚当事人": "party", "主要违法违规事实": "violation_behavior",
        "行政处罚依据": "punishment_basis", "行政处罚决定": "punishment_content", "作出处罚决定的机关名称": "decision_authority",
        "作出处罚决定的日期": """date_format(order_day, "yyyy'年'M'月'd'日'")""",
    }
    keyed = f"concat({', '.join(_row_sql(repr(label), value) for label, value in pairs.items())})"
    spans = dict.fromkeys((2, 4), ' rowspan="2"')
    second = _row_sql("'2'", "concat('乙', k)", "'警告'")
    merged = f"concat({heads}, {_row_sql(repr('1'), 'party', *shared, attrs=spans)}, {second})"
    top = """<html><head><script>var a="<td>x</td>";</script></head><body><table class="nav"><tr><td>首页</td></tr></table>"""
    time = """<div><span class="ng-binding">发布时间：', string(order_day), '</span></div><!-- <table> -->"""
    n = spread(notices(spark, sf_dir), table(spark, sf_dir, "orders")).selectExpr("*", "ingest_pos AS k", "coalesce(entity_name, '') AS party")
    return n.selectExpr(
        f"CASE WHEN startswith(detail_url, 'http') THEN detail_url ELSE concat('{SITE}', detail_url) END AS url",
        f"""concat('{top}{time}<table border="1" class="', CASE WHEN k % 2 = 0 THEN 'MsoTableGrid' ELSE 'MsoNormalTable' END,
            '"><tbody>', CASE k % 3 WHEN 0 THEN {single} WHEN 1 THEN {keyed} ELSE {merged} END,
            '</tbody></table></body></html>') AS html""",
        "ingest_pos", "category", "title",
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices as collected maps: alternative field names on odd keys, canonical ones on even."""
    odd = F.col("ingest_pos") % 2 == 1

    def field(even: str, alias: str, column: str) -> list[Column]:
        return [F.when(odd, F.lit(alias)).otherwise(F.lit(even)), F.col(column)]

    pairs = (
        field(fixed.SEQ, fixed.SEQ, "source_seq")
        + field(fixed.TITLE, "title", "title")
        + field(fixed.ENTITY, "当事人", "entity_name")
        + field(fixed.VIOLATION, "违法违规", "violation_behavior")
        + field(fixed.CONTENT, "处罚内容", "punishment_content")
        + field(fixed.AUTHORITY, "决定机关", "decision_authority")
        + field(fixed.PUBLISH_TIME, fixed.PUBLISH_TIME, "publish_time")
        + field(fixed.CRAWL_TIME, fixed.CRAWL_TIME, "crawl_time")
        + field(fixed.DETAIL_URL, "detail_url", "detail_url")
        + [F.lit("罚款金额"), F.col("punishment_content")]
    )
    return notices(spark, sf_dir).select("ingest_pos", "category", F.create_map(*pairs).alias("fields"))


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of up to three notices with neighbouring keys: the first is the main record."""
    raw = raw_records(spark, sf_dir).withColumn("group", F.floor(F.col("ingest_pos") / GROUP_ROWS))
    # Each group holds at most GROUP_ROWS keys by construction. Maps do not compare, so sort by key.
    members = F.expr(
        "array_sort(collect_list(struct(ingest_pos, category, fields)),"
        " (a, b) -> sign(a.ingest_pos - b.ingest_pos)::int)"
    )
    first = F.get("members", F.lit(0))
    rest = F.slice("members", 2, GROUP_ROWS)
    shared = [fixed.TITLE, "title", fixed.DETAIL_URL, "detail_url", fixed.CRAWL_TIME]
    return (
        raw.groupBy("group").agg(members.alias("members"))
        .select(
            first["ingest_pos"].alias("ingest_pos"),
            first["category"].alias("category"),
            first["fields"].alias("fields"),
            F.transform(
                rest, lambda m: F.map_filter(m["fields"], lambda key, _: ~key.isin(shared))
            ).alias("additional"),
        )
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run-log entries."""
    e = table(spark, sf_dir, "events")
    done = F.concat(
        F.lit("智能爬取完成，共获得 "), (F.col("event_id") % 100).cast("string"), F.lit(" 条记录")
    )
    busy = F.concat(F.lit("正在处理 "), F.col("event_type"))
    return e.select(
        F.col("event_id").alias("line_no"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("crawler").alias("logger"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
        F.when(F.col("event_id") % 10 == 0, done).otherwise(busy).alias("message"),
    )


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four label<TAB>value lines per notice; the first label comes twice."""
    n = notices(spark, sf_dir)
    lines = F.array(
        F.concat(F.lit("行政处罚决定书文号\tX"), F.col("ingest_pos").cast("string")),
        F.concat(F.lit("被处罚当事人\t\t"), F.coalesce("entity_name", F.lit(""))),
        F.concat(F.lit("作出处罚决定的机关名称 \t"), F.col("decision_authority"), F.lit(" ")),
        F.concat(F.lit("行政处罚决定书文号\tN"), F.col("ingest_pos").cast("string")),
    )
    return n.select(
        F.col("ingest_pos").cast("string").alias("file"), F.posexplode(lines).alias("line_no", "line")
    )


def multi_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per group of up to three notices: a plain table with a data row each.

    Every fifth group also has a row too short for the header.
    """
    n = notices(spark, sf_dir)
    cells = [F.col("ingest_pos").cast("string"), F.coalesce("entity_name", F.lit("")), F.col("punishment_content"),
             F.col("decision_authority"), F.col("punishment_basis")]
    row = _tag("tr", *[_tag("td", c) for c in cells])
    grouped = n.groupBy(F.floor(F.col("ingest_pos") / GROUP_ROWS).alias("group_no")).agg(
        F.array_sort(F.collect_list(F.struct("ingest_pos", row.alias("tr")))).alias("rows")
    )
    heads = _tag("tr", *[
        _tag("th", F.lit(h)) for h in ("序号", "当事人名称", "行政处罚内容", "作出处罚决定的机关名称", "行政处罚依据")
    ])
    short = F.when(F.col("group_no") % 5 == 0, F.lit("<tr><td>合计</td><td>0</td></tr>")).otherwise(F.lit(""))
    table_rows = F.array_join(F.transform("rows", lambda r: r["tr"]), "")
    return grouped.select(
        F.concat(F.lit(f"{SITE}/notice/"), F.col("group_no").cast("string")).alias("url"),
        "group_no",
        F.concat(F.lit("<table>"), heads, short, table_rows, F.lit("</table>")).alias("html"),
    )


def finding_text() -> Column:
    """A sentence with a legal basis, from a notice's columns."""
    return F.concat(
        F.lit("依据"), F.col("decision_authority"), F.lit("办法第"), (F.col("ingest_pos") % 60 + 1).cast("string"),
        F.lit("条。违反《"), F.col("entity_or_x"), F.lit("规定》。"),
    )


def penalty_text() -> Column:
    """Two penalties in one text, from a notice's columns."""
    return F.concat(
        F.lit("对"), F.col("entity_or_x"), F.lit("罚款"), (F.col("ingest_pos") % 500).cast("string"), F.lit("万元。对甲"),
        F.col("ingest_pos").cast("string"), F.lit("警告并罚款7万元。"),
    )
