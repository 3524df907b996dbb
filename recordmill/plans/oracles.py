"""DuckDB SQL for the queries. Answers come from the source columns, not from the operators' rules."""

from __future__ import annotations

_BLANKS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The notices and what is known of them beforehand: clean text, real time, real number.
_N = """
n0 AS (
  SELECT o_orderkey AS k, n_name AS nation, n_nationkey AS nk, n_regionkey % 3 AS region, c_name, o_orderpriority AS violation,
    CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y') AS yr
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
n AS (
  SELECT k, nation, region, violation, day,
    CASE region WHEN 0 THEN '总局机关' WHEN 1 THEN '监管局本级' ELSE '监管分局本级' END AS category,
    CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN '' ELSE c_name END AS entity,
    CASE WHEN k % 17 = 0 THEN '' WHEN k % 3 = 0 THEN '罚款' || (k % 500) || '万元'
         WHEN k % 3 = 1 THEN '罚款' || (k * 37 % 99999) || '元' ELSE '警告' END AS content,
    CASE WHEN k % 4 = 0 THEN '' ELSE '《' || nation || '管理办法》第' || (k % 60 + 1) || '条' END AS basis,
    CASE WHEN k % 7 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS seq,
    CASE WHEN k % 10 = 9 THEN ''
         ELSE 'N' || nk || CASE WHEN k % 3 = 1 THEN '金监罚决字〔' ELSE '金罚决字〔' END || yr || '〕' || (k % 97) || '号' END AS doc_no,
    CASE k % 5 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%Y/%m/%d')
         WHEN 2 THEN strftime(day, '%Y年%m月%d日') WHEN 3 THEN strftime(day, '%Y-%m-%d') || ' 00:00:00' ELSE '' END AS publish,
    CASE WHEN k % 5 = 4 THEN NULL ELSE day END AS publish_day,
    strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') || ' 00:00:00' AS crawl,
    CASE WHEN k % 2 = 0 THEN 'https://records.example.com' ELSE '' END || '/cn/view/pages/ItemDetail.html?docId=' || k AS link,
    'https://records.example.com/cn/view/pages/ItemDetail.html?docId=' || k AS url
  FROM n0),
t AS (
  SELECT *, CASE WHEN k % 10 = 9 THEN nation || '行政处罚信息公示' WHEN k % 3 = 0 THEN nation || '行政处罚信息公开表（' || doc_no || '）'
                 WHEN k % 3 = 1 THEN nation || '行政处罚信息公开表 ' || doc_no ELSE doc_no END AS title
  FROM n)"""

_ITEMS = _N + """,
items AS (
  SELECT *, CAST(floor((rk - 1) / 20) AS BIGINT) + 1 AS page, (rk - 1) % 20 + 1 AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day DESC, k) AS rk FROM t)),
linked AS (
  SELECT *, row_number() OVER (PARTITION BY category, page ORDER BY pos) AS nth
  FROM (SELECT *, max(CAST(title LIKE '%处罚信息%' AS INT)) OVER (PARTITION BY category, page) AS told FROM items)
  WHERE told = 0 OR title LIKE '%处罚信息%')"""

# Records of the detail pages.
_RECORDS = _N + """,
rec AS (
  SELECT k, url, title, category, day, 1 AS record_no, CASE WHEN k % 3 = 2 THEN 2 ELSE 1 END AS record_total,
    CASE k % 3 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN '' ELSE '1' END AS seq,
    entity, violation, content, nation AS authority FROM t
  WHERE NOT (k % 3 = 2 AND entity = '')
  UNION ALL
  SELECT k, url, title, category, day, 2, 2, '2', '乙' || k, violation, '警告', nation FROM t WHERE k % 3 = 2 AND entity <> ''
  UNION ALL
  SELECT k, url, title, category, day, 1, 1, '2', '乙' || k, violation, '警告', nation FROM t WHERE k % 3 = 2 AND entity = ''),
rec2 AS (SELECT * REPLACE (CASE WHEN k % 3 = 2 AND entity LIKE '乙%' AND record_total = 1 THEN 1 ELSE record_total END AS record_total) FROM rec)"""

_HEADS = "['序号', '当事人名称', '主要违法违规行为', '行政处罚内容', '作出决定机关']"

_CELLS = _N + f""",
grids AS (
  SELECT k, CASE k % 3
    WHEN 0 THEN [{_HEADS}, [CAST(k AS VARCHAR), entity, violation, content, nation]]
    WHEN 1 THEN [['行政处罚决定书文号', 'N罚决字' || k], ['被处罚当事人', entity], ['主要违法违规事实', violation],
                 ['行政处罚依据', basis], ['行政处罚决定', content], ['作出处罚决定的机关名称', nation],
                 ['作出处罚决定的日期', strftime(day, '%Y年') || month(day) || '月' || day(day) || '日']]
    ELSE [{_HEADS}, ['1', entity, violation, content, nation], ['2', '乙' || k, '警告']] END AS grid FROM t),
cells AS (
  SELECT k, y AS row_no, x AS cell_no, grid[y][x] AS text
  FROM (SELECT k, grid, y, unnest(range(1, len(grid[y]) + 1)) AS x
        FROM (SELECT k, grid, unnest(range(1, len(grid) + 1)) AS y FROM grids)))"""

_OLD_NEW = _N + """,
both_sides AS (
  SELECT 0 AS source, * FROM t WHERE day < DATE '1999-01-01' UNION ALL SELECT 1, * FROM t WHERE day >= DATE '1997-01-01'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity, doc_no, nation ORDER BY source, k) AS rn FROM both_sides)"""

_LOGS = """
logs AS (
  SELECT event_id AS line_no, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    CASE WHEN event_id % 10 = 0 THEN '智能爬取完成，共获得 ' || (event_id % 100) || ' 条记录' ELSE '正在处理 ' || event_type END AS message
  FROM events)"""

_PER_CATEGORY = "SELECT category, count(*) AS records FROM t GROUP BY category"

_YUAN = """CASE WHEN content = '' OR k % 3 = 2 THEN NULL WHEN k % 3 = 0 THEN (k % 500) * 10000 ELSE k * 37 % 99999 END"""
_AMOUNT_TEXT = f"""CASE WHEN content = '' OR k % 3 = 2 THEN content WHEN k % 3 = 0 THEN '罚款' || (k % 500) || '.0万元'
  WHEN {_YUAN} >= 10000 THEN '罚款' || printf('%.1f', {_YUAN} / 10000.0::DOUBLE) || '万元' ELSE '罚款' || ({_YUAN}) || '.0元' END"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


ORACLES: dict[str, str] = {
    "a1_scan_pages": "SELECT url, length(html) AS html_chars FROM pages",
    "a2_scan_master": _with(_N, "SELECT category, count(*) AS records, max(k) AS last_no FROM t GROUP BY category"),
    "a3_write_report": _with(_N, """
        SELECT 'main' AS part, count(*) AS row_count FROM t
        UNION ALL SELECT 'stats', count(DISTINCT category) + 3 FROM t"""),
    "a4_write_by_category": _with(_N, """
        SELECT c AS category, count(k) AS records, max(k) AS last_pos
        FROM (SELECT unnest(['总局机关', '监管局本级', '监管分局本级', '其他']) AS c)
        LEFT JOIN t ON t.category = c GROUP BY c"""),
    "a5_export_text": _with(_N, """
        SELECT title AS file_key,
          '序号' || chr(9) || seq || chr(10) || '当事人名称' || chr(9) || entity || chr(10) ||
          '主要违法违规行为' || chr(9) || violation || chr(10) || '行政处罚依据' || chr(9) || basis || chr(10) ||
          '行政处罚内容' || chr(9) || content || chr(10) || '作出决定机关' || chr(9) || nation || chr(10) ||
          '类别' || chr(9) || category || chr(10) || '抓取时间' || chr(9) || crawl || chr(10) ||
          '详情链接' || chr(9) || link || chr(10) AS body
        FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY region DESC, k DESC) AS rn FROM t) WHERE rn = 1"""),
    "a6_snapshot": _with(_N, """
        SELECT category, count(*) AS records, min(k) AS first_no FROM t GROUP BY category"""),
    "a7_labelled_lines": _with(_N, """
        SELECT CAST(k AS VARCHAR) AS file, 'N' || k AS doc_no, entity, nation AS authority, '' AS day FROM t"""),
    "a8_preview": _with(_N, """
        SELECT row_number() OVER (ORDER BY publish_day DESC NULLS LAST, k) AS seq_no, link AS detail_url
        FROM t ORDER BY seq_no LIMIT 5"""),

    "b1_extract_links": _with(_ITEMS, "SELECT category, page, title, url AS detail_url FROM linked"),
    "b1_extract_links_pages": r"""
        WITH a AS (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]+)</a>', 1)) AS href,
                          unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]+)</a>', 2)) AS txt FROM pages),
        b AS (SELECT *, contains(txt, 'the') OR contains(txt, 'un') AS by_text, contains(href, '/d') AS by_href FROM a),
        c AS (SELECT *, bool_or(by_text) OVER (PARTITION BY url) AS any_text FROM b)
        SELECT url, count(*) AS links,
          max(CASE WHEN href LIKE 'http%' THEN href ELSE 'https://records.example.com' || href END) AS last_url
        FROM c WHERE CASE WHEN any_text THEN by_text ELSE by_href END GROUP BY url""",
    "b2_resolve_url": _with(_N, "SELECT k AS ingest_pos, url AS detail_url FROM t"),
    "b3_page_dates": _with(_ITEMS, """
        SELECT category, page, string_agg(d, ',' ORDER BY d DESC) AS dates
        FROM (SELECT DISTINCT category, page, CAST(day AS VARCHAR) AS d FROM items) GROUP BY category, page"""),
    "b4_link_publish_date": _with(_ITEMS, "SELECT url AS detail_url, day AS publish_date FROM linked"),
    "b5_extract_publish_time": _with(_N, "SELECT k AS ingest_pos, CAST(day AS VARCHAR) AS publish_time FROM t"),
    "b6_select_table": _with(_N, """
        SELECT k AS ingest_pos, CAST(2 AS BIGINT) AS tables, CAST(2 AS BIGINT) AS table_no,
          CASE WHEN k % 2 = 0 THEN 'MsoTableGrid' ELSE 'MsoNormalTable' END AS classes FROM t"""),
    "b7_explode_cells": _with(_CELLS, """
        SELECT k AS ingest_pos, 2 AS table_no, row_no, cell_no,
          CASE WHEN k % 3 = 2 AND row_no = 2 AND cell_no IN (3, 5) THEN 2 ELSE 1 END AS rowspan, 1 AS colspan, text FROM cells
        UNION ALL SELECT k, 1, 1, 1, 1, 1, '首页' FROM t"""),
    "b8_classify_layout": _with(_N, """
        SELECT k AS ingest_pos, 1 AS table_no, 'none' AS layout FROM t
        UNION ALL SELECT k, 2, CASE WHEN k % 3 = 1 THEN 'key_value' ELSE 'horizontal' END FROM t"""),
    "b9_map_header": _with(_N, """
        SELECT header, cells, field, compat_field, label_field FROM (
          SELECT count(*) FILTER (WHERE k % 3 = 1) AS kv, count(*) FILTER (WHERE k % 3 <> 1) AS across FROM t) c,
        LATERAL (VALUES
          ('序号', c.across, '序号', '序号', '序号'),
          ('当事人名称', c.across, '当事人名称', '当事人名称', '当事人名称'),
          ('主要违法违规行为', c.across, '主要违法违规行为', '主要违法违规行为', '主要违法违规行为'),
          ('行政处罚内容', c.across, '行政处罚内容', '行政处罚内容', '行政处罚内容'),
          ('作出决定机关', c.across, '作出决定机关', '作出决定机关', '作出决定机关'),
          ('行政处罚决定书文号', c.kv, '行政处罚决定书文号', '行政处罚内容', '行政处罚决定书文号'),
          ('被处罚当事人', c.kv, '当事人名称', '当事人名称', '当事人名称'),
          ('主要违法违规事实', c.kv, '主要违法违规行为', '主要违法违规行为', '主要违法违规行为'),
          ('行政处罚依据', c.kv, '行政处罚依据', '行政处罚内容', '行政处罚依据'),
          ('行政处罚决定', c.kv, '行政处罚内容', '行政处罚内容', '行政处罚内容'),
          ('作出处罚决定的机关名称', c.kv, '作出决定机关', '行政处罚内容', '作出决定机关'),
          ('作出处罚决定的日期', c.kv, '作出决定日期', '行政处罚内容', '作出决定日期')
        ) v(header, cells, field, compat_field, label_field)"""),
    "b10_parse_horizontal_single": _with(_N, """
        SELECT k AS ingest_pos, CAST(k AS VARCHAR) AS seq, entity, violation, content, nation AS authority FROM t WHERE k % 3 = 0"""),
    "b11_parse_horizontal_multi": _with(_N, """
        SELECT group_no, record_total,
          CASE WHEN total_rows = 1 THEN '' ELSE CAST(nth + CASE WHEN group_no % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS row_in_notice,
          CASE WHEN total_rows = 1 THEN '' WHEN record_total > 1 THEN '是' ELSE '否' END AS is_multi,
          CASE WHEN total_rows = 1 THEN '' ELSE CAST(k AS VARCHAR) END AS source_seq,
          entity, content, nation AS authority, basis
        FROM (SELECT *, k // 3 AS group_no, row_number() OVER (PARTITION BY k // 3 ORDER BY k) AS nth,
                count(*) OVER (PARTITION BY k // 3) AS record_total,
                count(*) OVER (PARTITION BY k // 3) + CASE WHEN k // 3 % 5 = 0 THEN 1 ELSE 0 END AS total_rows FROM t)"""),
    "b12_has_merged_cells": _with(_N, "SELECT k AS ingest_pos, k % 3 = 2 AS merged FROM t"),
    "b13_expand_spans": _with(_N, """
        SELECT k AS ingest_pos, y AS row_no, x AS col_no,
          CASE WHEN y = 1 THEN ['1', entity, violation, content, nation][x] ELSE ['2', '乙' || k, violation, '警告', nation][x] END AS text
        FROM t, (SELECT unnest([1, 2]) AS y) ys, (SELECT unnest([1, 2, 3, 4, 5]) AS x) xs WHERE k % 3 = 2"""),
    "b14_parse_key_value": _with(_N, """
        SELECT k AS ingest_pos, entity, violation, content, nation AS authority, basis, 'N罚决字' || k AS doc_no, day AS decided
        FROM t WHERE k % 3 = 1"""),
    "b15_extract_basis": _with(_N, """
        SELECT k AS ingest_pos, nation || '办法第' || (k % 60 + 1) || '条' ||
          CASE WHEN length(coalesce(nullif(entity, ''), '某机构') || '规定') > 5
               THEN '；' || coalesce(nullif(entity, ''), '某机构') || '规定' ELSE '' END AS basis FROM t"""),
    "b16_extract_content": _with(_N, """
        SELECT k AS ingest_pos, '对甲' || k || '警告并罚款7万元；对' || coalesce(nullif(entity, ''), '某机构') ||
          '罚款' || (k % 500) || '万元' AS content FROM t"""),
    "b17_containment_dedup": _with(_N, """
        SELECT k AS ingest_pos, CASE WHEN k < 10 THEN '警告乙' || k || '|对丙罚款甲' || k
          ELSE '警告乙' || k || '|对丙罚款甲' || k END AS kept FROM t"""),
    "b18_overlay_fallbacks": _with(_N, """
        SELECT k AS ingest_pos, CASE WHEN basis <> '' THEN basis ELSE title END AS basis,
          CASE WHEN content <> '' THEN content ELSE nation END AS content FROM t"""),
    "b19_keyword_table": _with(_CELLS, """
        SELECT k AS ingest_pos, row_no, string_agg(text, chr(9) ORDER BY cell_no) AS line
        FROM cells WHERE k % 3 = 2 AND text <> '' GROUP BY k, row_no"""),
    "b20_expand_multi_record": _with(_RECORDS, """
        SELECT k AS ingest_pos, record_no, record_total, entity, violation, content, authority, title, CAST(day AS VARCHAR) AS publish_time
        FROM rec2"""),
    "b21_join_list_detail": _with(_RECORDS + """,
        placed AS (SELECT k, CAST(floor((row_number() OVER (PARTITION BY category ORDER BY day DESC, k) - 1) / 20) AS BIGINT) + 1 AS page FROM t)""", """
        SELECT url, category, page, record_no, entity, CAST(day AS VARCHAR) AS listed_on, '2025-01-01 00:00:00' AS crawl_time
        FROM rec2 JOIN placed USING (k)"""),

    "c1_resolve_categories": _with(_N, "SELECT category, count(*) AS records FROM t WHERE region IN (0, 2) GROUP BY category"),
    "c2_page_cap": _with(_ITEMS, "SELECT category, k AS ingest_pos, page FROM items WHERE page <= 3"),
    "c3_record_cap": _with(_ITEMS, "SELECT category, k AS ingest_pos FROM items WHERE rk <= 25"),
    "c4_filter_year": _with(_N, """
        SELECT k AS ingest_pos, publish AS publish_time FROM t
        WHERE (publish <> '' AND year(day) = 1996) OR year(day + INTERVAL 1 DAY) = 1996"""),
    "c5_filter_month": _with(_N, """
        SELECT k AS ingest_pos, publish AS publish_time FROM t
        WHERE CASE k % 5 WHEN 4 THEN strftime(day + INTERVAL 1 DAY, '%Y-%m') = '1996-12'
                         WHEN 2 THEN false ELSE strftime(day, '%Y-%m') = '1996-12' END"""),
    "c6_filter_last_days": _with(_N, """
        SELECT k AS ingest_pos, publish AS publish_time FROM t
        WHERE k % 5 = 4 OR (k % 5 <> 2 AND day >= TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 400 DAY)"""),
    "c7_list_date_window": _with(_N, """
        SELECT category, k AS ingest_pos, day AS publish_date FROM t WHERE day >= DATE '1996-12-01' AND day < DATE '1997-01-01'"""),
    "c8_take_while_recent": _with(_ITEMS, """
        SELECT category, k AS ingest_pos, day AS publish_date FROM (
          SELECT *, max(CAST(day < DATE '2001-06-01' AS INT)) OVER (PARTITION BY category ORDER BY page, pos
            ROWS UNBOUNDED PRECEDING) AS old FROM items) WHERE old = 0"""),
    "c9_run_window": _with(_N, """
        SELECT mode, category, count(*) AS records
        FROM t JOIN (VALUES ('test', DATE '0001-01-01', DATE '9999-01-01'), ('full', DATE '0001-01-01', DATE '9999-01-01'),
          ('init', DATE '2025-01-01', DATE '2026-01-01'), ('monthly', DATE '2000-02-01', DATE '2000-03-01'),
          ('daily', DATE '2000-03-14', DATE '2000-03-15')) m(mode, lo, hi) ON day >= lo AND day < hi
        GROUP BY mode, category"""),

    "d1_normalize_fields": _with(_N, """
        SELECT k AS ingest_pos, (SELECT string_agg(f, ',' ORDER BY f) FROM unnest(['序号', '标题', '当事人名称', '主要违法违规行为',
          '行政处罚内容', '作出决定机关', '发布时间', '抓取时间', '罚款金额', CASE WHEN k % 2 = 1 THEN 'detail_url' ELSE '详情链接' END]) u(f)) AS names,
          entity FROM t"""),
    "d2_clean_text": rf"""
        SELECT doc_id, length(c) AS chars, md5(c) AS md5 FROM (
          SELECT doc_id, trim(replace(replace(replace(replace(regexp_replace(text || ' ', '{_BLANKS}+', ' ', 'g'), '&nbsp;', ' '),
            '&amp;', '&'), '&lt;', '<'), '&gt;', '>') ) || '  <' AS c FROM documents)""",
    "d3_clean_value": _with(_N, "SELECT k AS ingest_pos, violation FROM t"),
    "d4_standardize_amount": _with(_N, f"""
        SELECT k AS ingest_pos, {_AMOUNT_TEXT} AS amount_text, CAST({_YUAN} AS VARCHAR) || '.00' AS amount_yuan FROM t"""),
    "d5_format_date": _with(_N, """
        SELECT k AS ingest_pos, CASE WHEN k % 5 = 3 THEN publish ELSE coalesce(CAST(publish_day AS VARCHAR), '') END AS day FROM t"""),
    "d6_parse_time": _with(_N, """
        SELECT k AS ingest_pos, CAST(publish_day AS VARCHAR) || ' 00:00:00' AS published FROM t"""),
    "d7_decision_number": _with(_N, "SELECT k AS ingest_pos, doc_no FROM t"),
    "d8_seq_sort_key": _with(_N, """
        SELECT k AS ingest_pos, CASE WHEN k % 3 = 0 THEN k % 50 WHEN seq = '' THEN 9999 ELSE k END AS major,
          CASE WHEN k % 3 = 0 THEN k % 7 ELSE 0 END AS minor FROM t"""),
    "d9_first_nonempty": _with(_N, "SELECT k AS ingest_pos, CASE WHEN publish <> '' THEN publish ELSE entity END AS first FROM t"),
    "d10_fill_decision_number": _with(_N, """
        SELECT k AS ingest_pos, CASE WHEN k % 2 = 0 THEN '已有' ELSE doc_no END AS decision_document_number FROM t"""),
    "d_clean_records": _with(_N, f"""
        SELECT k AS ingest_pos, {_AMOUNT_TEXT} AS amount_text,
          CASE WHEN {_YUAN} >= 10000 AND k % 3 = 1 THEN CAST(CAST(printf('%.1f', {_YUAN} / 10000.0::DOUBLE) AS DECIMAL(10, 1)) * 10000 AS BIGINT) || '.00'
               ELSE CAST({_YUAN} AS VARCHAR) || '.00' END AS amount_yuan,
          violation, content FROM t"""),

    "e1_process_category": _with(_N, """
        SELECT m.k AS ingest_pos, m.position, CASE WHEN t.k = m.k THEN m.members - 1 ELSE t.k - m.k - 1 END AS part,
          CASE WHEN t.k = m.k THEN CASE WHEN m.seq <> '' THEN m.seq ELSE CAST(m.position AS VARCHAR) END
               ELSE m.position || '-' || (t.k - m.k) END AS seq,
          t.entity, m.title, m.category
        FROM (SELECT f.*, row_number() OVER (PARTITION BY category ORDER BY k) AS position,
                (SELECT count(*) FROM t x WHERE x.k // 3 = f.k // 3) AS members
              FROM t f WHERE k % 3 = 0) m
        JOIN t ON t.k // 3 = m.k // 3"""),
    "e2_union_categories": _with(_N, """
        SELECT category, count(*) AS records, CASE WHEN region = 0 THEN 0 ELSE count(*) END AS titles,
          CASE WHEN region = 0 THEN count(*) ELSE 0 END AS numbers FROM t GROUP BY category, region"""),
    "e3_standardize_columns": _with(_N, """
        SELECT k AS ingest_pos, CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN NULL ELSE entity END AS entity, '' AS violation,
          '序号,当事人名称,主要违法违规行为,行政处罚依据,行政处罚内容,作出决定机关,标题,类别,页码,抓取时间,详情链接,ingest_pos' AS layout FROM t"""),
    "e4_canonicalize": _with(_N, """
        SELECT k AS seq_no, title, entity AS entity_name, violation AS violation_behavior, '' AS punishment_basis,
          content AS punishment_content, doc_no AS decision_document_number, nation AS decision_authority,
          publish AS publish_time, '' AS category, crawl AS crawl_time, link AS detail_url,
          'seq_no,title,entity_name,violation_behavior,punishment_basis,punishment_content,decision_document_number,decision_authority,publish_time,category,crawl_time,detail_url' AS layout
        FROM t"""),
    "e5_sort_by_time": _with(_N, """
        SELECT row_number() OVER (ORDER BY publish_day DESC NULLS LAST, day DESC, k) AS place, k AS ingest_pos FROM t"""),
    "e6_sort_by_category_seq": _with(_N, """
        SELECT k AS ingest_pos, category, s AS source_seq, row_number() OVER (ORDER BY region, major, minor NULLS FIRST, k) AS place
        FROM (SELECT *, CASE WHEN k % 5 = 0 THEN (k // 5) || '-1' ELSE seq END AS s,
                CASE WHEN k % 5 = 0 THEN k // 5 WHEN seq = '' THEN 9999 ELSE k END AS major,
                CASE WHEN k % 5 = 0 THEN 1 WHEN seq = '' THEN 0 END AS minor FROM t)"""),
    "e7_sort_by_seq": _with(_N, """
        SELECT k AS ingest_pos, s AS source_seq, row_number() OVER (ORDER BY major, minor, k) AS place
        FROM (SELECT *, CASE WHEN k % 5 = 0 THEN (k // 5) || '-1' ELSE seq END AS s,
                CASE WHEN k % 5 = 0 THEN k // 5 WHEN seq = '' THEN 9999 ELSE k END AS major,
                CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS minor FROM t)"""),
    "e8_renumber": _with(_N, """
        SELECT row_number() OVER (ORDER BY publish_day DESC NULLS LAST, day DESC, k) AS seq_no, k AS ingest_pos FROM t"""),
    "e9_dedup_business_key": _with(_N, """
        SELECT min(k) AS ingest_pos, entity AS entity_name, doc_no AS decision_document_number, nation AS decision_authority
        FROM t GROUP BY entity, doc_no, nation"""),
    "e10_dedup_fallback": _with(_N, """
        SELECT min(k) AS ingest_pos, entity AS entity_name, violation AS violation_behavior, content AS punishment_content
        FROM t GROUP BY entity, violation, content"""),
    "e11_merge_new": _with(_N, """
        SELECT k AS ingest_pos, seq AS source_seq, 'old' AS side FROM t WHERE day < DATE '1999-01-01'
        UNION ALL SELECT k, seq, 'new' FROM t WHERE day >= DATE '1997-01-01' AND (day >= DATE '1999-01-01' OR seq = '')"""),
    "e12_upsert_master": _with(_OLD_NEW, """
        SELECT row_number() OVER (ORDER BY publish_day DESC NULLS LAST, day DESC, source, k) AS seq_no, title, entity AS entity_name,
          violation AS violation_behavior, basis AS punishment_basis, content AS punishment_content,
          doc_no AS decision_document_number, nation AS decision_authority, publish AS publish_time, category,
          crawl AS crawl_time, link AS detail_url
        FROM ranked WHERE rn = 1"""),
    "e12_full_upsert": _with(_OLD_NEW, """
        SELECT row_number() OVER (ORDER BY publish_day DESC NULLS LAST, source, k) AS seq_no, title, entity AS entity_name,
          violation AS violation_behavior, basis AS punishment_basis, content AS punishment_content,
          doc_no AS decision_document_number, nation AS decision_authority, publish AS publish_time, category,
          crawl AS crawl_time, link AS detail_url
        FROM ranked WHERE rn = 1"""),
    "e13_upsert_counts": _with(_OLD_NEW, """
        SELECT before_count, after_count, after_count - before_count AS net_new, inserted, total - after_count AS removed, 0 AS removed_blank
        FROM (SELECT count(*) FILTER (WHERE source = 0) AS before_count, count(*) FILTER (WHERE rn = 1) AS after_count,
                count(*) FILTER (WHERE rn = 1 AND source = 1) AS inserted, count(*) AS total FROM ranked)"""),

    "f1_summary_by_category": _with(_N, """
        SELECT c AS category, count(k) AS records FROM (SELECT unnest(['总局机关', '监管局本级', '监管分局本级', '其他']) AS c)
        LEFT JOIN t ON t.category = c GROUP BY c
        UNION ALL SELECT '总计', count(*) FROM t"""),
    "f2_master_stats": _with(_N, """
        SELECT 1 AS rank, category AS metric, count(*) AS records, '2001-08-01 12:00:00' AS note, CAST(NULL AS VARCHAR) AS pct
        FROM t GROUP BY category
        UNION ALL SELECT 2, '总计', count(*), '2001-08-01 12:00:00', NULL FROM t
        UNION ALL SELECT 3, '2001年08月新增', 42, '2001-08-01 12:00:00', NULL
        UNION ALL SELECT 4, '数据完整记录', full_rows, '完整性: ' || p || '%', p
        FROM (SELECT full_rows, printf('%.1f', full_rows::DOUBLE / total * 100) AS p
              FROM (SELECT count(*) FILTER (WHERE entity <> '' AND content <> '') AS full_rows, count(*) AS total FROM t))"""),
    "f3_quality_report": _with(_N, """
        SELECT CASE WHEN grouping(category) = 1 THEN '总计' ELSE category END AS category, count(*) AS total,
          count(*) FILTER (WHERE entity = '') AS missing_name, count(*) FILTER (WHERE content = '') AS missing_punishment,
          0 AS missing_authority, count(*) FILTER (WHERE entity <> '' AND content <> '') AS valid_records
        FROM t GROUP BY ROLLUP (category)"""),
    "f4_quality_issues": _with(_N, """
        SELECT category, category || ': ' || count(*) || ' 条记录缺少当事人名称' AS issue FROM t WHERE entity = '' GROUP BY category
        UNION ALL
        SELECT category, category || ': ' || count(*) || ' 条记录缺少处罚内容' FROM t WHERE content = '' GROUP BY category"""),
    "f5_kpis": _with(_N, """
        SELECT count(*) AS records, count(DISTINCT category) AS categories, count(DISTINCT nullif(entity, '')) AS entities,
          CAST(max(publish_day) AS VARCHAR) AS latest_day FROM t"""),
    "f6_category_distribution": _with(_N, f"""
        SELECT category, records, printf('%.1f', records::DOUBLE / sum(records) OVER () * 100) AS pct FROM ({_PER_CATEGORY})"""),
    "f7_daily_trend": _with(_N, "SELECT publish_day AS day, count(*) AS records FROM t WHERE publish_day IS NOT NULL GROUP BY publish_day"),
    "f8_records_per_notice": _with(_N, """
        SELECT url AS detail_url, CASE WHEN k % 3 = 2 AND entity <> '' THEN 2 ELSE 1 END AS records FROM t"""),

    "g1_incremental_ingest": _with(_N, """
        SELECT row_number() OVER (ORDER BY publish_day DESC NULLS LAST, day DESC, k) AS seq_no, link AS detail_url,
          doc_no AS decision_document_number
        FROM (SELECT *, row_number() OVER (PARTITION BY entity, doc_no, nation ORDER BY k) AS rn FROM t) WHERE rn = 1"""),
    "g2_stream_late_rows": _with(_N, """
        SELECT row_number() OVER (ORDER BY publish_day DESC NULLS LAST, k) AS seq_no, link AS detail_url,
          doc_no AS decision_document_number
        FROM (SELECT *, row_number() OVER (PARTITION BY entity, doc_no, nation ORDER BY k) AS rn FROM t) WHERE rn = 1"""),
    "g2_stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "g3_daily_trend_stream": "SELECT CAST(ts AS DATE) AS day, count(*) AS records FROM events GROUP BY 1",
    "g4_run_log_extract": _with(_LOGS, """
        SELECT 'crawler' AS logger, (SELECT message FROM logs WHERE line_no % 10 <> 0 ORDER BY ts DESC, line_no DESC LIMIT 1) AS current_task,
          (SELECT line_no % 100 FROM logs WHERE line_no % 10 = 0 ORDER BY ts DESC, line_no DESC LIMIT 1) AS total_records"""),
    "g5_log_tail": _with(_LOGS, "SELECT line_no, level, message FROM logs ORDER BY ts DESC, line_no DESC LIMIT 250"),

    "run_pages_to_ledger": _with(_ITEMS + """,
        taken AS (SELECT * FROM linked WHERE day >= DATE '2001-06-01' AND day < DATE '2001-07-01'),
        recs AS (
          SELECT k, title, category, page, nth, day, url, 1 AS record_no, entity, nation, content,
            CASE WHEN k % 3 = 1 THEN 'N罚决字' || k ELSE doc_no END AS doc FROM taken WHERE NOT (k % 3 = 2 AND entity = '')
          UNION ALL
          SELECT k, title, category, page, nth, day, url, 2, '乙' || k, nation, '警告', doc_no FROM taken WHERE k % 3 = 2),
        kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, doc, nation ORDER BY category, page, nth, record_no) AS rn
                 FROM recs) WHERE rn = 1)""", """
        SELECT row_number() OVER (ORDER BY day DESC, category, page, nth, record_no) AS seq_no, title, entity AS entity_name,
          content AS punishment_content, doc AS decision_document_number, category, url AS detail_url FROM kept"""),
    "run_analysis": _with(_N, """
        SELECT category, total, missing_name, missing_punishment, 0 AS missing_authority, valid_records,
          CASE WHEN category = '总计' THEN '' ELSE category || ': ' || missing_name || ' 条记录缺少当事人名称；' ||
            category || ': ' || missing_punishment || ' 条记录缺少处罚内容' END AS issues
        FROM (SELECT CASE WHEN grouping(category) = 1 THEN '总计' ELSE category END AS category, count(*) AS total,
                count(*) FILTER (WHERE entity = '') AS missing_name, count(*) FILTER (WHERE content = '') AS missing_punishment,
                count(*) FILTER (WHERE entity <> '' AND content <> '') AS valid_records FROM t GROUP BY ROLLUP (category))"""),
}
