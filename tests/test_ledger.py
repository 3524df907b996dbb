"""Selection, order, dedup, upsert and storage."""

from datetime import date, datetime

import pytest
from conftest import SF
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.operators import master as M
from recordmill.operators import reshape as R
from recordmill.operators import select as C
from recordmill.operators import stats as S
from recordmill.plans import jobs
from recordmill.sources import fixtures as X
from recordmill.sources import store as A

COLUMNS = [c for c in fixed.LEDGER_FIELDS.values() if c != "seq_no"]


def ledger(spark, *rows):
    """Rows given by the fields they need."""
    full = [{**dict.fromkeys(COLUMNS, ""), "ingest_pos": i, **r} for i, r in enumerate(rows)]
    schema = ", ".join(f"{c} string" for c in COLUMNS) + ", ingest_pos bigint"
    return spark.createDataFrame([tuple(r[c] for c in [*COLUMNS, "ingest_pos"]) for r in full], schema)


def party(name, number="n", authority="a", **more):
    return {"entity_name": name, "decision_document_number": number, "decision_authority": authority, **more}


def test_clean_record_keeps_content(spark):
    df = spark.sql("""SELECT map('当事人', ' 甲 公司 ', '处罚金额', '158万元', '行政处罚内容', '罚款158万元。') AS fields""")
    row = R.clean_records(df).first()
    assert row.fields == {fixed.ENTITY: "甲 公司", "处罚金额": "罚款158.0万元", fixed.CONTENT: "罚款158万元。"}
    assert str(row.amount_yuan) == "1580000.00"


def test_additional_rows_come_before_their_main(spark):
    df = spark.sql("""
        SELECT 10L AS ingest_pos, '总局机关' AS category, map('序号', '', '标题', 't') AS fields, cast(null as array<map<string,string>>) AS additional
        UNION ALL SELECT 11L, '总局机关', map('序号', '9', '标题', 'u', '详情链接', 'l'), array(map('当事人', 'x'), map('标题', ''))""")
    rows = R.process_category(df).orderBy("position", "part").collect()
    assert [r.fields[fixed.SEQ] for r in rows] == ["1", "2-1", "2-2", "9"]
    assert [r.fields[fixed.TITLE] for r in rows] == ["t", "u", "", "u"]
    assert rows[1].fields[fixed.DETAIL_URL] == "l" and rows[1].fields[fixed.ENTITY] == "x"


def test_dedup_first_wins_and_blank_goes(spark):
    df = ledger(spark, party("甲", title="1"), party("甲", title="2"), party(None, "", " "), party("", "n", ""), party("a|b", "c"), party("a", "b|c"))
    assert [r.ingest_pos for r in M.dedup(df).orderBy("ingest_pos").collect()] == [0, 3, 4, 5]
    assert M.business_key(["entity_name", "punishment_content"]) == ["entity_name", "punishment_content"]
    assert M.dedup(df.select("ingest_pos", "title")).count() == 6


def test_merge_new_keeps_keyless(spark):
    old = spark.createDataFrame([("1", "o"), ("", "o"), (None, "o")], "k string, s string")
    new = spark.createDataFrame([("1", "n"), ("2", "n"), ("2", "n"), ("", "n"), (None, "n")], "k string, s string")
    got = sorted((r.k or "", r.s) for r in M.merge_new(old, new, "k").collect())
    assert got == [("", "n"), ("", "n"), ("", "o"), ("", "o"), ("1", "o"), ("2", "n"), ("2", "n")]
    assert M.merge_new(old.limit(0), new, "k").count() == 5 and M.merge_new(old, new.limit(0), "k").count() == 3


def test_upsert_twice_changes_nothing(spark):
    old = ledger(spark, party("甲", publish_time="2024-01-01"), party("乙", publish_time="待定"))
    new = ledger(spark, party("甲", title="x"), party("丙", publish_time="2024年2月1日"), party("丙"), party("丁", crawl_time="2025-01-01"))
    once = M.upsert_master(old, new).orderBy("seq_no").collect()
    assert [(r.seq_no, r.entity_name) for r in once] == [(1, "丙"), (2, "甲"), (3, "乙"), (4, "丁")]
    assert once[1].title == ""  # a row without a readable publish time stands by position, whatever its crawl time
    again = M.upsert_master(spark.createDataFrame(once), new).orderBy("seq_no").collect()
    assert again == once
    counts = M.upsert_counts(old, new).first()
    assert (counts.before_count, counts.after_count, counts.net_new, counts.inserted, counts.removed) == (2, 4, 2, 2, 2)


def test_order_falls_back_to_crawl_time(spark):
    df = ledger(spark, {"crawl_time": "2024-01-01 00:00:00"}, {"crawl_time": "2024-03-01 00:00:00"}, {"crawl_time": ""})
    assert [r.ingest_pos for r in R.sort_by_time(df).collect()] == [1, 0, 2]


def test_category_and_sequence_order(spark):
    rows = [("监管局本级", "2"), ("总局机关", "1-2"), ("其他", "1"), ("总局机关", "x"), ("总局机关", "1"), ("总局机关", "10"), ("总局机关", "1-1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ingest_pos int, category string, source_seq string")
    assert [r.ingest_pos for r in R.sort_by_category_seq(df).collect()] == [4, 6, 1, 5, 3, 0, 2]
    assert [r.source_seq for r in R.sort_by_seq(df).collect()] == ["1", "1", "1-1", "1-2", "2", "10", "x"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 5)), max_size=40))
def test_numbers_are_contiguous_per_group(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, v int")
    got = R.number_rows(df, [F.col("v").desc(), F.col("i")], name="no", by=["g"]).collect()
    for group in {r.g for r in got}:
        mine = sorted((r for r in got if r.g == group), key=lambda r: r.no)
        assert [r.no for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r.v, r.i) for r in mine] == sorted((-r.v, r.i) for r in mine)
    assert len(got) == len(rows)


def test_one_group_holding_most_rows_is_spread(spark):
    """A group larger than its share lands in several range partitions and is still numbered 1..n."""
    df = spark.range(20000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    hot = R.number_rows(df, [F.col("id")], name="no", by=["g"]).where("g = 'hot'")
    assert hot.agg(F.min("no"), F.max("no"), F.countDistinct("no")).first()[:] == (1, 13333, 13333)


def test_categories():
    assert C.resolve_categories("all") == C.resolve_categories(None) == C.resolve_categories("x,y") == list(fixed.CATEGORIES)
    assert C.resolve_categories(" 2, zhongju ,2,监管局本级,?") == ["监管局本级", "总局机关"]


def test_run_windows():
    assert C.run_window("monthly", date(2025, 1, 10)) == (date(2024, 12, 1), date(2025, 1, 1))
    assert C.run_window("daily", date(2025, 3, 1)) == (date(2025, 2, 28), date(2025, 3, 1))
    assert C.run_window("init", date(2030, 1, 1)) == (date(2025, 1, 1), date(2026, 1, 1))
    assert C.run_window("full", date(2025, 1, 1)) == (None, None)
    with pytest.raises(ValueError):
        C.run_window("weekly", date(2025, 1, 1))


def test_undated_and_unreadable_rows(spark):
    df = ledger(spark, {}, {"publish_time": "待定"}, {"publish_time": "2024-06-01"}, {"crawl_time": "2024-06-30 01:00:00"}, {"publish_time": "约2024-06中旬"})
    kept = lambda out: [r.ingest_pos for r in out.orderBy("ingest_pos").collect()]
    assert kept(C.filter_year(df, 2024)) == [0, 2, 3, 4]
    assert kept(C.filter_month(df, 2024, 6)) == [2, 3, 4]
    assert kept(C.filter_last_days(df, 30, datetime(2024, 6, 20))) == [0, 2, 3]


def test_take_while(spark):
    days = ["2024-06-30", "2024-06-15", "2024-05-31", "2024-06-01"]
    df = spark.createDataFrame([("c", 1, i, date.fromisoformat(d)) for i, d in enumerate(days)] + [("d", 1, 1, None)],
                               "category string, page int, pos int, publish_date date")
    taken = [str(r.publish_date) for r in C.take_while_recent(df, date(2024, 6, 1)).orderBy("pos").collect()]
    assert taken == days[:2]
    assert C.list_date_window(df, *C.month_window(2024, 6)).count() == 3


def test_caps(spark):
    df = spark.createDataFrame([("c", p, i) for p in (1, 2) for i in range(4)], "category string, page int, pos int")
    assert C.record_cap(df, 5).count() == 5 and C.record_cap(df, None).count() == 8
    assert C.page_cap(df, 1).count() == 4 and C.page_cap(df, None).count() == 8


def test_statistics_of_nothing(spark):
    empty = ledger(spark).limit(0)
    assert [(r.category, r.records) for r in S.summary_by_category(empty).orderBy("position").collect()] == [
        *((c, 0) for c in fixed.CATEGORIES), ("总计", 0),
    ]
    assert sorted((r["rank"], r.records) for r in S.master_stats(empty, 0, datetime(2025, 1, 1)).collect()) == [(2, 0), (3, 0)]
    assert S.quality_report(empty).first().total == 0


def test_store_round_trips(spark, tmp_path):
    rows = ledger(spark, party("甲", category="总局机关", title="a/b"), party("乙", category="监管局本级", title=""))
    numbered = R.ledger_projection(R.renumber(rows))
    A.write_snapshot(numbered.limit(1), f"{tmp_path}/m", datetime(2025, 1, 1))
    A.write_snapshot(numbered, f"{tmp_path}/m", datetime(2025, 1, 2, 3))
    (tmp_path / "m" / "snapshot_ts=20990101_000000").mkdir()  # a write that never finished
    assert sorted(map(tuple, A.latest_snapshot(spark, f"{tmp_path}/m").collect())) == sorted(map(tuple, numbered.collect()))
    assert A.scan_master(spark, f"{tmp_path}/none").columns == list(fixed.LEDGER_FIELDS.values())
    A.write_by_category(numbered, f"{tmp_path}/c")
    assert {(r.category, r.records) for r in spark.read.parquet(f"{tmp_path}/c/counts").collect()} == {
        ("总局机关", 1), ("监管局本级", 1), ("监管分局本级", 0),
    }
    texts = A.export_text(rows.withColumn("source_seq", F.lit("1")))
    assert {r.file_key for r in texts.collect()} == {"a_b", "监管局本级_1"}
    A.write_text(texts, f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").where("value like '当事人名称%'").count() == 2
    assert set(map(tuple, A.read_text(spark, f"{tmp_path}/t").collect())) == set(map(tuple, texts.collect()))


def test_labelled_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("被处罚当事人\t\t甲\t公司\n行政处罚决定\t警告\n行政处罚决定书文号\t1号\n行政处罚决定\t罚款\n", encoding="utf-8")
    row = A.labelled_lines_to_row(A.read_labelled_files(spark, str(tmp_path))).first()
    assert (row.file, row["被处罚当事人"], row["行政处罚决定"], row["行政处罚决定书文号"], row["行政处罚依据"]) == (
        "x.txt", "甲公司", "罚款", "1号", "",
    )


def test_update_master_then_again(spark, tmp_path):
    batch = R.fill_decision_number(X.notices(spark, SF))
    first = jobs.update_master(spark, f"{tmp_path}/m", batch, datetime(2025, 1, 1)).first()
    second = jobs.update_master(spark, f"{tmp_path}/m", batch, datetime(2025, 1, 2)).first()
    assert first.inserted == first.after_count == second.before_count == second.after_count and second.inserted == 0
    jobs.save_report(A.latest_snapshot(spark, f"{tmp_path}/m"), f"{tmp_path}/r", datetime(2025, 1, 2))
    assert spark.read.parquet(f"{tmp_path}/r/main").count() == first.after_count


def test_full_run_takes_every_page(spark):
    lists, details = X.list_html(spark, SF), X.detail_html(spark, SF).select("url", "html")
    raw = jobs.collect_records(lists, details, X.SITE, "full", date(2025, 1, 1), "2025-01-01 00:00:00")
    daily = jobs.collect_records(lists, details, X.SITE, "daily", date(2001, 8, 2), "2025-01-01 00:00:00", "1")
    assert raw.select("url").distinct().count() == 1050
    assert {r.category for r in daily.collect()} <= {"总局机关"}


def test_process_and_save(spark, tmp_path):
    quality = jobs.process_and_save(
        X.nested_records(spark, SF), str(tmp_path / "run"), datetime(2025, 1, 1), str(tmp_path / "master"), text_export=True
    )
    total = quality.where(F.col("category") == "总计").first()
    assert (total.total, total.missing_authority) == (500, 0)  # main records; their additional rows are not checked
    main = spark.read.parquet(f"{tmp_path}/run/report/main")
    assert main.agg(F.count("*"), F.max("seq_no"), F.countDistinct("seq_no")).first()[:] == (1500, 1500, 1500)
    stats = {r.category: r.records for r in spark.read.parquet(f"{tmp_path}/run/report/stats").collect()}
    assert stats["总计"] == 1500 == sum(stats[c] for c in fixed.CATEGORIES)
    master = A.latest_snapshot(spark, f"{tmp_path}/master")
    assert master.count() == M.dedup(main.withColumn("ingest_pos", F.col("seq_no"))).count() < 1500
    assert spark.read.text(f"{tmp_path}/run/texts").where("value like '序号%'").count() > 0


def test_added_fields_reach_the_ledger(spark, tmp_path):
    from recordmill.streaming import ingest as G

    base = {fixed.DOC_NO: "1号", fixed.AUTHORITY: "局", "罚款金额": "58,530元", fixed.DECISION_DATE: "2024年3月5日", "备注": "x"}
    raw = [(0, "总局机关", {**base, fixed.ENTITY: "甲"}, [{**base, fixed.ENTITY: "乙", "罚款金额": "1,580万元", fixed.DECISION_DATE: "待定"}])]
    records = spark.createDataFrame(raw, "ingest_pos long, category string, fields map<string,string>, additional array<map<string,string>>")
    want = {"甲": ("2024-03-05", "58530.00"), "乙": ("None", "15800000.00")}

    def check(df):
        rows = {r.entity_name: r for r in df.collect()}
        assert df.columns == [*fixed.LEDGER_FIELDS.values(), "decision_date", "amount_yuan", "extras"]
        assert {k: (str(r.decision_date), str(r.amount_yuan)) for k, r in rows.items()} == want
        assert all(r.extras["备注"] == "x" for r in rows.values()) and rows["乙"].extras[fixed.DECISION_DATE] == "待定"

    jobs.process_and_save(records, f"{tmp_path}/run", datetime(2025, 1, 1), f"{tmp_path}/m")
    check(spark.read.parquet(f"{tmp_path}/run/report/main"))
    check(A.latest_snapshot(spark, f"{tmp_path}/m"))
    plain = ledger(spark, party("丙"))
    jobs.update_master(spark, f"{tmp_path}/m", plain, datetime(2025, 1, 2))  # a batch without them
    want["丙"] = ("None", "None")
    later = A.latest_snapshot(spark, f"{tmp_path}/m")
    assert later.where("entity_name = '丙' AND extras IS NULL").count() == 1
    check(later.withColumn("extras", F.coalesce("extras", F.create_map(F.lit("备注"), F.lit("x")))))
    del want["丙"]
    batch = spark.read.parquet(f"{tmp_path}/run/report/main").withColumn("ingest_pos", F.col("seq_no"))
    G.append_batch(plain.limit(0), 0, f"{tmp_path}/s")
    G.append_batch(batch, 1, f"{tmp_path}/s")
    check(G.read_ingested(spark, f"{tmp_path}/s"))


def test_added_fields_of_a_run(spark):
    lists, details = X.list_html(spark, SF), X.detail_html(spark, SF).select("url", "html")
    out = jobs.pages_to_ledger(lists, details, X.SITE, "monthly", date(2001, 7, 10), "2025-01-01 00:00:00")
    assert out.columns == [*fixed.LEDGER_FIELDS.values(), "decision_date", "amount_yuan", "extras"]
    assert out.where("extras IS NULL").count() == 0 < out.count()


def test_scratch_follows_the_session():
    from recordmill import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "hdfs://shared/check/"}.get(key, default)

    class Remote:
        conf = Conf()

    assert session.scratch_root(Remote()) == "hdfs://shared/check"

    class Unset:
        conf = type("C", (), {"get": lambda self, key, default=None: default})()
        sparkContext = type("S", (), {"master": "yarn", "applicationId": "x"})()

    with pytest.raises(RuntimeError):
        session.scratch_root(Unset())


def test_update_master_twice_in_one_second(spark, tmp_path):
    batch = R.fill_decision_number(X.notices(spark, SF))
    now = datetime(2025, 1, 1)
    first, second = (jobs.update_master(spark, f"{tmp_path}/m", batch, now).first() for _ in range(2))
    assert first.inserted == second.before_count == second.after_count and second.inserted == 0
    assert A.latest_snapshot(spark, f"{tmp_path}/m").count() == first.after_count


def test_a_run_takes_its_whole_window(spark):
    items = spark.createDataFrame([("监管分局本级", p, 0, date(2001, 6, 1 + p % 20)) for p in range(60)], "category string, page int, pos int, publish_date date")
    assert C.select_for_run(items, "monthly", date(2001, 7, 3)).count() == 60
    assert C.select_for_run(items, "monthly", date(2001, 7, 3), max_pages=15).count() == 16
    assert C.select_for_run(items, "init", date(2030, 1, 1), init_year=2001, max_records=7).count() == 7
