"""Lines of labelled files are dealt by file before they are sorted."""

from recordmill.sources.store import labelled_lines_to_row

ROWS = [("a", 0, "行政处罚决定书文号\tX"), ("a", 3, "行政处罚决定书文号\tN"), ("b", 0, "nothing"), (None, 1, "被处罚当事人\tQ"), ("a", 1, None)]


def _lines(spark):
    return spark.createDataFrame(ROWS, "file string, line_no int, line string")


def test_the_last_line_wins(spark):
    got = {r["file"]: (r["行政处罚决定书文号"], r["被处罚当事人"]) for r in labelled_lines_to_row(_lines(spark)).collect()}
    assert got == {"a": ("N", ""), "b": ("", ""), None: ("", "Q")}


def test_no_sort_before_the_rows_are_dealt(spark):
    plan = labelled_lines_to_row(_lines(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.rindex("Sort") < plan.index("Exchange")  # the plan is written from its end
