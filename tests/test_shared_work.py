"""In cleaning a record its names are looked up once per use of the map, not once per use of each value; the results stay."""

from decimal import Decimal

from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.operators import reshape as R


def test_names_are_looked_up_once_for_the_amount(spark):
    df = spark.createDataFrame([({"a": "b"},)], "fields map<string,string>")
    plan = df.select(R.exact_amount(F.col("fields")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("transform_keys") == 1


def test_amounts_and_names(spark):
    rows = [
        (1, {"当事人": "甲　 乙 ", "罚款金额": "１,０００元", fixed.CONTENT: "x"}), (2, {"金额": " 罚款 3.5 万元 "}),
        (3, {"处罚金额": "", "罚款金额": "警告", "金额": "5元"}), (4, {}), (5, None), (6, {"title": None, "金额": None}),
    ]
    df = spark.createDataFrame(rows, "n int, fields map<string,string>")
    got = df.select("n", R.clean_fields(F.col("fields")).alias("f"), R.exact_amount(F.col("fields")).alias("x")).orderBy("n").collect()
    assert [r.x for r in got] == [Decimal("1000.00"), Decimal("35000.00"), None, None, None, None]
    assert got[0].f[fixed.ENTITY] == "甲 乙" and got[0].f[fixed.CONTENT] == "x" and got[1].f["金额"] == "罚款3.5万元"
    assert got[3].f == {} and got[4].f is None and got[5].f == {fixed.TITLE: None, "金额": None}
