import pytest
from pyspark.sql import functions as F

from tidemark.functions import date_before
from tidemark.operators import items, quality


def test_rules_of_rules(spark):
    """Steps build on each other in whatever order they are listed; a circle is refused; reported inputs make none."""
    wide = spark.createDataFrame([(1, 10.0, 4.0, None, 1.0), (2, None, 4.0, 3.0, None)], "id long, ni double, ceq double, lt double, epspi double")
    got = {r.id: r for r in items.derive(wide).collect()}
    assert (got[1].ib, got[1].ibadj, got[1].ibadj12, got[1].epsfi12) == (10.0, 10.0, 40.0, 4.0)
    assert got[1]["at"] is None and got[2]["at"] == 7.0 and got[2]["seq"] == 4.0 and got[2].ibadj12 is None
    backwards = items.derive(wide, tuple(reversed(items.RULES)))
    assert {r.id: r.ibadj12 for r in backwards.collect()} == {1: 40.0, 2: None}
    circle = (items.Rule("x", ("y",), lambda v: v), items.Rule("y", ("x",), lambda v: v))
    with pytest.raises(ValueError, match="circle"):
        items.derive(wide.withColumn("x", F.lit(1.0)), circle)
    assert items.derive(wide.select("id")).columns == ["id"]


def test_fuzzy_loses_no_pair(spark):
    """Short and long entries, containment both ways, ties by order, keywords last."""
    tags = ["us-gaap:AB", "abcabc", "a", "ext:OperatingExpenseTotal", "zzzz", "", None, "dividendpaid", "cashc"]
    mapping = [("abc", "one", 3), ("cab", "two", 2), ("abcabcabc", "three", 5), ("b", "four", 1), ("cash", "five", 9), ("--", "none", 0)]
    got = {r.tag: (r.item, r.how) for r in items.fuzzy(spark.createDataFrame([(x,) for x in tags], "tag string"), spark.createDataFrame(mapping, "tag string, item string, n int")).collect()}
    assert got == {"abcabc": ("two", "similar"), "ext:OperatingExpenseTotal": ("xopr", "keywords"), "dividendpaid": ("dvp", "keywords"), "cashc": ("five", "similar")}


def test_large_losses_leave_income_items_only(spark):
    rows = [(1, 2020, 1, i, "2020-05-01", "2020-03-31", v) for i, v in (("ni", -2e6), ("ni", -5.0), ("lt", -2e6))]
    df = spark.createDataFrame(rows, "company long, fy int, fq int, item string, effective string, through string, value double")
    assert {r.item: r.value for r in items.revise(df).collect()} == {"ni": -5.0, "lt": -2e6}


def test_types_nulls_and_days_without_a_year(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 1.0)], "k long, s string, v double")
    b = spark.createDataFrame([("1", 0.5, 7)], "k string, v double, extra int")
    assert [tuple(r) for r in quality.type_differences(a, b).collect()] == [("extra", None, "int"), ("k", "bigint", "string"), ("s", "string", None)]
    assert quality.type_differences(a, a).count() == 0
    same = quality.same_tables(a, b).first()
    assert (same.left_rows, same.right_rows, same.equal, same.only_left, same.only_right, same.other_nulls) == (2, 1, False, "s", "extra", "v")
    rows = [("September 30", "2024-11-01"), ("December 31", "2025-02-10"), ("February 29", "2023-05-01"), ("February 29", "1907-05-01"), ("March 1", "2024-03-01"), ("nonsense", "2024-03-01"), (None, "2024-03-01")]
    df = spark.createDataFrame(rows, "t string, f string").select(date_before(F.col("t"), F.to_date("f")).cast("string").alias("d"))
    assert [r.d for r in df.collect()] == ["2024-09-30", "2024-12-31", "2020-02-29", "1904-02-29", "2024-03-01", None, None]
