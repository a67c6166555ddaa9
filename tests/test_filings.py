import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import number_from_text
from tidemark.operators import filings, fundamentals, items, quality


def test_numbers(spark):
    df = spark.createDataFrame([("(1,234)",), ("$5.5",), ("-",), ("x",), (None,), ("1 000",)], "t string")
    assert [r.v for r in df.select(number_from_text(F.col("t")).alias("v")).collect()] == [-1234.0, 5.5, None, None, None, 1000.0]


def test_contexts_and_facts(spark):
    body = "".join(f'<xbrli:context id="c{n}"><startDate>2024-01-01</startDate><endDate>{dt.date(2024, 1, 1) + dt.timedelta(n)}</endDate></xbrli:context>' for n in (90, 181, 273, 364))
    body += '<ix:nonFraction name="us-gaap:Revenues" contextRef="c90" scale="3">(1,234)</ix:nonFraction><ix:nonFraction contextRef="c90" name="us-gaap:Assets">7</ix:nonFraction>'
    df = spark.createDataFrame([(1, body)], "id long, content string")
    assert {r.context: r.kind for r in filings.contexts(df).collect()} == {"c90": "QTD", "c181": "YTD_H1", "c273": "YTD_9M", "c364": "YTD_ANNUAL"}
    assert {r.tag: r.value for r in filings.facts(df).collect()} == {"Revenues": -1.234, "Assets": 7.0}


def test_table_rows(spark):
    df = spark.createDataFrame([(1, "<table><tr><th>Revenue</th><td>n/a</td><td>$1,200</td></tr><tr><td>only</td></tr></table>")], "id long, content string")
    assert [(r.label, r.value) for r in filings.tables(df).collect()] == [("Revenue", 1200.0)]


def test_year_to_date(spark):
    rows = [("c", "i", 2024, q, v, k) for q, v, k in ((1, 10.0, "QTD"), (2, 25.0, "YTD_H1"), (3, 45.0, "YTD_9M"), (4, 70.0, "YTD_ANNUAL"))]
    rows += [("c", "j", 2024, 4, 70.0, "YTD_ANNUAL"), ("c", "k", 2024, 1, 10.0, "QTD"), ("c", "k", 2024, 2, 15.0, "QTD"), ("c", "k", 2024, 3, 45.0, "UNKNOWN")]
    facts = spark.createDataFrame(rows, "company string, item string, fy int, fq int, value double, period string")
    got = sorted((r.item, r.fq, r.value) for r in fundamentals.ytd_fold(facts).collect())
    assert got == [("i", 1, 10.0), ("i", 2, 15.0), ("i", 3, 20.0), ("i", 4, 25.0), ("k", 1, 10.0), ("k", 2, 15.0), ("k", 3, 20.0)]


def test_mapping_and_derived(spark):
    facts = spark.createDataFrame([(1, "us-gaap:Sales_Revenue", 10.0), (1, "Cogs", 4.0)], "id long, tag string, value double")
    mapping = spark.createDataFrame([("SalesRevenue", "old", 0), ("salesrevenue", "sale", 1), ("cogs", "cogs", 2)], "tag string, item string, n int")
    wide = items.widen(items.map_tags(facts, mapping), ["id"], ["sale", "cogs"])
    assert items.derive(wide).first().gp == 6.0
    tags = spark.createDataFrame([("SalesRevenueNetTotal",), ("zzz",)], "tag string")
    assert [(r.tag, r["item"]) for r in items.fuzzy(tags, mapping).collect()] == [("SalesRevenueNetTotal", "old")]


def test_comparisons(spark):
    a = spark.createDataFrame([("x", "i", 100.0), ("y", "i", 0.5), ("z", "i", 3.0)], "k string, item string, value double")
    b = spark.createDataFrame([("x", "i", 100.5), ("y", "i", 0.6), ("w", "i", 1.0)], "k string, item string, value double")
    row = quality.accuracy(a, b, ["k", "item"]).first()
    assert (row.n, row.matches) == (2, 1)
    assert {r["column"]: r.filled for r in quality.population(a).collect()} == {"k": 3, "item": 3, "value": 3}
