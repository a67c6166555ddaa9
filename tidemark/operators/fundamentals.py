"""Quarterly and annual feature tables from year-to-date facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fiscal_quarter, fiscal_year, preferred


def dedup_standard(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the standard format first, then the consolidated one."""
    return preferred(rows, keys, (F.col("datafmt") == "STD").desc(), (F.col("consol") == "C").desc(), F.col("datafmt").asc_nulls_last(), F.col("consol").asc_nulls_last())


def fiscal_calendar(rows: DataFrame, date: str = "d", year_end_month: str = "fyr") -> DataFrame:
    m, end = F.month(date), F.col(year_end_month)
    return rows.withColumns({"fy": fiscal_year(F.year(date), m, end), "fq": fiscal_quarter(m, end)})


def quarter_from_ytd(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Quarter = year to date less the one before in the fiscal year; the first quarter is the year to date."""
    w = Window.partitionBy("sec", "fy").orderBy("fq")
    x = F.col(value) - F.lag(value).over(w)
    return rows.withColumn(out, F.when(F.col("fq") == 1, F.col(value)).otherwise(x))


def trailing_four(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of the last four quarters, null with fewer than four values."""
    w = Window.partitionBy("sec").orderBy("fy", "fq").rowsBetween(-3, 0)
    return rows.withColumn(out, F.when(F.count(value).over(w) == 4, F.sum(value).over(w)))


def quarterly_features(rows: DataFrame) -> DataFrame:
    """``(sec, d, fyr, ytd, …)`` to fiscal calendar, quarter and trailing-four values."""
    return trailing_four(quarter_from_ytd(fiscal_calendar(rows), "ytd", "quarter"), "quarter", "ttm")


def ytd_fold(facts: DataFrame) -> DataFrame:
    """Quarterly values of ``(company, item, fy, fq, value, period)`` where the period kind may vary by quarter.

    The quarters of a fiscal year are folded in order: a year-to-date value gives itself less the running total; a quarter's
    own value, or an instant, stands and is added to the total; an unknown kind counts as year to date if it is at least 1.3
    times the running total, otherwise as a quarter.  A yearly value in quarter four without earlier quarters is dropped.
    """
    rows = facts.groupBy("company", "item", "fy").agg(F.sort_array(F.collect_list(F.struct("fq", "value", "period"))).alias("q"))  # at most a few rows
    start = F.struct(F.lit(0.0).alias("ytd"), F.lit(0).alias("n"), F.array().cast("array<struct<fq:int,value:double>>").alias("out"))

    def step(acc, x):
        known = x["period"]
        is_ytd = known.startswith("YTD") | ((known == "UNKNOWN") & (acc["n"] > 0) & (F.abs(x["value"]) >= 1.3 * F.abs(acc["ytd"])))
        first = acc["n"] == 0
        drop = (known == "YTD_ANNUAL") & first & (x["fq"] == 4)
        value = F.when(is_ytd & ~first, x["value"] - acc["ytd"]).otherwise(x["value"])
        total = F.when(is_ytd | first, x["value"]).otherwise(acc["ytd"] + x["value"])
        done = F.struct(total.alias("ytd"), (acc["n"] + 1).alias("n"), F.array_append(acc["out"], F.struct(x["fq"].alias("fq"), value.alias("value"))).alias("out"))
        return F.when(drop, acc).otherwise(done)

    return rows.select("company", "item", "fy", F.inline(F.aggregate("q", start, step)["out"]))


def annual_features(returns: DataFrame, annual: DataFrame) -> DataFrame:
    """Returns with the preferred annual row ``(sec, fy, datafmt, consol, ...)`` of the month's calendar year, if any."""
    return returns.withColumn("fy", F.year("month")).join(dedup_standard(annual, ["sec", "fy"]), ["sec", "fy"], "left")


def annual_growth(rows: DataFrame, value: str = "sales") -> DataFrame:
    """Growth over the fiscal year before, from the latest row of each year ``(sec, fy, mi, ...)``: ``(sec, fy, growth)``."""
    year = rows.groupBy("sec", "fy").agg(F.max_by(value, "mi").alias("v"))
    w = Window.partitionBy("sec").orderBy("fy")
    out = year.withColumns({"b": F.lag("v").over(w), "p": F.lag("fy").over(w)}).where("p = fy - 1")
    return out.select("sec", "fy", (F.try_divide("v", "b") - 1).alias("growth"))


def multi_horizon_growth(annual: DataFrame, weights: tuple = ((1, 0.5), (3, 0.3), (5, 0.2))) -> DataFrame:
    """Compound yearly growth over several horizons of ``annual(sec, fy, value)``, weighted over the horizons there are."""
    now = annual.where("value > 0")
    each = F.inline(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in weights)))
    ask = now.select("sec", "fy", "value", each).withColumn("then", F.col("fy") - F.col("h"))
    hit = ask.join(now.select("sec", F.col("fy").alias("then"), F.col("value").alias("old")), ["sec", "then"])
    rate = F.pow(F.col("value") / F.col("old"), 1 / F.col("h")) - 1
    return hit.groupBy("sec", "fy").agg((F.sum(rate * F.col("w")) / F.sum("w")).alias("growth"), F.count("*").alias("horizons"))


def book_equity(rows: DataFrame) -> DataFrame:
    """Book equity of annual rows: stockholders' equity, else common plus preferred, else assets less liabilities; plus
    deferred tax, less the first preferred value there is.  Columns seq, ceq, at, lt, pstk, pstkl, pstkrv, txditc."""
    equity = F.coalesce("seq", F.col("ceq") + F.coalesce("pstk", F.lit(0.0)), F.col("at") - F.col("lt"))
    return rows.withColumn("book", equity + F.coalesce("txditc", F.lit(0.0)) - F.coalesce("pstkrv", "pstkl", "pstk", F.lit(0.0)))


def without_codes(rows: DataFrame, code: str, low: str, high: str) -> DataFrame:
    """Leaves out rows whose code begins with a prefix between two; a null code stays."""
    return rows.where(~F.coalesce(F.substring(code, 1, len(low)).between(low, high), F.lit(False)))
