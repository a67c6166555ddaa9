"""Monthly prices, returns and the market from daily prices ``(sec, d, price, cap)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import latest, month_index, preferred


def monthly_prices(daily: DataFrame) -> DataFrame:
    """Last traded row of every security and month; ``month`` is the calendar month end, ``mi`` its index."""
    rows = daily.groupBy("sec", F.last_day("d").alias("month"))
    last = rows.agg(F.max("d").alias("month_end_date"), F.max_by("price", "d").alias("price"), F.max_by("cap", "d").alias("cap"))  # plain values: a hash aggregation, no sort
    return last.withColumn("mi", month_index(F.col("month")))


def monthly_returns(monthly: DataFrame) -> DataFrame:
    """Return on the security's previous month with a price (a gap gives a return over several months)."""
    before = F.lag("price").over(Window.partitionBy("sec").orderBy("month"))
    return monthly.withColumn("ret", F.try_divide("price", before) - 1)


def market_returns(returns: DataFrame) -> DataFrame:
    """Capitalisation-weighted return of each month."""
    rows = returns.where("ret is not null and cap > 0")
    out = rows.groupBy("month", "mi").agg(F.try_divide(F.sum(F.col("ret") * F.col("cap")), F.sum("cap")).alias("market_return"), F.sum("cap").alias("total_cap"), F.count("*").alias("n"))
    return out


def latest_mapping(daily: DataFrame, security: DataFrame) -> DataFrame:
    """The latest price row of each security with its names."""
    return latest(daily, ["sec"], ["d"]).join(security, "sec")


def primary_listing(listings: DataFrame) -> DataFrame:
    """One listing ``(company, exchange, kind, issue, price, d)`` per company: common stock first, then main exchanges."""
    kind = F.when(F.col("kind") == "0", 0).when(F.col("kind") == "1", 1).otherwise(2)
    exchange = F.when(F.col("exchange").isin("N", "A", "Q"), 0).otherwise(1)
    return preferred(listings, ["company"], kind, exchange, F.col("issue"))


def coverage(returns: DataFrame) -> DataFrame:
    """First and last month and number of returns of each security."""
    return returns.where("ret is not null").groupBy("sec").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("n"))


def unified_returns(history: DataFrame, current: DataFrame) -> DataFrame:
    """``(sec, month, ret)`` of both sources; where both have a row, history's stands."""
    both = history.select("sec", "month", "ret", F.lit(0).alias("p")).unionByName(current.select("sec", "month", "ret", F.lit(1).alias("p")))
    return both.groupBy("sec", "month").agg(F.min_by("ret", "p").alias("ret"))


def cumulative(returns: DataFrame, by: str = "sec") -> DataFrame:
    """Growth of one unit; a total loss stays at zero and a return below -1 turns the sign."""
    w = Window.partitionBy(by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    g = 1 + F.col("ret")
    size = F.exp(F.sum(F.log(F.when(g != 0, F.abs(g)))).over(w))
    sign = F.when(F.max((g == 0).cast("int")).over(w) == 1, 0.0).otherwise(1 - 2 * F.pmod(F.sum((g < 0).cast("int")).over(w), F.lit(2)))
    return returns.where("ret is not null").withColumn("curve", F.coalesce(size, F.lit(0.0)) * sign)


def on_date(requests: DataFrame, daily: DataFrame) -> DataFrame:
    """``requests(sec, d)`` with the price of exactly that day, null where there is none."""
    return requests.join(daily.select("sec", "d", "price"), ["sec", "d"], "left")


def weekdays(rows: DataFrame, start, end, date: str = "d") -> DataFrame:
    """Rows of the days Monday to Friday between two dates."""
    day = F.col(date)
    return rows.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.weekday(day) < 5))


def market_equity(monthly: DataFrame) -> DataFrame:
    """Monthly stock rows ``(sec, month, price, shares, ret_pct)``: market equity in full, the return as a share, equity a month before."""
    rows = monthly.withColumns({"me": F.abs("price") * F.col("shares"), "ret": F.col("ret_pct") / 100})
    return rows.withColumn("me_before", F.lag("me").over(Window.partitionBy("sec").orderBy("month"))).select("sec", "month", "me", "ret", "me_before")


def filled(returns: DataFrame) -> DataFrame:
    """``(sec, mi, ret)`` for every security and month that any security has: gaps take the last value before, else the
    first one after, else zero."""
    rows = returns.where("ret is not null").select("sec", "mi", "ret")
    span = rows.agg(F.min("mi").alias("a"), F.max("mi").alias("b")).first()
    if span.a is None:
        return rows
    months = F.explode(F.sequence(F.lit(span.a), F.lit(span.b)))
    grid = returns.select("sec").distinct().withColumn("mi", months).join(rows.select("mi").distinct(), "mi", "left_semi")
    w = Window.partitionBy("sec").orderBy("mi")
    before = F.last("ret", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("ret", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return grid.join(rows, ["sec", "mi"], "left").select("sec", "mi", F.coalesce(before, after, F.lit(0.0)).alias("ret"))
