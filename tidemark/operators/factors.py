"""Double-sorted factor portfolios.

``panel(sec, fy, month, ret, exchange, me, bm, op, inv)``: the formation panel, returns of the twelve months after formation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import band
from tidemark.operators.quantiles import exact_quantiles
from tidemark.runtime import settled

SORTS = {"bm": "HML", "op": "RMW", "inv": "CMA"}


def formation_panel(returns: DataFrame, annual: DataFrame, security: DataFrame) -> DataFrame:
    """Returns July(t) to June(t+1) with June market equity of t and fundamentals of fiscal year t - 1.

    ``annual(sec, fy, book, op, inv)``; the formation year of a return is the year six months before its month.
    """
    rows = returns.withColumn("fy", F.year(F.add_months("month", -6)))
    june = returns.where(F.month("month") == 6).select("sec", F.year("month").alias("fy"), F.col("cap").alias("me"))
    december = returns.where(F.month("month") == 12).select("sec", (F.year("month") + 1).alias("fy"), F.col("cap").alias("me_dec"))
    known = annual.withColumn("fy", F.col("fy") + 1)
    out = rows.join(june, ["sec", "fy"]).join(december, ["sec", "fy"], "left").join(known, ["sec", "fy"], "left").join(security.select("sec", "exchange"), "sec")
    return out.select("sec", "fy", "month", "ret", "exchange", "me", F.try_divide("book", "me_dec").alias("bm"), "op", "inv")


def annual_fundamentals(quarters: DataFrame) -> DataFrame:
    """Book equity, operating profit over book and investment rate per fiscal year from quarterly rows."""
    from pyspark.sql import Window

    year = quarters.groupBy("sec", "fy").agg(F.max_by("book", "mi").alias("book"), F.sum("income").alias("income"), F.max_by("assets", "mi").alias("assets"))
    before = F.lag("assets", 1).over(Window.partitionBy("sec").orderBy("fy"))
    year = year.withColumn("before", before)
    return year.select("sec", "fy", "book", F.when(F.col("book") > 0, F.col("income") / F.col("book")).alias("op"), F.try_divide(F.col("assets") - F.col("before"), F.col("before")).alias("inv"))


def breakpoints(panel: DataFrame, exchange: str, least: int = 10) -> DataFrame:
    """Median size and 30/70 % points of each sort, from one exchange's names only."""
    names = settled(panel.where(F.col("exchange") == exchange).groupBy("fy", "sec").agg(*(F.min_by(c, "month").alias(c) for c in ("me", *SORTS))), "names")
    out = names.groupBy("fy").agg(F.count("*").alias("n"))
    for c, ps in (("me", [0.5]), *((c, [0.3, 0.7]) for c in SORTS)):
        own = names.where("bm > 0") if c == "bm" else names
        out = out.join(exact_quantiles(own, ["fy"], c, ps).withColumnRenamed("q", f"_{c}"), "fy", "left")
    out = out.select("fy", "n", F.col("_me")[0].alias("size"), *(F.col(f"_{c}").alias(c) for c in SORTS))
    return out.where(F.col("n") >= least).select("fy", "size", *(F.col(c)[i].alias(f"{c}_{p}") for c in SORTS for i, p in ((0, "low"), (1, "high"))))


def assign(panel: DataFrame, points: DataFrame) -> DataFrame:
    """The size group and the three bands of every name and formation year."""
    out = panel.join(points, "fy").withColumn("size_group", F.when(F.col("me") <= F.col("size"), "S").when(F.col("me").isNotNull(), "B"))
    for c in SORTS:
        out = out.withColumn(f"{c}_group", band(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high"), ("L", "M", "H")))
    return out


def cell_returns(assigned: DataFrame) -> DataFrame:
    """Value-weighted return of every cell and month: (month, sort, size_group, band, ret)."""
    sorts = F.array(*(F.struct(F.lit(c).alias("sort"), F.col(f"{c}_group").alias("band")) for c in SORTS))
    rows = assigned.select("month", "size_group", "ret", "me", F.inline(sorts)).where("size_group is not null and band is not null and ret is not null")
    return rows.groupBy("month", "sort", "size_group", "band").agg(F.try_divide(F.sum(F.col("ret") * F.col("me")), F.sum("me")).alias("ret"))


def factor_returns(cells: DataFrame) -> DataFrame:
    """SMB, HML, RMW and CMA by month; a month without one of the cells it needs is null."""
    r = lambda sort, s, b: F.max(F.when((F.col("sort") == sort) & (F.col("size_group") == s) & (F.col("band") == b), F.col("ret")))
    mean = lambda *x: sum(x[1:], x[0]) / len(x)
    small_big = {c: mean(*(r(c, "S", b) for b in "LMH")) - mean(*(r(c, "B", b) for b in "LMH")) for c in SORTS}
    spread = {c: mean(r(c, "S", "H"), r(c, "B", "H")) - mean(r(c, "S", "L"), r(c, "B", "L")) for c in SORTS}
    return cells.groupBy("month").agg(
        mean(*small_big.values()).alias("SMB"), spread["bm"].alias("HML"), spread["op"].alias("RMW"), (-spread["inv"]).alias("CMA")
    )


def combine(ours: DataFrame, official: DataFrame, on: list[str]) -> DataFrame:
    """Complete rows of both series side by side (the official ones with the suffix _official)."""
    other = official.select("month", *(F.col(c).alias(f"{c}_official") for c in on))
    return ours.select("month", *on).join(other, "month").dropna()


def correlations(combined: DataFrame, on: list[str]) -> DataFrame:
    return combined.agg(*(F.corr(c, f"{c}_official").alias(c) for c in on)).unpivot([], on, "factor", "corr")


def formation_range(panel: DataFrame) -> DataFrame:
    """First and last formation year of the panel."""
    return panel.agg(F.min("fy").alias("first"), F.max("fy").alias("last"))


def largest_names(panel: DataFrame, n: int) -> DataFrame:
    """The n names with the largest market equity in any month."""
    return panel.groupBy("sec").agg(F.max("me").alias("me")).orderBy(F.desc("me"), "sec").limit(n)
