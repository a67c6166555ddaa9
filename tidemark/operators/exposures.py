"""Style, industry and country exposures for every security and month at once.

Panels: ``returns(sec, month, mi, ret, cap)``, ``market(month, mi, market_return)``, ``quarters(sec, mi, fy, fq, income,
sales, book, assets, debt, dividends)`` with ``mi`` the quarter's last month.  A factor is a row (sec, month, factor, exposure).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import finite, trailing, union_all
from tidemark.operators.quantiles import meet, exact_quantiles
from tidemark.runtime import settled


LEVELS = ("sector", "industry", "sub_industry")


def winsor_z(df: DataFrame, value: str, by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``value`` clipped at exact quantiles of its group and standardised with the population deviation (0 where that is 0).

    Groups are months, and factors of a month: few, so their limits and moments go to the rows rather than the rows to them.
    """
    limits = exact_quantiles(df, by, value, [low, high]).withColumnRenamed("q", "_q")
    clipped = df.join(F.broadcast(limits), by).withColumn(value, F.greatest(F.least(F.col(value), F.col("_q")[1]), F.col("_q")[0])).drop("_q")
    moments = clipped.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return clipped.join(F.broadcast(moments), by).withColumn(value, z).drop("_m", "_s")


def _finite(raw: DataFrame, name: str) -> DataFrame:
    return raw.select("sec", "month", F.lit(name).alias("factor"), finite(F.col("x")).alias("exposure")).where("exposure is not null")


def standardise(raw: DataFrame, name: str) -> DataFrame:
    """``(sec, month, x)`` to exposures: finite values, clipped and z-scored within the month."""
    return standardised({name: raw})


def standardised(raw: dict[str, DataFrame]) -> DataFrame:
    """The same for several factors at once, settled before their quantiles are taken."""
    rows = settled(union_all([_finite(df, name) for name, df in raw.items()]), "raw")
    return winsor_z(rows, "exposure", ["factor", "month"]).select("sec", "month", "factor", "exposure")


def size(returns: DataFrame) -> DataFrame:
    return returns.where("cap > 0").select("sec", "month", F.log("cap").alias("x"))


def slope_over(df: DataFrame, x: str, y: str, months: int, least: int) -> DataFrame:
    """Slope of x on y over each security's trailing months, from running sums."""
    w = trailing(Window.partitionBy("sec").orderBy("mi"), months)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n, sx, sy = F.count("*").over(w), F.sum(x).over(w), F.sum(y).over(w)
    sxy, syy = F.sum(F.col(x) * F.col(y)).over(w), F.sum(F.col(y) * F.col(y)).over(w)
    rows = rows.withColumns({"n": n, "sx": sx, "sy": sy, "sxy": sxy, "syy": syy})
    var = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return rows.where(F.col("n") >= least).select("sec", "month", F.when(var > 1e-15, cov / var).alias("x"))


def beta(returns: DataFrame, market: DataFrame, months: int = 60, least: int = 36) -> DataFrame:
    return slope_over(returns.join(market.select("month", "market_return"), "month"), "ret", "market_return", months, least)


def currency_sensitivity(returns: DataFrame, fx: DataFrame, months: int = 60, least: int = 24) -> DataFrame:
    """``fx(month, fx_return)``."""
    return slope_over(returns.join(fx, "month"), "ret", "fx_return", months, least)


def trailing_return(returns: DataFrame, months: int, skip: int, least: int) -> DataFrame:
    """Compounded return of the ``months`` months that end ``skip`` months back, of which ``least`` have a return."""
    w = Window.partitionBy("sec").orderBy("mi").rangeBetween(-(months + skip - 1), -skip)
    rows = returns.where("ret is not null").withColumn("g", 1 + F.col("ret"))
    rows = rows.withColumns({"n": F.count("*").over(w), "p": F.exp(F.sum(F.log(F.when(F.col("g") > 0, F.col("g")))).over(w)), "dead": F.min("g").over(w) <= 0})
    return rows.where(F.col("n") >= least).select("sec", "month", F.when(F.col("dead"), -1.0).otherwise(F.col("p") - 1).alias("x"))


def momentum(returns: DataFrame, months: int = 12, skip: int = 1, least: int = 11) -> DataFrame:
    """The return ``skip`` months back, which must be there, compounded with the ``months`` months before it, of which at
    least ``least`` have a return."""
    last = trailing_return(returns, 1, skip, 1).withColumnRenamed("x", "latest")
    older = trailing_return(returns, months, skip + 1, least)
    return older.join(last, ["sec", "month"]).select("sec", "month", ((1 + F.col("x")) * (1 + F.col("latest")) - 1).alias("x"))


def blended_momentum(returns: DataFrame) -> DataFrame:
    """Horizons 1, 3, 6 and 12 months weighted .05, .15, .30 and .50; all must be there."""
    parts = [trailing_return(returns, m, 1, max(1, m - 1)).withColumn("w", F.lit(w)) for m, w in ((1, 0.05), (3, 0.15), (6, 0.3), (12, 0.5))]
    return union_all(parts).groupBy("sec", "month").agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.count("x").alias("n")).where("n = 4").drop("n")


def as_of(returns: DataFrame, quarters: DataFrame, lag_months: int = 3, carried: list[str] = ["month", "cap"], known_only: bool = True) -> DataFrame:
    """Each security-month with its latest quarter known by then (``lag_months`` after the quarter's end), and the columns
    ``carried`` of the returns; months before the first quarter only without ``known_only``.

    A union in time order and a last non-null value: one shuffle by security, no range join.
    """
    q = quarters.withColumn("at", F.col("mi") + lag_months)
    facts = F.struct(*[F.col(c) for c in q.columns if c not in ("sec", "at")])
    left = returns.select("sec", F.col("mi").alias("at"), F.lit(1).alias("o"), F.struct(*carried).alias("r"), F.lit(None).cast(q.select(facts.alias("f")).schema["f"].dataType).alias("f"))
    right = q.select("sec", "at", F.lit(0).alias("o"), F.lit(None).cast(left.schema["r"].dataType).alias("r"), facts.alias("f"))
    w = Window.partitionBy("sec").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("f", F.last("f", ignorenulls=True).over(w)).where("o = 1")
    both = both.select("sec", "r.*", "f.*")
    return both.where("mi is not null") if known_only else both


def with_history(quarters: DataFrame) -> DataFrame:
    """Adds trailing-four-quarter income, last year's sales and the deviation of the last eight incomes."""
    w = Window.partitionBy("sec").orderBy("mi")
    four, eight = w.rowsBetween(-3, 0), w.rowsBetween(-7, 0)
    ttm = F.when(F.count("income").over(four) == 4, F.sum("income").over(four))
    sales4 = F.when(F.count("sales").over(four) == 4, F.sum("sales").over(four))
    q = quarters.withColumns({"income_ttm": ttm, "sales_ttm": sales4, "income_sd": F.when(F.count("income").over(eight) >= 4, F.stddev_samp("income").over(eight))})
    return q.withColumn("sales_before", F.lag("sales_ttm", 4).over(w))


#: Styles that come from a row of the panel alone.
RATIOS = {
    "size": lambda: F.when(F.col("cap") > 0, F.log("cap")),
    "earnings_yield": lambda: F.when(F.col("cap") > 0, F.col("income_ttm") / F.col("cap")),
    "book_to_price": lambda: F.when((F.col("cap") > 0) & (F.col("book") > 0), F.log(F.col("book") / F.col("cap"))),
    "growth": lambda: F.when(F.col("sales_before") != 0, F.col("sales_ttm") / F.col("sales_before") - 1),
    "earnings_variability": lambda: -F.col("income_sd"),
    "leverage": lambda: F.when(F.col("assets") > 0, F.col("debt") / F.col("assets")),
    "dividend_yield": lambda: F.when((F.col("cap") > 0) & (F.col("dividends") >= 0), F.col("dividends") / F.col("cap")),
}


def ratio(panel: DataFrame, x: Column) -> DataFrame:
    return panel.select("sec", "month", x.alias("x")).where("x is not null")


def earnings_yield(panel: DataFrame) -> DataFrame:
    return ratio(panel, RATIOS["earnings_yield"]())


def book_to_price(panel: DataFrame) -> DataFrame:
    return ratio(panel, RATIOS["book_to_price"]())


def growth(panel: DataFrame) -> DataFrame:
    return ratio(panel, RATIOS["growth"]())


def earnings_variability(panel: DataFrame) -> DataFrame:
    return ratio(panel, RATIOS["earnings_variability"]())


def leverage(panel: DataFrame) -> DataFrame:
    return ratio(panel, RATIOS["leverage"]())


def dividend_yield(panel: DataFrame) -> DataFrame:
    return ratio(panel, RATIOS["dividend_yield"]())


def industry(returns: DataFrame, security: DataFrame) -> DataFrame:
    """One-hot membership at the levels sector, industry and sub-industry; unknown is ``Unclassified``."""
    rows = returns.select("sec", "month").join(security.select("sec", *LEVELS), "sec", "left")
    level = lambda name: F.struct(F.lit(name).alias("level"), F.coalesce(F.col(name), F.lit("Unclassified")).alias("label"))
    rows = rows.select("sec", "month", F.inline(F.array(*map(level, LEVELS))))
    return rows.select("sec", "month", F.concat_ws(":", "level", "label").alias("factor"), F.lit(1.0).alias("exposure"))


def country(returns: DataFrame, label: str = "US") -> DataFrame:
    return returns.select("sec", "month", F.lit(f"country:{label}").alias("factor"), F.lit(1.0).alias("exposure"))


def combined(styles: DataFrame, returns: DataFrame, security: DataFrame) -> DataFrame:
    """Imputed style, industry and country exposures in one table, the country under one label."""
    parts = [impute(styles, returns, security).drop("flags"), industry(returns, security), country(returns)]
    return union_all([x.select("sec", "month", "factor", "exposure") for x in parts])


def impute(exposures: DataFrame, returns: DataFrame, security: DataFrame) -> DataFrame:
    """Fills every (security, factor) of a month: industry median, else the month's median, else zero; flags what it filled."""
    wide = exposures.groupBy("sec", "month").agg(F.map_from_entries(F.collect_list(F.struct("factor", "exposure"))).alias("own"))
    asked = exposures.groupBy("month").agg(F.collect_set("factor").alias("factors"))  # a row a month
    grid = returns.select("sec", "month").distinct().join(wide, ["sec", "month"], "left").join(F.broadcast(asked), "month").join(security.select("sec", "industry"), "sec", "left")
    full = grid.select("sec", "month", "industry", "own", F.explode("factors").alias("factor")).select("sec", "month", "factor", "industry", F.col("own")[F.col("factor")].alias("exposure"))
    full = settled(full, "grid")
    middle = lambda by, name: F.broadcast(exact_quantiles(full, by, "exposure", [0.5]).select(*by, F.col("q")[0].alias(name)))
    full = meet(full, middle(["month", "factor", "industry"], "mi"), ["month", "factor", "industry"], "left")
    full = full.join(middle(["month", "factor"], "mg"), ["month", "factor"], "left")
    value = F.coalesce("exposure", "mi", "mg", F.lit(0.0))
    flag = F.when(F.col("exposure").isNotNull(), F.lit(None)).when(F.coalesce("mi", F.lit(0.0)) != 0, "imputed=industry").otherwise("imputed=global")
    return full.select("sec", "month", "factor", value.alias("exposure"), flag.alias("flags"))


def coverage(imputed: DataFrame, warn_above: float = 0.3) -> DataFrame:
    out = imputed.groupBy("factor").agg(F.count("*").alias("total"), F.count_if(F.col("flags").ilike("%imputed%")).alias("imputed"))
    return out.withColumn("share", F.col("imputed") / F.col("total")).withColumn("warn", F.col("share") > warn_above)


def orthogonalise(exposures: DataFrame, base: str = "size") -> DataFrame:
    """Residual of every other factor on ``base`` within the month, standardised again."""
    x = exposures.where(F.col("factor") == base).select("sec", "month", F.col("exposure").alias("b"))
    rows = exposures.where(F.col("factor") != base).join(x, ["sec", "month"])
    fit = rows.groupBy("month", "factor").agg(F.regr_slope("exposure", "b").alias("s"), F.regr_intercept("exposure", "b").alias("i"))
    rows = rows.join(fit, ["month", "factor"]).withColumn("r", F.col("exposure") - F.coalesce(F.col("i") + F.col("s") * F.col("b"), F.lit(0.0)))
    w = Window.partitionBy("month", "factor")
    rows = rows.withColumns({"m": F.avg("r").over(w), "sd": F.stddev_pop("r").over(w)})
    return rows.select("sec", "month", "factor", F.when(F.col("sd") > 1e-12, (F.col("r") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("exposure"))


def style_exposures(returns: DataFrame, market: DataFrame, panel: DataFrame, fx: DataFrame) -> DataFrame:
    """All ten style factors of all months in one table."""
    raw = {
        "size": size(returns), "beta": beta(returns, market), "momentum": momentum(returns), "earnings_yield": earnings_yield(panel),
        "book_to_price": book_to_price(panel), "growth": growth(panel), "earnings_variability": earnings_variability(panel),
        "leverage": leverage(panel), "dividend_yield": dividend_yield(panel), "currency_sensitivity": currency_sensitivity(returns, fx),
    }
    return standardised(raw)
