"""Portfolio risk from exposures, factor covariances and specific variances."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SPECIFIC = 0.10


def cap_weights(returns: DataFrame, top: int | None = None) -> DataFrame:
    """``(month, sec, weight)`` by capitalisation, of the ``top`` largest of each month."""
    rows = returns.where("cap > 0")
    if top is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("cap"), "sec"))).where(F.col("n") <= top)
    return rows.select("month", "sec", (F.col("cap") / F.sum("cap").over(Window.partitionBy("month"))).alias("weight"))


def normalise(weights: DataFrame, by: list[str]) -> DataFrame:
    return weights.withColumn("weight", F.try_divide("weight", F.sum("weight").over(Window.partitionBy(*by))))


def factor_exposure(weights: DataFrame, exposures: DataFrame) -> DataFrame:
    return weights.join(exposures, ["month", "sec"]).groupBy("month", "factor").agg(F.sum(F.col("weight") * F.col("exposure")).alias("x"))


def summary(weights: DataFrame, exposures: DataFrame, cov: DataFrame, specific: DataFrame) -> DataFrame:
    """Rows by month: each factor's exposure and variance contribution x (F x), then specific and total."""
    x = factor_exposure(weights, exposures)
    fx = cov.join(x.select("month", F.col("factor").alias("fj"), F.col("x").alias("xj")), ["month", "fj"]).groupBy("month", "fi").agg(F.sum(F.col("cov") * F.col("xj")).alias("v"))
    parts = x.join(fx.withColumnRenamed("fi", "factor"), ["month", "factor"], "left").select("month", F.col("factor").alias("item"), F.col("x").alias("exposure"), (F.col("x") * F.coalesce("v", F.lit(0.0))).alias("variance"))
    own = weights.join(specific, ["month", "sec"]).groupBy("month").agg(F.sum(F.col("weight") * F.col("weight") * F.col("specific_var")).alias("variance"))
    own = own.select("month", F.lit("specific").alias("item"), F.lit(None).cast("double").alias("exposure"), "variance")
    rows = parts.unionByName(own)  # each row counts for itself and for the total
    none = F.lit(None).cast("double")
    each = F.array(F.struct("item", "exposure"), F.struct(F.lit("total").alias("item"), none.alias("exposure")))
    return rows.select("month", "variance", F.inline(each)).groupBy("month", "item").agg(F.max("exposure").alias("exposure"), F.sum("variance").alias("variance"))


def model_risk(summary_rows: DataFrame) -> DataFrame:
    """Factor, specific and total variance with monthly and annual volatility."""
    v = lambda name: F.sum(F.when(F.col("item") == name, F.col("variance")))
    out = summary_rows.groupBy("month").agg(v("specific").alias("specific_variance"), v("total").alias("total_variance"))
    out = out.withColumn("factor_variance", F.col("total_variance") - F.coalesce("specific_variance", F.lit(0.0)))
    vol = F.sqrt(F.greatest("total_variance", F.lit(0.0)))
    return out.withColumn("monthly_vol", vol).withColumn("annual_vol", vol * math.sqrt(12))


def top_contributions(summary_rows: DataFrame, n: int = 10) -> DataFrame:
    """The n largest variance contributions of each month; specific and total rows are none."""
    rows = summary_rows.where("item not in ('specific', 'total')")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("variance"), "item"))).where(F.col("rank") <= n)


def top_exposures(weights: DataFrame, exposures: DataFrame, n: int = 10) -> DataFrame:
    """The n largest |x| of each month."""
    x = factor_exposure(weights, exposures)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(F.desc(F.abs("x")), "factor"))).where(F.col("rank") <= n)


def realised_tracking_error(weights: DataFrame, returns: DataFrame, benchmark: DataFrame, periods: int = 12) -> DataFrame:
    """``weights(portfolio, sec, weight)`` held constant against ``benchmark(month, bench)``, over the months every member has."""
    members = weights.groupBy("portfolio").agg(F.count("*").alias("k"))
    daily = weights.join(returns.where("ret is not null"), "sec").groupBy("portfolio", "month").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"), F.count("*").alias("c"))
    daily = daily.join(members, "portfolio").where("c = k").join(benchmark, "month").withColumn("active", F.col("r") - F.col("bench"))
    return daily.groupBy("portfolio").agg(
        F.count("*").alias("n"), (F.stddev_samp("active") * math.sqrt(periods)).alias("tracking_error"), F.avg("active").alias("mean_active"),
        (F.product(1 + F.col("r")) - 1).alias("portfolio_return"), (F.product(1 + F.col("bench")) - 1).alias("benchmark_return"),
    )


def ex_ante_tracking_error(weights: DataFrame, benchmark: DataFrame, exposures: DataFrame, cov: DataFrame) -> DataFrame:
    """sqrt(x'Fx) of active exposures: ``(month, tracking_error)``."""
    active = weights.unionByName(benchmark.withColumn("weight", -F.col("weight"))).groupBy("month", "sec").agg(F.sum("weight").alias("weight"))
    x = factor_exposure(active, exposures)
    a, b = x.select("month", F.col("factor").alias("fi"), F.col("x").alias("xi")), x.select("month", F.col("factor").alias("fj"), F.col("x").alias("xj"))
    q = cov.join(a, ["month", "fi"]).join(b, ["month", "fj"]).groupBy("month").agg(F.sum(F.col("cov") * F.col("xi") * F.col("xj")).alias("q"))
    return q.select("month", F.sqrt(F.greatest("q", F.lit(0.0))).alias("tracking_error"))


def risk_components(ids: DataFrame, exposures: DataFrame, specific: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Exposures (0 where absent) and specific variance (a default where absent) for the securities asked for.

    ``factors(month, factor)`` are those of the exposures, unless given.
    """
    grid = ids.join(exposures.select("month", "factor").distinct() if factors is None else factors, "month")
    out = grid.join(exposures, ["month", "sec", "factor"], "left").join(specific.select("month", "sec", "specific_var"), ["month", "sec"], "left")
    return out.select("month", "sec", "factor", F.coalesce("exposure", F.lit(0.0)).alias("exposure"), F.coalesce("specific_var", F.lit(DEFAULT_SPECIFIC)).alias("specific_var"))


def blended_market(internal: DataFrame, external: DataFrame) -> DataFrame:
    """External market return where there is one, the internal one otherwise."""
    return internal.join(external.select("month", F.col("market_return").alias("ext")), "month", "left").select("month", F.coalesce("ext", "market_return").alias("market_return"), F.col("ext").isNotNull().alias("external"))
