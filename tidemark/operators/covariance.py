"""Factor covariances as long ``(month, fi, fj, cov)`` tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _complete(rows: DataFrame) -> DataFrame:
    """The months that have every factor, each with every later month whose window holds it."""
    n = rows.select("factor").distinct().count()
    full = rows.groupBy("month").agg(F.count("*").alias("n")).where(F.col("n") == n).select("month")
    return rows.join(full, "month", "left_semi")


def windows(factor_returns: DataFrame, months: int = 60) -> DataFrame:
    """``(month, at, factor, x)``: the returns in the ``months`` months up to every month (equi-join on exploded months)."""
    rows = _complete(factor_returns.select("month", "factor", F.col("factor_return").alias("x")))
    dates = rows.select("month").distinct()
    reach = rows.withColumn("to", F.explode(F.expr(f"transform(sequence(0, {months - 1}), i -> last_day(add_months(month, i)))")))
    return reach.join(dates.withColumnRenamed("month", "to"), "to", "left_semi").select(F.col("to").alias("month"), F.col("month").alias("at"), "factor", "x")


def factor_covariance(factor_returns: DataFrame, months: int = 60, mirror: bool = True) -> DataFrame:
    """Sample covariance over the window of every month with at least two complete dates."""
    w = windows(factor_returns, months)
    a = w.select("month", "at", F.col("factor").alias("fi"), F.col("x").alias("xi"))
    b = w.select("month", "at", F.col("factor").alias("fj"), F.col("x").alias("xj"))
    cov = a.join(b, ["month", "at"]).where("fi <= fj").groupBy("month", "fi", "fj").agg(F.covar_samp("xi", "xj").alias("cov"), F.count("*").alias("n"))
    cov = cov.where("n >= 2").drop("n")
    if not mirror:
        return cov
    pair = lambda a, b: F.struct(F.col(a).alias("fi"), F.col(b).alias("fj"))
    both = F.when(F.col("fi") == F.col("fj"), F.array(pair("fi", "fj"))).otherwise(F.array(pair("fi", "fj"), pair("fj", "fi")))
    return cov.select("month", F.inline(both), "cov")


def pairwise_covariance(returns: DataFrame, least: int = 2) -> DataFrame:
    """Covariance of securities over the dates both have: ``(si, sj, cov, n)`` with si <= sj."""
    rows = returns.where("ret is not null")
    a = rows.select("month", F.col("sec").alias("si"), F.col("ret").alias("x"))
    b = rows.select("month", F.col("sec").alias("sj"), F.col("ret").alias("y"))
    out = a.join(b, "month").where("si <= sj").groupBy("si", "sj").agg(F.covar_samp("x", "y").alias("cov"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def scale_repair(cov: DataFrame, above: float = 1.0, target: float = 0.5) -> DataFrame:
    """Symmetrises, and rescales row and column of every factor whose variance is above ``above`` to ``target``."""
    flipped = cov.select("month", F.col("fj").alias("fi"), F.col("fi").alias("fj"), F.col("cov").alias("other"))
    both = cov.join(flipped, ["month", "fi", "fj"], "left").withColumn("cov", (F.col("cov") + F.coalesce("other", "cov")) / 2).drop("other")
    scale = F.when(F.col("cov") > above, F.sqrt(F.lit(target) / F.col("cov"))).otherwise(1.0)
    diagonal = cov.where("fi = fj").select("month", "fi", scale.alias("s"))
    both = both.join(diagonal.withColumnRenamed("s", "si"), ["month", "fi"]).join(diagonal.withColumnsRenamed({"fi": "fj", "s": "sj"}), ["month", "fj"])
    return both.select("month", "fi", "fj", (F.col("cov") * F.col("si") * F.col("sj")).alias("cov"))


def unit_guard(cov: DataFrame) -> DataFrame:
    """Whole matrices in wrong units: largest variance over 1e4 is divided by 1e4, over 100 by 100."""
    top = F.max(F.when(F.col("fi") == F.col("fj"), F.col("cov"))).over(Window.partitionBy("month"))
    return cov.withColumn("top", top).select("month", "fi", "fj", (F.col("cov") / F.when(F.col("top") > 1e4, 1e4).when(F.col("top") > 100, 100.0).otherwise(1.0)).alias("cov"))


def blend(factor_returns: DataFrame, short: int = 12, long: int = 60, share: float = 0.5, shrink: float = 0.1, floor: float = 1e-8) -> DataFrame:
    """Short and long covariance blended, shrunk to constant correlation, eigenvalues floored: one small matrix a month."""

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="fi", columns="fj", values="cov").sort_index(axis=0).sort_index(axis=1)
        a = m.to_numpy()
        sd = np.sqrt(np.maximum(np.diag(a), 1e-300))
        corr = a / np.outer(sd, sd)
        k = len(a)
        mean = (corr.sum() - np.trace(corr)) / (k * (k - 1)) if k > 1 else 0.0
        goal = np.outer(sd, sd) * (mean + (1 - mean) * np.eye(k))
        values, vectors = np.linalg.eigh((1 - shrink) * a + shrink * goal)
        out = (vectors * np.maximum(values, floor)) @ vectors.T
        i, j = np.indices(out.shape)
        return pd.DataFrame({"month": pdf.month.iloc[0], "fi": m.index.to_numpy()[i.ravel()], "fj": m.columns.to_numpy()[j.ravel()], "cov": out.ravel()})

    a, b = factor_covariance(factor_returns, short), factor_covariance(factor_returns, long).withColumnRenamed("cov", "slow")
    both = a.join(b, ["month", "fi", "fj"]).select("month", "fi", "fj", (share * F.col("cov") + (1 - share) * F.col("slow")).alias("cov"))
    return both.groupBy("month").applyInPandas(repair, "month date, fi string, fj string, cov double")


def asset_covariance(exposures: DataFrame, cov: DataFrame, specific: DataFrame) -> DataFrame:
    """X F X' + D for the securities given: ``(month, si, sj, cov)``."""
    left = exposures.select("month", F.col("sec").alias("si"), F.col("factor").alias("fi"), F.col("exposure").alias("xi"))
    xf = left.join(cov, ["month", "fi"]).groupBy("month", "si", "fj").agg(F.sum(F.col("xi") * F.col("cov")).alias("v"))
    right = exposures.select("month", F.col("sec").alias("sj"), F.col("factor").alias("fj"), F.col("exposure").alias("xj"))
    common = xf.join(right, ["month", "fj"]).groupBy("month", "si", "sj").agg(F.sum(F.col("v") * F.col("xj")).alias("cov"))
    own = specific.select("month", F.col("sec").alias("si"), F.col("sec").alias("sj"), F.col("specific_var").alias("d"))
    return common.join(own, ["month", "si", "sj"], "left").select("month", "si", "sj", (F.col("cov") + F.coalesce("d", F.lit(0.0))).alias("cov"))


def choose_specific(raw: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Smoothed risk where the month has any, raw otherwise: all or nothing by month."""
    have = smoothed.select("month").distinct()
    return smoothed.select("sec", "month", "specific_var").unionByName(raw.join(have, "month", "left_anti").select("sec", "month", "specific_var"))


def historical_covariance(filled: DataFrame, periods: int = 252) -> DataFrame:
    """Annualised covariance of ``filled(sec, mi, ret)``, which has a value for every date: ``(si, sj, cov)`` with si <= sj."""
    return pairwise_covariance(filled.withColumnRenamed("mi", "month")).select("si", "sj", (F.col("cov") * periods).alias("cov"))
