"""Long/short backtests: candidate sets, trailing covariances and one small optimisation per rebalance date."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import interior


def deciles(scores: DataFrame) -> DataFrame:
    """Adds ``decile`` (1 best) to ``(month, sec, score)``."""
    return scores.withColumn("decile", F.ntile(10).over(Window.partitionBy("month").orderBy(F.desc("score"), "sec")))


def legs(scores: DataFrame, n: int) -> DataFrame:
    """The n best (side long) and n worst (side short) of each month; a name is in one leg only."""
    up = Window.partitionBy("month").orderBy(F.desc("score"), "sec")
    down = Window.partitionBy("month").orderBy("score", F.desc("sec"))
    rows = scores.withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)})
    side = F.when(F.col("a") <= n, "long").when(F.col("b") <= n, "short")
    return rows.withColumn("side", side).where("side is not null").select("month", "sec", "score", "side")


def decile_legs(scores: DataFrame, long: tuple = (1, 2), short: tuple = (9, 10), members: DataFrame | None = None) -> DataFrame:
    """Names of the ``long`` and ``short`` deciles of each month, among ``members(month, sec)`` if given."""
    rows = deciles(scores.join(members.select("month", "sec").distinct(), ["month", "sec"], "left_semi") if members is not None else scores)
    side = F.when(F.col("decile").isin(*long), "long").when(F.col("decile").isin(*short), "short")
    return rows.withColumn("side", side).where("side is not null").select("month", "sec", "score", "side")


def histories(chosen: DataFrame, returns: DataFrame, months: int = 36, least: int = 12) -> DataFrame:
    """Returns of the chosen names in the ``months`` months before each date: exploded months and an equi-join."""
    wanted = chosen.withColumn("at", F.explode(F.expr(f"transform(sequence(1, {months}), i -> last_day(add_months(month, -i)))")))
    rows = wanted.join(returns.where("ret is not null").select("sec", F.col("month").alias("at"), "ret"), ["sec", "at"])
    n = F.count("*").over(Window.partitionBy("month", "sec"))
    return rows.withColumn("n", n).where(F.col("n") >= least).drop("n")


WEIGHTS = "month date, sec long, weight double, residual double"


class Panel(NamedTuple):
    """One date's names (sorted), their side and score, and their returns: names x dates, with what is there."""

    names: np.ndarray
    long: np.ndarray
    score: np.ndarray
    dates: np.ndarray
    values: np.ndarray
    there: np.ndarray


def _rows(history: DataFrame, *more: str) -> DataFrame:
    """A row a name with its dates (days since 1970) and returns as arrays: a date's panel takes 16 bytes a return."""
    at = F.sort_array(F.collect_list(F.struct(F.unix_date("at").alias("at"), F.col("ret").cast("double").alias("ret"), *more)))
    own = F.min(F.struct("side", F.col("score").cast("double").alias("score")))
    rows = history.where("ret is not null").groupBy("month", "sec").agg(at.alias("x"), own.alias("own"))
    return rows.select("month", "sec", "own.side", "own.score", "x.at", "x.ret", *(f"x.{c}" for c in more))


def _panel(pdf: pd.DataFrame) -> Panel:
    pdf = pdf.sort_values("sec")
    at, ret = np.concatenate(pdf["at"].to_list()), np.concatenate(pdf.ret.to_list())
    dates, column = np.unique(at, return_inverse=True)
    row = np.repeat(np.arange(len(pdf)), pdf["at"].map(len))
    n, values = np.zeros((len(pdf), len(dates))), np.zeros((len(pdf), len(dates)))
    np.add.at(n, (row, column), 1.0)
    np.add.at(values, (row, column), ret)
    return Panel(pdf.sec.to_numpy(), (pdf.side == "long").to_numpy(), pdf.score.to_numpy(float), dates, values / np.maximum(n, 1.0), n > 0)


def covariance_parts(panel: Panel) -> tuple[list, np.ndarray]:
    """Sample covariances over the dates that both names of a pair have (0 where there are fewer than two), made positive
    semidefinite by dropping negative eigenvalues, as ``parts`` and ``root`` of ``interior.Factored``.

    Names with the same dates share a block.  Their returns are an orthonormal base times a few rows; the covariance is that of
    those rows, of which there are at most as many as dates for each set of dates, and it has the same eigenvalues.
    """
    held, kind = np.unique(panel.there, axis=0, return_inverse=True)
    mean = panel.values.sum(1) / np.maximum(panel.there.sum(1), 1)
    centred = np.where(panel.there, panel.values - mean[:, None], 0.0)
    order = np.argsort(kind.ravel(), kind="stable")
    parts, short, of = [], [], []
    for k, rows in enumerate(np.split(order, np.cumsum(np.bincount(kind.ravel(), minlength=len(held)))[:-1])):
        base, rest = np.linalg.qr(centred[rows])
        parts.append((rows, base))
        short.append(rest)
        of += [k] * len(rest)
    short, of, held = np.vstack(short), np.array(of), held.astype(float)
    n = (held @ held.T)[np.ix_(of, of)]
    across = (short @ held.T)[:, of]
    q = np.where(n >= 2, (short @ short.T - across * across.T / np.maximum(n, 1)) / np.maximum(n - 1, 1), 0.0)
    values, vectors = np.linalg.eigh((q + q.T) / 2)
    real = values > 1e-15 * max(values.max(initial=0.0), 0.0)
    return parts, vectors[:, real] * np.sqrt(values[real])


def covariance(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    """Names and the whole matrix of ``covariance_parts`` for rows ``(sec, at, ret)``; names without a return are left out."""
    rows = pdf.dropna(subset="ret").assign(at=lambda x: pd.to_datetime(x["at"]).astype("int64"))
    rows = rows.groupby("sec").agg({"at": list, "ret": list}).reset_index().assign(side="", score=0.0)
    panel = _panel(rows)
    parts, root = covariance_parts(panel)
    ends = np.cumsum([base.shape[1] for _, base in parts])[:-1]
    load = np.zeros((len(panel.names), root.shape[1]))
    for (at, base), part in zip(parts, np.split(root, ends)):
        load[at] = base @ part
    return panel.names.tolist(), load @ load.T


def _answer(month, names: np.ndarray, problem: interior.Boxed | None) -> pd.DataFrame:
    """Weights of a solved date; none for a date whose limits leave no solution."""
    found = interior.solve(problem) if problem is not None else None
    if found is None or not found.solved:
        return pd.DataFrame({c: pd.Series([], dtype=kind) for c, kind in (("month", object), ("sec", "int64"), ("weight", float), ("residual", float))})
    return pd.DataFrame({"month": month, "sec": names, "weight": np.clip(found.x, problem.low, problem.high), "residual": found.residual})


def long_short_weights(history: DataFrame, bound: float = 0.02, least_names: int = 20) -> DataFrame:
    """Minimum variance with long weights that sum to 1 and short ones to -1, each at most ``bound`` in size: one joint
    problem a date.  Dates with fewer than ``least_names`` names, or whose bounds leave no solution, give no rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = _panel(pdf)
        problem, n = None, len(p.names)
        if n >= least_names and min(p.long.sum(), (~p.long).sum()) * bound >= 1:
            parts, root = covariance_parts(p)
            problem = interior.Factored(parts, np.sqrt(2) * root, np.zeros(n), np.stack([p.long, ~p.long]), [1.0, -1.0], np.where(p.long, 0.0, -bound), np.where(p.long, bound, 0.0))
        return _answer(pdf.month.iloc[0], p.names, problem)

    return _rows(history).groupBy("month").applyInPandas(one, WEIGHTS)


def tilted_weights(history: DataFrame, risk_aversion: float = 10.0, bound: float = 0.2, asked: int | None = None, share: float = 0.8, least_dates: int = 12) -> DataFrame:
    """Risk times aversion less score; long names from 0 to ``bound``, short ones from -``bound`` to 0, weights summing to zero.

    A date needs ``least_dates`` dates of history and ``share`` of the names that it ``asked`` for (all it has, if not given).
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = _panel(pdf)
        problem, n = None, len(p.names)
        if len(p.dates) >= least_dates and n >= share * (asked or n):
            parts, root = covariance_parts(p)
            problem = interior.Factored(parts, np.sqrt(2 * risk_aversion) * root, -p.score, np.ones(n), 0.0, np.where(p.long, 0.0, -bound), np.where(p.long, bound, 0.0))
        return _answer(pdf.month.iloc[0], p.names, problem)

    return _rows(history).groupBy("month").applyInPandas(one, WEIGHTS)


def tracking_weights(history: DataFrame, benchmark: DataFrame, least: float = 0.0, most: float = 1.0, least_dates: int = 12) -> DataFrame:
    """Fully invested weights from ``least`` to ``most`` that track ``benchmark(at, bench)`` most closely, over the dates that all names have.

    A date with fewer than ``least_dates`` such dates, or whose limits leave no solution, gives no rows.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = _panel(pdf)
        problem, n = None, len(p.names)
        common = p.there.all(axis=0)
        if common.sum() >= least_dates and n * least < 1 < n * most:
            bench = dict(zip(np.concatenate(pdf["at"].to_list()), np.concatenate(pdf.bench.to_list())))
            x = p.values[:, common] - np.array([bench[d] for d in p.dates[common]])
            x = x - x.mean(axis=1)[:, None]
            base, rest = np.linalg.qr(x)
            problem = interior.Factored([(np.arange(n), base)], rest * np.sqrt(2 / (x.shape[1] - 1)), np.zeros(n), np.ones(n), 1.0, least, most)
        return _answer(pdf.month.iloc[0], p.names, problem)

    rows = history.join(benchmark.where("bench is not null").select("at", F.col("bench").cast("double").alias("bench")), "at")
    return _rows(rows, "bench").groupBy("month").applyInPandas(one, WEIGHTS)


def strategy_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Return of each date's weights over the next month, with its legs' equal-weighted returns."""
    ahead = returns.where("ret is not null").select("sec", F.last_day(F.add_months("month", -1)).alias("month"), "ret")
    rows = weights.join(ahead, ["sec", "month"])
    leg = lambda test: F.avg(F.when(test, F.col("ret")))
    out = rows.groupBy("month").agg(F.sum(F.col("weight") * F.col("ret")).alias("strategy"), leg(F.col("weight") > 0).alias("long"), leg(F.col("weight") < 0).alias("short"))
    return out.withColumn("spread", F.col("long") - F.col("short"))


def performance(series: DataFrame, column: str, periods: float = 12.0) -> DataFrame:
    """Annualised mean, volatility and their ratio."""
    out = series.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), (F.avg(column) * periods).alias("annual_return"), (F.stddev_samp(column) * F.sqrt(F.lit(periods))).alias("annual_vol"))
    return out.withColumn("sharpe", F.try_divide("annual_return", "annual_vol"))
