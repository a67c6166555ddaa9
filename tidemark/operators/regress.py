"""Cross-sectional and time-series regressions.

The sums behind the normal equations (Gram matrices) are Spark aggregations; Python only solves one small system a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import union_all

#: Condition numbers from which the solver falls back on ridge, and the penalties used below and from the second on.
RIDGE_FROM, STRONG_FROM, RIDGE, STRONG_RIDGE = 1e10, 1e12, 1e-4, 1e-2


def with_weights(returns: DataFrame) -> DataFrame:
    """Weight of each security in its month's regression: share of capitalisation."""
    rows = returns.where("ret is not null and cap > 0")
    return rows.withColumn("w", F.col("cap") / F.sum("cap").over(Window.partitionBy("month")))


#: Numbers that a task's sums take before they are handed on.
CELLS = 4_000_000


def gram(exposures: DataFrame, weighted: DataFrame) -> DataFrame:
    """X'WX as ``(month, fi, fj, value)`` with fi <= fj, and X'Wy as rows with fj null.

    A task adds up its own securities' products, month by month; a pair of factors that no security has both of gives no row.
    """
    x = exposures.where("exposure <> 0").join(weighted.select("sec", "month", "w", "ret"), ["sec", "month"])
    x = x.groupBy("sec", "month", "w", "ret").agg(F.collect_list(F.struct("factor", F.col("exposure").cast("double").alias("exposure"))).alias("x"))

    def given(sums, names):
        order = np.argsort(np.array(names, dtype=object), kind="stable")
        place = np.array(names, dtype=object)[order]
        for month, (value, met) in sums.items():
            k = len(met)
            order_k = order[order < k]
            name = place[order < k]
            i, j = np.nonzero(np.triu(met[np.ix_(order_k, order_k)] > 0))
            own = np.flatnonzero(np.diag(met)[order_k] > 0)
            fi, fj = np.concatenate([name[i], name[own]]), np.concatenate([name[j], np.full(len(own), None, object)])
            both = np.concatenate([value[order_k[i], order_k[j]], value[order_k[own], k]])
            yield pa.RecordBatch.from_arrays([pa.array([month] * len(fi), pa.date32()), pa.array(fi, pa.string()), pa.array(fj, pa.string()), pa.array(both)], ["month", "fi", "fj", "value"])

    def run(batches):
        sums, names = {}, {}
        for batch in batches:
            lists, w, ret = batch.column("x"), batch.column("w").to_numpy(), batch.column("ret").to_numpy()
            flat = lists.flatten()
            words = flat.field("factor").dictionary_encode()
            code = np.array([names.setdefault(f, len(names)) for f in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
            row, value = np.repeat(np.arange(len(w)), np.diff(lists.offsets.to_numpy())), flat.field("exposure").to_numpy()
            months = batch.column("month").dictionary_encode()
            at, k = months.indices.to_numpy(), len(names)
            for m, month in enumerate(months.dictionary.to_pylist()):
                mine = np.flatnonzero(at == m)
                for some in np.array_split(mine, -(-len(mine) * (k + 1) // CELLS)):
                    local = np.full(len(w), -1)
                    local[some] = np.arange(len(some))
                    inside = local[row] >= 0
                    dense = np.bincount(local[row[inside]] * (k + 1) + code[inside], value[inside], len(some) * (k + 1)).reshape(-1, k + 1)
                    there = (np.bincount(local[row[inside]] * k + code[inside], minlength=len(some) * k) > 0).reshape(-1, k).astype(float)
                    dense[:, k] = ret[some]
                    value_of, met = dense[:, :k].T @ (dense * w[some, None]), there.T @ there
                    if month in sums:
                        before, met_before = sums[month]
                        n = len(met_before)
                        value_of[:n, :n] += before[:, :n]
                        value_of[:n, k] += before[:, n]
                        met[:n, :n] += met_before
                    sums[month] = value_of, met
            if sum(v.size for v, _ in sums.values()) > CELLS:
                yield from given(sums, list(names))
                sums, names = {}, {}
        yield from given(sums, list(names))

    parts = x.mapInArrow(run, "month date, fi string, fj string, value double")
    return parts.groupBy("month", "fi", "fj").agg(F.sum("value").alias("value"))


def solve(a: np.ndarray, b: np.ndarray, force_ridge: bool = False) -> tuple[np.ndarray, str, float]:
    """Normal equations by plain solve, ridge when ill-conditioned, pseudo-inverse when singular all the same."""
    cond = float(np.linalg.cond(a))
    if not math.isfinite(cond):
        cond = 1e300
    if force_ridge or cond > RIDGE_FROM:
        penalty = STRONG_RIDGE if cond >= STRONG_FROM else RIDGE
        return np.linalg.solve(a + penalty * np.eye(len(a)), b), "ridge", cond
    try:
        return np.linalg.solve(a, b), "wls", cond
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ b, "pinv", cond


def cross_section(exposures: DataFrame, returns: DataFrame, force_ridge: bool = False) -> DataFrame:
    """Factor returns of every month: ``(month, factor, factor_return, method, cond)``."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        right = pdf[pdf.fj.isna()].sort_values("fi")
        names = right.fi.tolist()
        at = {n: i for i, n in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        for i, j, v in pdf.loc[pdf.fj.notna(), ["fi", "fj", "value"]].itertuples(index=False):
            a[at[i], at[j]] = a[at[j], at[i]] = v
        x, method, cond = solve(a, right.value.to_numpy(), force_ridge)
        return pd.DataFrame({"month": pdf.month.iloc[0], "factor": names, "factor_return": x, "method": method, "cond": cond})

    schema = "month date, factor string, factor_return double, method string, cond double"
    return gram(exposures, with_weights(returns)).groupBy("month").applyInPandas(fit, schema)


def residuals(exposures: DataFrame, returns: DataFrame, factor_returns: DataFrame) -> DataFrame:
    """What the factors leave: ``(sec, month, residual, specific_var)``."""
    fitted = exposures.join(factor_returns.select("month", "factor", "factor_return"), ["month", "factor"])
    fitted = fitted.groupBy("sec", "month").agg(F.sum(F.col("exposure") * F.col("factor_return")).alias("fit"))
    out = returns.where("ret is not null").join(fitted, ["sec", "month"])
    return out.select("sec", "month", (F.col("ret") - F.col("fit")).alias("residual")).withColumn("specific_var", F.col("residual") * F.col("residual"))


def r_squared(residual: DataFrame, returns: DataFrame) -> DataFrame:
    """Unweighted R2 of each month."""
    rows = residual if "ret" in residual.columns else residual.join(returns.select("sec", "month", "ret"), ["sec", "month"])
    return rows.groupBy("month").agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum("specific_var"), F.var_pop("ret") * F.count("*"))).alias("r2"))


def smoothed_risk(specific: DataFrame, security: DataFrame, decay: float = 0.94, shrink: float = 0.1, prior: DataFrame | None = None) -> DataFrame:
    """Specific variance smoothed over months and shrunk to the industry median.

    The prior of a month is the *shrunk* value of the one before, and the shrinkage needs every security of the month, so
    the months of an industry are folded in order; an industry is a group of securities x months.  ``prior(sec, specific_var)``
    is what earlier months have left, so a run can go on from any month.  Securities without an industry are one.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        before = pdf[pdf.month.isna()]
        held = dict(zip(before.sec, before.specific_var))
        out = [pd.DataFrame({"sec": np.zeros(0, np.int64), "month": np.zeros(0, object), "specific_var": np.zeros(0)})]
        for month, part in pdf[pdf.month.notna()].sort_values(["month", "sec"]).groupby("month"):
            raw = part.specific_var.to_numpy()
            old = np.array([held.get(s, np.nan) for s in part.sec])
            smooth = np.where(np.isnan(old), raw, decay * old + (1 - decay) * raw)
            value = (1 - shrink) * smooth + shrink * np.median(smooth)
            held.update(zip(part.sec, value))
            out.append(pd.DataFrame({"sec": part.sec, "month": month, "specific_var": value}))
        return pd.concat(out[1:] or out)

    rows = specific.select("sec", "month", "specific_var")
    if prior is not None:
        rows = rows.unionByName(prior.select("sec", F.lit(None).cast("date").alias("month"), "specific_var"))
    rows = rows.join(security.select("sec", "industry"), "sec")
    return rows.select("sec", "month", "industry", "specific_var").groupBy("industry").applyInPandas(fold, "sec long, month date, specific_var double")


def t_tail(t: np.ndarray, dof: int) -> np.ndarray:
    """Two-sided p-value of Student's t: the regularised incomplete beta function by its continued fraction."""
    x = dof / (dof + np.square(np.asarray(t, float)))
    return np.array([_beta(dof / 2, 0.5, v) for v in np.atleast_1d(x)])


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    # Lentz's evaluation, from the front
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    value = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * value / a


def factor_ols(returns: DataFrame, factors: DataFrame, names: list[str], least: int = 24) -> DataFrame:
    """Per security: alpha and betas on ``factors(month, *names)`` with t and p values, R2 and n; long rows by term."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.c_[np.ones(len(pdf)), pdf[names].to_numpy(float)]
        y = pdf.ret.to_numpy(float)
        n, k = x.shape
        coef, *_ = np.linalg.lstsq(x, y, rcond=None)
        rest = y - x @ coef
        dof = max(1, n - k)
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * (rest @ rest) / dof, 1e-300))
        total = ((y - y.mean()) ** 2).sum()
        r2 = 1 - (rest @ rest) / total if total else np.nan
        return pd.DataFrame({"sec": pdf.sec.iloc[0], "term": ["alpha", *names], "coef": coef, "t": coef / se, "p": t_tail(coef / se, dof), "r2": r2, "n": n})

    rows = returns.where("ret is not null").select("sec", "month", "ret").join(factors, "month").dropna()
    enough = rows.groupBy("sec").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("sec")
    return rows.join(enough, "sec", "left_semi").groupBy("sec").applyInPandas(fit, "sec long, term string, coef double, t double, p double, r2 double, n long")


def information_coefficient(exposures: DataFrame, returns: DataFrame) -> DataFrame:
    """Spearman correlation of each month's exposures with the next month's returns."""
    ahead = returns.where("ret is not null").select("sec", (F.add_months("month", -1)).alias("m"), "ret").withColumn("month", F.last_day("m")).drop("m")
    return rank_correlation(exposures.join(ahead, ["sec", "month"]))


def rank_correlation(rows: DataFrame) -> DataFrame:
    """Of ``rows(month, factor, exposure, ret)``: ``(month, factor, ic, n)``."""
    for c in ("exposure", "ret"):
        w = Window.partitionBy("month", "factor")
        tie = Window.partitionBy("month", "factor", c)
        rows = rows.withColumn(f"r_{c}", F.rank().over(w.orderBy(c)) + (F.count("*").over(tie) - 1) / 2)
    return rows.groupBy("month", "factor").agg(F.corr("r_exposure", "r_ret").alias("ic"), F.count("*").alias("n"))


def attribution(exposures: DataFrame, factor_returns: DataFrame, residual: DataFrame) -> DataFrame:
    """Return of each security and month that has one, by source: a row for each factor and one for the residual."""
    parts = exposures.join(F.broadcast(factor_returns.select("month", "factor", "factor_return")), ["month", "factor"])
    parts = parts.join(residual.select("sec", "month"), ["sec", "month"], "left_semi")  # exposures without a return have nothing to attribute
    parts = parts.select("sec", "month", F.col("factor").alias("source"), (F.col("exposure") * F.col("factor_return")).alias("contribution"))
    return union_all([parts, residual.select("sec", "month", F.lit("residual").alias("source"), F.col("residual").alias("contribution"))])
