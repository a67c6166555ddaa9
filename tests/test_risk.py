import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import covariance, exposures, interior, regress, risk

D = dt.date(2024, 9, 30)


def test_risk_summary_by_hand(spark):
    returns = spark.createDataFrame([(D, "1", 200.0), (D, "2", 100.0)], "month date, sec string, cap double")
    x = spark.createDataFrame([(D, "1", "size", 1.0), (D, "1", "value", 0.5), (D, "2", "size", 0.2), (D, "2", "value", 1.5)], "month date, sec string, factor string, exposure double")
    cov = spark.createDataFrame([(D, "size", "size", 0.04), (D, "size", "value", 0.01), (D, "value", "size", 0.01), (D, "value", "value", 0.09)], "month date, fi string, fj string, cov double")
    own = spark.createDataFrame([(D, "1", 0.02), (D, "2", 0.03)], "month date, sec string, specific_var double")
    got = {r.item: r for r in risk.summary(risk.cap_weights(returns), x, cov, own).collect()}
    assert got["size"].exposure == pytest.approx(0.733333, abs=1e-6) and got["value"].exposure == pytest.approx(0.833333, abs=1e-6)
    want = {"size": 0.027622, "value": 0.068611, "specific": 0.012222, "total": 0.108456}
    assert {k: got[k].variance for k in want} == pytest.approx(want, abs=1e-6)
    asset = {(r.si, r.sj): r["cov"] for r in covariance.asset_covariance(x, cov, own).collect()}
    w = np.array([2 / 3, 1 / 3])
    q = np.array([[asset["1", "1"], asset["1", "2"]], [asset["2", "1"], asset["2", "2"]]])
    assert w @ q @ w == pytest.approx(want["total"], abs=1e-6)


def test_regression_recovers_factors_and_falls_back(spark):
    rng = np.random.default_rng(0)
    rows, panel = [], []
    for s in range(40):
        a, b = rng.normal(size=2)
        panel.append((s, D, float(0.02 * a - 0.01 * b), float(1 + s)))
        rows += [(s, D, "a", float(a)), (s, D, "b", float(b))]
    x = spark.createDataFrame(rows, "sec long, month date, factor string, exposure double")
    returns = spark.createDataFrame(panel, "sec long, month date, ret double, cap double")
    got = {r.factor: r for r in regress.cross_section(x, returns).collect()}
    assert got["a"].factor_return == pytest.approx(0.02) and got["b"].factor_return == pytest.approx(-0.01) and got["a"].method == "wls"
    twin = x.unionByName(x.where("factor = 'a'").withColumn("factor", F.lit("c")))
    again = {r.factor: r for r in regress.cross_section(twin, returns).collect()}
    assert again["a"].method == "ridge" and again["a"].factor_return == pytest.approx(again["c"].factor_return)


def test_student_t():
    # fixed values of the two-sided tail
    assert regress.t_tail(np.array([0.0, 2.0, -2.228, 12.706]), 10)[:3] == pytest.approx([1.0, 0.07339, 0.05001], abs=1e-4)
    assert regress.t_tail(np.array([12.706]), 1)[0] == pytest.approx(0.05, abs=1e-4)


def test_quadratic_solver_meets_its_conditions():
    rng = np.random.default_rng(1)
    for n in (2, 5, 20):
        a = rng.normal(size=(n, n))
        q, c = a @ a.T + 0.1 * np.eye(n), rng.normal(size=n)
        w = interior.solve(interior.Boxed(q, c, np.ones(n), 1.0, 0.0, 0.8)).x
        assert w.sum() == pytest.approx(1) and (w >= -1e-9).all() and (w <= 0.8 + 1e-9).all()
        g = q @ w + c
        inside = (w > 1e-5) & (w < 0.8 - 1e-5)
        if inside.any():
            level = g[inside].mean()
            assert np.abs(g[inside] - level).max() < 1e-3
            assert (g[w <= 1e-5] >= level - 1e-3).all() and (g[w >= 0.8 - 1e-5] <= level + 1e-3).all()
    assert not interior.solve(interior.Boxed(np.eye(2), np.zeros(2), np.ones(2), 1.0, 0.0, 0.3)).solved  # bounds leave no solution


def test_imputation_levels(spark):
    returns = spark.createDataFrame([(i, D) for i in range(5)], "sec long, month date")
    security = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "y"), (4, None)], "sec long, industry string")
    x = spark.createDataFrame([(0, D, "f", 2.0), (1, D, "f", 4.0)], "sec long, month date, factor string, exposure double")
    got = {r.sec: (r.exposure, r.flags) for r in exposures.impute(x, returns, security).collect()}
    assert got == {0: (2.0, None), 1: (4.0, None), 2: (3.0, "imputed=industry"), 3: (3.0, "imputed=global"), 4: (3.0, "imputed=global")}


def test_scale_repair(spark):
    cov = spark.createDataFrame([(D, "a", "a", 4.0), (D, "a", "b", 0.2), (D, "b", "a", 0.2), (D, "b", "b", 0.5)], "month date, fi string, fj string, cov double")
    got = {(r.fi, r.fj): r["cov"] for r in covariance.scale_repair(cov).collect()}
    s = (0.5 / 4) ** 0.5
    assert got == pytest.approx({("a", "a"): 0.5, ("a", "b"): 0.2 * s, ("b", "a"): 0.2 * s, ("b", "b"): 0.5})


def test_smoothed_risk_by_hand_and_from_any_month(spark):
    """Sixty months with gaps: the recurrence month by month, and the same when it goes on from the state of some month."""
    rng = random.Random(2)
    months = [dt.date(2000 + i // 12, i % 12 + 1, 28) for i in range(60)]
    rows = [(s, m, rng.random()) for s in range(9) for m in months if rng.random() < 0.8]
    security = spark.createDataFrame([(s, "xyz"[s % 3] if s else None) for s in range(9)], "sec long, industry string")
    want, prior = {}, {}
    for m in months:
        smooth = {s: v if s not in prior else 0.94 * prior[s] + 0.06 * v for s, d, v in rows if d == m}
        for s, v in smooth.items():
            peers = [w for t, w in smooth.items() if t % 3 == s % 3 and (t == 0) == (s == 0)]
            want[s, m] = prior[s] = 0.9 * v + 0.1 * float(np.median(peers))
    df = spark.createDataFrame(rows, "sec long, month date, specific_var double")
    got = regress.smoothed_risk(df, security)
    assert {(r.sec, r.month): r.specific_var for r in got.collect()} == pytest.approx(want)
    cut = months[23]
    state = got.where(F.col("month") <= cut).groupBy("sec").agg(F.max_by("specific_var", "month").alias("specific_var"))
    later = regress.smoothed_risk(df.where(df.month > cut), security, prior=state)
    assert {(r.sec, r.month): r.specific_var for r in later.collect()} == pytest.approx({k: v for k, v in want.items() if k[1] > cut})


def test_gram_is_summed_in_tasks_without_pairs(spark):
    """Equal to numpy, with overlaps that cancel, factors of some rows only, and no join of a security's factors with themselves."""
    rng = np.random.default_rng(2)
    months, factors = [dt.date(2000, 1, 31), dt.date(2000, 2, 29)], ["b", "a", "c", "d"]
    x = {(s, m, f): float(v) for s in range(30) for m in months for f, v in zip(factors, rng.standard_normal(4)) if (s + len(f)) % 3 or f < "c"}
    x |= {(s, m, "e"): 1.0 for s in (0, 1) for m in months} | {(s, m, "g"): v for s, v in ((0, 1.0), (1, -1.0)) for m in months}
    w = {(s, m): (0.5, 0.0 if s == 3 else float(rng.standard_normal())) for s in range(30) for m in months}
    exposures = spark.createDataFrame([(*k, v) for k, v in x.items()], "sec long, month date, factor string, exposure double")
    weighted = spark.createDataFrame([(*k, *v) for k, v in w.items()], "sec long, month date, w double, ret double")
    df = regress.gram(exposures, weighted)
    got = {(r.month, r.fi, r.fj): r.value for r in df.collect()}
    want = {}
    for m in months:
        for s in range(30):
            own = {f: v for (a, b, f), v in x.items() if (a, b) == (s, m)}
            for fi, v in own.items():
                for fj, u in own.items():
                    if fi <= fj:
                        want[m, fi, fj] = want.get((m, fi, fj), 0.0) + 0.5 * v * u
                want[m, fi, None] = want.get((m, fi, None), 0.0) + 0.5 * v * w[s, m][1]
    assert got.keys() == want.keys() and want[months[0], "e", "g"] == 0
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
