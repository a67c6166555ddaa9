"""Account and portfolio solves: limits that bind, certificates, and brute force on small cases."""

import datetime as dt
import itertools
import time

import numpy as np
import pytest

from tidemark.operators import backtest, interior, rebalance

PROBLEM = "acct long, sec string, weight double, bench double, specific double, sector string, coefficient double, penalty double, no_buy boolean, most_risk double"


def enumerated(q, c, a, b, low, high):
    """Least value over all choices of which bounds hold."""
    best, n = np.inf, len(c)
    for pattern in itertools.product((0, 1, 2), repeat=n):
        free = np.array(pattern) == 2
        x = np.where(np.array(pattern) == 0, low, high)
        k = free.sum()
        m = np.zeros((k + len(b), k + len(b)))
        m[:k, :k], m[:k, k:], m[k:, :k] = q[np.ix_(free, free)], a[:, free].T, a[:, free]
        fixed = np.where(free, 0, x)
        x = fixed.copy()
        x[free] = np.linalg.lstsq(m, np.concatenate([-c[free] - q[free] @ fixed, b - a @ fixed]), rcond=None)[0][:k]
        if np.abs(a @ x - b).max() < 1e-8 and (x >= low - 1e-9).all() and (x <= high + 1e-9).all():
            best = min(best, x @ q @ x / 2 + c @ x)
    return best


def test_boxed_problems_equal_enumeration():
    rng = np.random.default_rng(0)
    for i in range(40):
        g = rng.standard_normal((rng.integers(1, 6), 5))
        q, c = g.T @ g * 10.0 ** rng.integers(-4, 3), rng.standard_normal(5) * (i % 3 > 0)
        low, high = -rng.random(5) * (i % 2), rng.random(5) + 0.3
        a = np.array([[1.0, 1, 1, 0, 0], [0, 0, 0, 1, 1]]) if i % 4 > 1 else np.ones((1, 5))
        b = a @ ((low + high) / 2 + 0.1 * (rng.random(5) - 0.5) * (high - low))
        found = interior.solve(interior.Boxed(q, c, a, b, low, high))
        want = enumerated(q, c, a, b, low, high)
        assert found.residual < 1e-8 and found.x @ q @ found.x / 2 + c @ found.x == pytest.approx(want, rel=1e-6, abs=1e-7)


def account(rng, n, k, tight):
    """A problem that a known trade satisfies; ``tight`` names the limits that this trade exactly meets."""
    w0, bench, sector = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n)), rng.integers(0, 3, n)
    x, f, d = rng.standard_normal((n, k)), np.cov(rng.standard_normal((k, 4 * k))).reshape(k, k) * 0.01, rng.random(n) * 0.02
    no_buy = rng.random(n) < 0.2
    target = np.where(no_buy, np.minimum(w0, bench), bench)
    target[~no_buy] *= (1 - target[no_buy].sum()) / target[~no_buy].sum()
    to = w0 + 0.4 * (target - w0)
    member = np.eye(3)[sector]
    worth = np.where(rng.random(n) < 0.3, 0.0008, -0.002 * (rng.random(n) < 0.3))
    active = to - bench
    limits = {
        "turnover": np.abs(to - w0).sum() * (1 if "turnover" in tight else 10), "caps": member.T @ to + (1e-3 if "caps" in tight else 1),
        "ball": (active @ (x @ f @ x.T + np.diag(d)) @ active) * 1.001 if "ball" in tight else None,
    }
    cost = 0.001 if tight in ((), ("turnover",)) else 0.1  # dear enough that only limits move anything
    p = interior.Account(w0, bench, x, f, d, cost, worth, no_buy, limits["turnover"], member, limits["caps"], limits["ball"])
    assert np.allclose(p.load @ p.load.T + np.diag(p.d), x @ f @ x.T + np.diag(d), atol=1e-3)
    return p, p.load @ p.load.T + np.diag(p.d), worth, cost


def value(w, w0, bench, sigma, cost, worth):
    return (w - bench) @ sigma @ (w - bench) + cost * np.abs(w - w0).sum() - worth @ np.maximum(w0 - w, 0)


@pytest.mark.parametrize("tight", [(), ("turnover",), ("caps",), ("ball",), ("turnover", "caps", "ball")])
def test_accounts_meet_their_limits(tight):
    rng = np.random.default_rng(len(tight) + 3)
    bound = 0
    for n, k in ((6, 2), (40, 5), (300, 20)) * 4:
        p, sigma, worth, cost = account(rng, n, k, tight)
        found = interior.solve(p)
        assert found.solved, (n, tight, found.residual)
        w = p.weights(found.x)
        assert w.sum() == pytest.approx(1) and w.min() > -1e-8 and (p.sectors.T @ w <= p.caps + 1e-7).all()
        assert found.x.sum() <= p.turnover + 1e-7 and (p.ball is None or p.variance(found.x) <= p.ball * (1 + 1e-6))
        bound += found.x.sum() > p.turnover - 1e-6 or (p.sectors.T @ w > p.caps - 1e-6).any() or (p.ball is not None and p.variance(found.x) > p.ball * (1 - 1e-5))
        best = value(w, p.w0, p.bench, sigma, cost, worth)
        for _ in range(300):  # no feasible point near or far is better
            other = np.maximum(w + rng.standard_normal(n) * rng.choice([1e-4, 1e-2, 0.1]) / n, 0)
            other /= other.sum()
            barred = np.setdiff1d(np.arange(n), p.may)
            active = other - p.bench
            if (other[barred] <= p.w0[barred]).all() and np.abs(other - p.w0).sum() <= p.turnover and (p.sectors.T @ other <= p.caps).all() and (p.ball is None or active @ sigma @ active <= p.ball):
                assert value(other, p.w0, p.bench, sigma, cost, worth) >= best - 1e-7
    assert bound > 0 or not tight


def test_account_equals_a_grid():
    rng = np.random.default_rng(8)
    for case in range(6):
        w0, bench = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3))
        g = rng.standard_normal((3, 2))
        f, d, worth = np.array([[0.02, 0.01], [0.01, 0.03]]), np.array([0.01, 0.02, 0.005]), np.array([0.0009, -0.003, 0.0])
        sigma, turn, cap = g @ f @ g.T + np.diag(d), 0.2 if case % 2 else 2.0, max(w0[0] - 0.02, 0.3)
        p = interior.Account(w0, bench, g, f, d, 0.001, worth, np.array([False, False, True]), turn, np.eye(3)[:, :1], np.array([cap]))
        found = interior.solve(p)
        grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 401) for b in np.linspace(0, 1 - a, 401)]
        fits = [w for w in grid if w[2] <= w0[2] and w[0] <= cap and np.abs(w - w0).sum() <= turn]
        best = min(value(w, w0, bench, sigma, 0.001, worth) for w in fits)
        mine = value(p.weights(found.x), w0, bench, sigma, 0.001, worth)
        assert found.solved and best - 2e-4 <= mine <= best + 1e-9


def test_accounts_in_one_job(spark):
    rows = [(1, f"S{i}", 0.25, 0.1 + 0.1 * i, 0.04, "x" if i < 2 else "y", 0.0, 0.0, i == 3, None) for i in range(4)]
    rows += [(2, "S0", 1.0, 0.0, 0.04, "x", 0.0, 0.0, False, None), (2, "S1", None, 0.0, 0.04, "x", None, None, None, None)]
    rows += [(3, "S0", 0.5, 0.0, 0.04, "x", 0.05, 0.0, True, 0.001), (3, "S2", 0.5, 1.0, 0.04, "y", 0.0, 0.0, False, 0.001)]
    exposures = spark.createDataFrame([(f"S{i}", "m", 1.0 + i / 10) for i in range(4)], "sec string, factor string, x double")
    covariance = spark.createDataFrame([("m", "m", 0.03)], "fi string, fj string, cov double")
    caps = spark.createDataFrame([(2, "x", 0.4)], "acct long, sector string, cap double")
    found = rebalance.solve_accounts(spark.createDataFrame(rows, PROBLEM), exposures, covariance, caps, most_turnover=0.1).collect()
    one = {r.sec: r for r in found if r.acct == 1}
    assert sum(r.weight for r in one.values()) == pytest.approx(1) and one["S3"].weight <= 0.25 + 1e-9 and all(r.status == "optimal" and r.residual < 1e-6 for r in one.values())
    assert sum(r.buy + r.sell for r in one.values()) == pytest.approx(0.1, abs=1e-6)  # buys and sales together, not half of them
    assert {(r.sec, r.weight, r.status) for r in found if r.acct == 2} == {("S0", 1.0, "infeasible"), ("S1", 0.0, "infeasible")}
    assert {r.status for r in found if r.acct == 3} == {"infeasible"}  # so little risk needs more trades
    assert rebalance.solve_accounts(spark.createDataFrame([], PROBLEM), exposures, covariance, caps).count() == 0


def history(spark, seed, names, dates, gaps=()):
    rng = np.random.default_rng(seed)
    rows, common = [], rng.standard_normal(dates) * 0.03
    for s in range(names):
        for i in range(dates):
            if (s, i) not in gaps:
                month = dt.date(2000 + i // 12, i % 12 + 1, 28)
                rows.append((dt.date(2010, 1, 31), s, float(names - s), "long" if s < names // 2 else "short", month, float(common[i] * (1 + s / 9) + rng.standard_normal() * 0.02)))
    return spark.createDataFrame(rows, "month date, sec long, score double, side string, at date, ret double"), rows


def test_portfolios_equal_enumeration(spark):
    df, rows = history(spark, 1, 6, 5, {(0, 1), (3, 2)})  # fewer dates than names: a singular covariance
    import pandas as pd

    names, q = backtest.covariance(pd.DataFrame(rows, columns=["month", "sec", "score", "side", "at", "ret"]))
    assert np.linalg.eigvalsh(q).min() > -1e-12
    long = np.array([s < 3 for s in names])
    got = {r.sec: r for r in backtest.long_short_weights(df, bound=0.6, least_names=6).collect()}
    w = np.array([got[s].weight for s in names])
    want = enumerated(2 * q, np.zeros(6), np.stack([long, ~long]).astype(float), np.array([1.0, -1]), np.where(long, 0, -0.6), np.where(long, 0.6, 0))
    assert w @ q @ w == pytest.approx(want, abs=1e-9) and w[long].sum() == pytest.approx(1) and w[~long].sum() == pytest.approx(-1) and max(r.residual for r in got.values()) < 1e-8
    assert backtest.long_short_weights(df, bound=0.02, least_names=6).count() == 0 and backtest.long_short_weights(df, bound=0.6).count() == 0

    df, rows = history(spark, 2, 6, 20)
    names, q = backtest.covariance(pd.DataFrame(rows, columns=["month", "sec", "score", "side", "at", "ret"]))
    score = np.array([6.0 - s for s in names]) / 100
    scaled = df.withColumn("score", df.score / 100)
    w = {r.sec: r.weight for r in backtest.tilted_weights(scaled, 10.0, 0.3).collect()}
    w = np.array([w[s] for s in names])
    want = enumerated(20 * q, -score, np.ones((1, 6)), np.zeros(1), np.where(long, 0, -0.3), np.where(long, 0.3, 0))
    assert 10 * w @ q @ w - score @ w == pytest.approx(want, abs=1e-9) and w.sum() == pytest.approx(0, abs=1e-9)
    assert backtest.tilted_weights(scaled, asked=10).count() == 0 and backtest.tilted_weights(scaled, least_dates=21).count() == 0

    bench = spark.createDataFrame([(r[4], r[5] * 0.5) for r in rows if r[1] == 2], "at date, bench double")
    w = {r.sec: r.weight for r in backtest.tracking_weights(df, bench, 0.05, 0.5).collect()}
    x = pd.DataFrame(rows, columns=["month", "sec", "score", "side", "at", "ret"]).pivot_table(index="at", columns="sec", values="ret")
    active = x.sub(pd.Series({r[4]: r[5] * 0.5 for r in rows if r[1] == 2}), axis=0)
    q = active.cov().to_numpy()
    w = np.array([w[s] for s in x.columns])
    assert w @ q @ w == pytest.approx(enumerated(2 * q, np.zeros(6), np.ones((1, 6)), np.ones(1), np.full(6, 0.05), np.full(6, 0.5)), abs=1e-9)
    assert w.sum() == pytest.approx(1) and w.min() >= 0.05 - 1e-9 and w.max() <= 0.5 + 1e-9


def test_factored_covariance_equals_the_whole_matrix(spark):
    """Gaps in the returns; the matrix of pairs is repaired, and no array of names x names is made in a solve."""
    import pandas as pd

    rng = np.random.default_rng(5)
    gaps = {(int(s), int(i)) for s, i in zip(rng.integers(0, 60, 40), rng.integers(0, 24, 40))}
    df, rows = history(spark, 3, 60, 24, gaps)
    pdf = pd.DataFrame(rows, columns=["month", "sec", "score", "side", "at", "ret"])
    names, q = backtest.covariance(pdf)
    raw = np.nan_to_num(pdf.pivot_table(index="at", columns="sec", values="ret").cov().to_numpy())
    values, vectors = np.linalg.eigh(raw)
    want = (vectors * np.maximum(values, 0)) @ vectors.T
    assert names == list(range(60)) and np.allclose(q, want, atol=1e-12)
    long = np.array([s < 30 for s in names])
    a, low, high = np.stack([long, ~long]), np.where(long, 0, -0.1), np.where(long, 0.1, 0)
    whole = interior.solve(interior.Boxed(2 * want, np.zeros(60), a, [1.0, -1.0], low, high))
    got = {r.sec: r for r in backtest.long_short_weights(df, bound=0.1).collect()}
    w = np.array([got[s].weight for s in names])
    assert whole.solved and max(r.residual for r in got.values()) < 1e-8 and w @ want @ w == pytest.approx(whole.x @ want @ whole.x, abs=1e-9)


def test_portfolios_of_many_names(spark):
    """Six thousand names a date in some seconds: a matrix of all pairs would have 36 million entries, and each step would invert it."""
    names, dates = 6000, 36
    ids = spark.range(names).withColumnRenamed("id", "sec")
    rows = ids.selectExpr("date'2010-01-31' month", "sec", "(sec % 997) / 997d - 0.5 score", "if(sec % 2 = 0, 'long', 'short') side", f"explode(sequence(1, {dates})) i")
    rows = rows.where("(sec * 31 + i * 17) % 911 > 0").selectExpr("month", "sec", "score", "side", "last_day(add_months(month, -i)) at", "(hash(sec, i) % 1000) / 20000d + (hash(i) % 1000) / 30000d ret")
    began = time.process_time()
    found = backtest.long_short_weights(rows, bound=0.1).unionByName(backtest.tilted_weights(rows)).collect()
    assert len(found) == 2 * names and max(r.residual for r in found) < 1e-6 and time.process_time() - began < 60
    import resource

    problem = backtest._panel(backtest._rows(rows).toPandas())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    parts, root = backtest.covariance_parts(problem)
    assert sum(base.size for _, base in parts) <= names * dates and root.shape[0] < 2200
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


@pytest.mark.parametrize("tight", [(), ("turnover",), ("caps",), ("ball",), ("turnover", "caps", "ball")])
def test_accounts_together_equal_accounts_alone(tight):
    """Of different sizes in one array, and in less time than one by one."""
    rng = np.random.default_rng(len(tight))
    cases = [account(rng, int(n), 4, tight) for n in rng.integers(4, 30, 60)]
    f = np.eye(4)
    m, n = len(cases), max(p.n for p, *_ in cases)
    pad = lambda rows, *more: np.stack([np.concatenate([r, np.zeros((n - len(r), *more))]) for r in rows])
    ps = [interior.Account(p.w0, p.bench, p.load, f, p.d, cost, worth, ~p.can_buy, p.turnover, p.sectors, p.caps, p.ball) for p, _, worth, cost in cases]
    began = time.perf_counter()
    alone = [interior.solve(p) for p in ps]
    middle = time.perf_counter()
    real = np.arange(n) < np.array([p.n for p in ps])[:, None]
    ball = np.array([np.nan if p.ball is None else p.ball for p in ps])
    worth, cost = pad([c[2] for c in cases]), cases[0][3]
    many = interior.Accounts(
        pad([p.w0 for p in ps]), pad([p.bench for p in ps]), pad([p.load for p, *_ in cases], 4), f, pad([c[0].d for c in cases]), cost, worth, pad([~p.can_buy for p in ps]).astype(bool),
        np.array([p.turnover for p in ps]), pad([p.sectors for p in ps], 3), np.stack([p.caps for p in ps]), ball, real,
    )
    found, residual = interior.solve_accounts(many)
    assert time.perf_counter() - middle < 0.7 * (middle - began)
    buy, sell = many.trades(found)
    for i, (p, a) in enumerate(zip(ps, alone)):
        b, s = p.trades(a.x)
        assert residual[i] < 1e-6 and a.solved and np.abs(buy[i, : p.n] - sell[i, : p.n] - b + s).max() < 1e-3 and not buy[i, p.n :].any()
