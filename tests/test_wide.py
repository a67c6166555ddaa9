"""The wide risk model equals the operators on long tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import exposures, prices, quantiles, regress, wide


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    months = [dt.date(2000 + (i + 1) // 12, (i + 1) % 12 + 1, 1) - dt.timedelta(1) for i in range(70)]
    rows = [(s, m, m.year * 12 + m.month - 1, float(rng.normal(0, 0.1)) if rng.random() > 0.05 else None, float(rng.lognormal()) if rng.random() > 0.03 else 0.0) for s in range(12) for m in months if s == 0 or rng.random() > 0.1]
    returns = spark.createDataFrame(rows, "sec long, month date, mi int, ret double, cap double")
    facts = [(s, y * 12 + 3 * q - 1, y, q, *(float(x) for x in rng.normal(5, 3, 6))) for s in range(11) for y in range(2000, 2006) for q in range(1, 5) if rng.random() > 0.1]
    quarters = spark.createDataFrame(facts, "sec long, mi int, fy int, fq int, income double, sales double, book double, assets double, debt double, dividends double")
    security = spark.createDataFrame([(s, "ab"[s % 2], "ab"[s % 2] + "xy"[s // 6], f"u{s % 3}") for s in range(1, 12)], "sec long, sector string, industry string, sub_industry string")
    fx = spark.createDataFrame([(m, float(rng.normal())) for m in months[5:]], "month date, fx_return double")
    return returns, quarters, security, fx


def _rows(df, keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("large, batch", [(1_000_000, 10_000), (3, 16)])
def test_wide_model_equals_the_long_one(spark, tables, monkeypatch, large, batch):
    """Gaps, missing returns and capitalisations, securities without facts or without names, groups above the size limit, small batches."""
    monkeypatch.setattr(quantiles, "LARGE", large)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    returns, quarters, security, fx = tables
    market = prices.market_returns(returns)
    raw = wide.raw(returns, market, quarters, fx, security).localCheckpoint()
    figures = wide.month_figures(raw)
    styles = wide.standardised(raw, figures).localCheckpoint()
    medians = wide.industry_medians(styles)
    flagged = wide.filled(styles, figures, medians, flags=True).localCheckpoint()
    rows = flagged.drop(*(f"{s}_flag" for s in wide.STYLES))

    ten = exposures.style_exposures(returns, market, exposures.as_of(returns, exposures.with_history(quarters)), fx).localCheckpoint()
    imputed = exposures.impute(ten, returns, security).localCheckpoint()
    model = exposures.combined(ten, returns, security)
    kept, key = regress.cross_section(model, returns), ["sec", "month", "factor"]
    for got, want in ((wide.long(styles), ten), (wide.long(flagged, flags=True), imputed), (wide.model(rows), model)):
        got, want = _rows(got, key), _rows(want, key)
        assert got.keys() == want.keys() and len(got) > 1000
        assert {k: v["exposure"] for k, v in got.items()} == pytest.approx({k: v["exposure"] for k, v in want.items()}, abs=1e-9)
        assert all(got[k].get("flags") == want[k].get("flags") for k in got)
    assert set(wide.asked(rows).collect()) == set(model.select("month", "factor").distinct().collect())

    mine = wide.cross_section(rows)
    got, want = _rows(mine, ["month", "factor"]), _rows(kept, ["month", "factor"])
    assert got.keys() == want.keys()
    assert {k: v["factor_return"] for k, v in got.items()} == pytest.approx({k: v["factor_return"] for k, v in want.items()}, abs=1e-7)
    got, want = _rows(wide.residuals(rows, kept), key[:2]), _rows(regress.residuals(model, returns, kept), key[:2])
    assert got.keys() == want.keys()
    assert {k: v["residual"] for k, v in got.items()} == pytest.approx({k: v["residual"] for k, v in want.items()}, abs=1e-9)
    got, want = _rows(wide.information_coefficient(styles), ["month", "factor"]), _rows(regress.information_coefficient(ten.where(F.lit(True)), returns), ["month", "factor"])
    shared = {k for k in want if want[k]["n"] > 2}
    assert shared and {k: (got[k]["ic"], got[k]["n"]) for k in shared} == {k: (pytest.approx(want[k]["ic"], abs=1e-9), want[k]["n"]) for k in shared}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_model_is_made_without_a_row_for_each_factor(spark, tables):
    """Factor returns and residuals come from one row a security and month: nothing is generated, and no rows are joined by security."""
    returns, quarters, security, fx = tables
    raw = wide.raw(returns, prices.market_returns(returns), quarters, fx, security).localCheckpoint()
    figures = wide.month_figures(raw).localCheckpoint()
    styles = wide.standardised(raw, figures).localCheckpoint()
    rows = wide.filled(styles, figures, wide.industry_medians(styles)).localCheckpoint()
    returns_of = wide.cross_section(rows)
    for df in (returns_of, wide.residuals(rows, returns_of.localCheckpoint())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "SortMergeJoin" not in plan


def test_attribution_leaves_out_months_without_a_return(spark):
    """A security's first month has exposures but no return: it has no row, also where others already have factor returns."""
    day = dt.date(2000, 2, 29)
    x = spark.createDataFrame([(1, day, "country:US", 1.0), (2, day, "country:US", 1.0)], "sec long, month date, factor string, exposure double")
    f = spark.createDataFrame([(day, "country:US", 0.02)], "month date, factor string, factor_return double")
    rest = spark.createDataFrame([(1, day, 0.01)], "sec long, month date, residual double")
    got = {(r.sec, r.source): r.contribution for r in regress.attribution(x, f, rest).collect()}
    assert got == {(1, "country:US"): 0.02, (1, "residual"): 0.01}
