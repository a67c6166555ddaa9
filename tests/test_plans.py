"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "e1_month_end_last", "e5_monthly_returns", "d2_market_returns", "h8_beta", "e11_winsor_zscore", "h9_momentum", "h10_earnings_yield", "h19_imputation", "c15_gram_matrix", "h25_factor_covariance",
    "h31_cell_returns", "h39_fifo_matches", "h44_wash_sales", "h46_tax_benefit", "h64_trades", "h67_compliance", "j2_period_contexts", "j3_inline_facts", "j16_quarter_from_ytd", "q4_item_accuracy", "a5_factor_section",
    "h1_annual_features", "h35_listing_returns", "h55_historical_covariance", "k2_multi_horizon_growth", "h5_book_equity", "h66_applied_trades", "q3_company_fields", "j15_breakouts", "j5_value_by_context",
    "h49_harvest_opportunities", "k6_return_attribution", "d14_pairwise_covariance", "h20_style_exposures", "h45_wash_exclusions", "h64_trades_by_lot", "h69_tax_report",
    "a10_latest_release", "a8_rewritten_dates", "j11_fuzzy_tags", "j13_rule_graph", "h26_sector_risk_summary", "h54_sector_asset_covariance",
]


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object or "date" in str(df[c].dtype) or "str" in str(df[c].dtype):
            df[c] = df[c].map(lambda v: "" if pd.isna(v) else str(v)[:10] if hasattr(v, "year") else str(v))
        else:
            df[c] = df[c].astype(float).round(3)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, database, name):
    got, want = plain(QUERIES[name](spark, FOLDER).toPandas()), plain(database.execute(ORACLE_SQL[name]).df())
    spark.catalog.clearCache()
    assert len(got) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-3)


def test_every_query_of_the_library_has_a_name_of_its_own():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 100


def test_momentum_by_hand(spark):
    """Thirteen months before: the latest return must be there, and eleven of the twelve before it."""
    from tidemark.operators import exposures

    def rows(sec, missing):
        return [(sec, i, None if i in missing else 0.01 * (i + 1)) for i in range(14)]

    data = rows(1, ()) + rows(2, (12,)) + rows(3, (4,)) + rows(4, (4, 5))
    df = spark.createDataFrame([(s, i, f"{2000 + i // 12}-{i % 12 + 1:02d}-28", r) for s, i, r in data], "sec long, mi int, month string, ret double")
    got = {r.sec: r.x for r in exposures.momentum(df).where("month = '2001-02-28'").collect()}
    want = {s: 1.0 for s in (1, 3)}
    for s in want:
        for i in range(13):
            want[s] *= 1.0 if s == 3 and i == 4 else 1 + 0.01 * (i + 1)
    assert set(got) == {1, 3} and all(abs(got[s] - (want[s] - 1)) < 1e-12 for s in want)
