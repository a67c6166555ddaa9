"""Queries on panels, exposures, regressions, covariances, risk, factors and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import union_all
from tidemark.operators import backtest, covariance, exposures, factors, fundamentals, prices, quality, regress, risk, wide
from tidemark.plans.registry import Registry
from tidemark.plans.standins import Tables

registry = Registry()
add = registry.add
QUERIES, ORACLE_SQL = registry.queries, registry.sql

_HISTORY = """
hist AS (SELECT *, CASE WHEN count(income) OVER w4 = 4 THEN sum(income) OVER w4 END AS income_ttm, CASE WHEN count(sales) OVER w4 = 4 THEN sum(sales) OVER w4 END AS sales_ttm,
         CASE WHEN count(income) OVER w8 >= 4 THEN stddev_samp(income) OVER w8 END AS income_sd FROM quarters
         WINDOW w4 AS (PARTITION BY sec ORDER BY mi ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY sec ORDER BY mi ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
hist2 AS (SELECT *, lag(sales_ttm, 4) OVER (PARTITION BY sec ORDER BY mi) AS sales_before, mi + 3 AS known FROM hist),
panel AS (SELECT r.sec, r.month, r.cap, h.* EXCLUDE (sec, d) FROM returns r ASOF JOIN hist2 h ON r.sec = h.sec AND r.mi >= h.known)
"""


def _z(x: str, source: str, where: str = "true") -> str:
    """Clipped and standardised exposures of an expression, as SQL."""
    return f"""SELECT sec, month, CASE WHEN stddev_pop(c) OVER p > 1e-12 THEN (c - avg(c) OVER p) / stddev_pop(c) OVER p ELSE 0 END AS exposure FROM (
      SELECT sec, month, greatest(least(x, hi), lo) AS c FROM (SELECT sec, month, {x} AS x FROM {source} WHERE {where}) JOIN
        (SELECT month, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM (SELECT month, {x} AS x FROM {source} WHERE {where}) WHERE x IS NOT NULL AND isfinite(x) GROUP BY month) USING (month)
      WHERE x IS NOT NULL AND isfinite(x)) WINDOW p AS (PARTITION BY month)"""


def _returns(t: Tables) -> DataFrame:
    return t.keep("returns", lambda: prices.monthly_returns(prices.monthly_prices(t.daily())))


def _panel(t: Tables) -> DataFrame:
    return t.keep("panel", lambda: exposures.as_of(_returns(t), exposures.with_history(t.quarters())))


def _raw_styles(t: Tables) -> DataFrame:
    r = _returns(t)
    return t.keep("raw_styles", lambda: wide.raw(r, prices.market_returns(r), t.quarters(), _fx(t), t.security()))


def _figures(t: Tables) -> DataFrame:
    return t.keep("month_figures", lambda: wide.month_figures(_raw_styles(t)))


def _styles(t: Tables) -> DataFrame:
    """Ten standardised styles and the industry levels, a row a security and month."""
    return t.keep("styles", lambda: wide.standardised(_raw_styles(t), _figures(t)))


def _medians(t: Tables) -> DataFrame:
    return t.keep("industry_medians", lambda: wide.industry_medians(_styles(t)))


def _filled(t: Tables) -> DataFrame:
    return t.keep("filled", lambda: wide.filled(_styles(t), _figures(t), _medians(t)))


def _ten_styles(t: Tables) -> DataFrame:
    return wide.long(_styles(t))


def _imputed(t: Tables) -> DataFrame:
    return wide.long(wide.filled(_styles(t), _figures(t), _medians(t), flags=True), flags=True)


def _model(t: Tables, held: DataFrame | None = None) -> DataFrame:
    """Exposures of the whole model: ten styles, three industry levels, country; of the securities ``held(month, sec)`` alone, if given."""
    rows = _filled(t)
    return wide.model(rows if held is None else rows.join(F.broadcast(held.select("month", "sec")), ["month", "sec"], "left_semi"))


def _factor_returns(t: Tables) -> DataFrame:
    return t.keep("factor_returns", lambda: wide.cross_section(_filled(t)))


def _residual_rows(t: Tables) -> DataFrame:
    return t.keep("residuals", lambda: wide.residuals(_filled(t), _factor_returns(t)))


def _residuals(t: Tables) -> DataFrame:
    return _residual_rows(t).drop("ret")


def _smoothed(t: Tables) -> DataFrame:
    return t.keep("smoothed", lambda: regress.smoothed_risk(_residuals(t), t.security()))


_SMALL_FACTORS = """
fr0 AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, o_orderpriority AS factor, avg(o_totalprice) / 1e5 - 1.4 AS factor_return FROM orders GROUP BY ALL),
fr AS (SELECT * FROM fr0 WHERE month IN (SELECT month FROM fr0 GROUP BY month HAVING count(*) = (SELECT count(DISTINCT factor) FROM fr0)))
"""


def _plain_factors(t: Tables) -> DataFrame:
    """A small panel of series by month that SQL can build as well: (month, factor, factor_return)."""
    return t.read("orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("month"), F.col("o_orderpriority").alias("factor")).agg((F.avg("o_totalprice") / 1e5 - 1.4).alias("factor_return"))


@add("SELECT sec, month, month_end_date, price, cap FROM monthly", "price cap")
def e1_month_end_last(t):
    return prices.monthly_prices(t.daily()).select("sec", "month", "month_end_date", "price", "cap")


@add("SELECT sec, month, ret FROM returns", "ret")
def e5_monthly_returns(t):
    return _returns(t).select("sec", "month", "ret")


@add("SELECT month, market_return, total_cap, n FROM market", "market_return total_cap", places=4)
def d2_market_returns(t):
    return prices.market_returns(_returns(t)).select("month", "market_return", "total_cap", "n")


@add("SELECT d.sec, d.d, d.price, ticker, industry, sector FROM daily d JOIN (SELECT sec, max(d) AS d FROM daily GROUP BY sec) USING (sec, d) JOIN security s ON d.sec = s.sec", "price")
def e2_latest_mapping(t):
    return prices.latest_mapping(t.daily(), t.security()).select("sec", "d", "price", "ticker", "industry", "sector")


@add("SELECT sec, min(month) AS first_month, max(month) AS last_month, count(*) AS n FROM returns WHERE ret IS NOT NULL GROUP BY sec")
def d13_return_coverage(t):
    return prices.coverage(_returns(t))


@add("SELECT sec, month, exp(sum(ln(1 + ret)) OVER (PARTITION BY sec ORDER BY month ROWS UNBOUNDED PRECEDING)) AS curve FROM returns WHERE ret IS NOT NULL", "curve", places=4)
def e13_cumulative_curve(t):
    return prices.cumulative(_returns(t)).select("sec", "month", "curve")


@add("SELECT sec, month, CASE WHEN month < DATE '1998-01-31' THEN ret ELSE coalesce(ret, 0) END AS ret FROM returns WHERE sec <> 3 OR month < DATE '1998-01-31'", "ret")
def h34_unified_returns(t):
    r = _returns(t)
    cut = F.lit("1998-01-31").cast("date")
    history, current = r.where(F.col("month") < cut), r.where((F.col("sec") != 3) | (F.col("month") < cut)).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return prices.unified_returns(history, current)


@add("""SELECT month, sec, rank, cap FROM (SELECT month, sec, cap, CAST(row_number() OVER (PARTITION BY month ORDER BY cap DESC, sec) AS INTEGER) AS rank FROM monthly) WHERE rank <= 5""", "cap")
def f1_top_by_cap(t):
    rows = prices.monthly_prices(t.daily()).withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("cap"), "sec")))
    return rows.where("rank <= 5").select("month", "sec", "rank", "cap")


@add("SELECT sec, month, exposure FROM (" + _z("ln(cap)", "returns", "cap > 0") + ")", "exposure")
def h7_size(t):
    return exposures.standardise(exposures.size(_returns(t)), "size").drop("factor")


_BETA = """
b AS (SELECT r.sec, r.month, count(*) OVER w AS n, sum(ret) OVER w AS sx, sum(market_return) OVER w AS sy, sum(ret * market_return) OVER w AS sxy, sum(market_return * market_return) OVER w AS syy
      FROM returns r JOIN market m USING (month) WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY r.sec ORDER BY r.mi RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
"""


@add("SELECT sec, month, (sxy - sx * sy / n) / (syy - sy * sy / n) AS beta FROM b WHERE n >= 36", "beta", _BETA, places=4)
def h8_beta(t):
    """Trailing 60-month market beta of every security and month."""
    r = _returns(t)
    return exposures.beta(r, prices.market_returns(r)).withColumnRenamed("x", "beta")


@add("SELECT sec, month, exposure FROM (" + _z("(sxy - sx * sy / n) / (syy - sy * sy / n)", "b", "n >= 36") + ")", "exposure", _BETA, places=4)
def e11_winsor_zscore(t):
    r = _returns(t)
    rows = exposures.beta(r, prices.market_returns(r)).withColumnRenamed("x", "exposure").where("exposure is not null")
    return exposures.winsor_z(rows, "exposure", ["month"])


@add("""SELECT sec, month, exp(s + l) - 1 AS x FROM (SELECT sec, month, count(*) OVER w AS n, sum(ln(1 + ret)) OVER w AS s, sum(ln(1 + ret)) OVER v AS l FROM returns WHERE ret IS NOT NULL
  WINDOW w AS (PARTITION BY sec ORDER BY mi RANGE BETWEEN 13 PRECEDING AND 2 PRECEDING), v AS (PARTITION BY sec ORDER BY mi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) WHERE n >= 11 AND l IS NOT NULL""", "x")
def h9_momentum(t):
    return exposures.momentum(_returns(t))


@add("SELECT sec, month, income_ttm / cap AS x FROM panel WHERE cap > 0 AND income_ttm IS NOT NULL", "x", _HISTORY)
def h10_earnings_yield(t):
    return exposures.earnings_yield(_panel(t))


@add("SELECT sec, month, ln(book / cap) AS x FROM panel WHERE cap > 0 AND book > 0", "x", _HISTORY)
def h11_book_to_price(t):
    return exposures.book_to_price(_panel(t))


@add("SELECT sec, month, sales_ttm / sales_before - 1 AS x FROM panel WHERE sales_before <> 0 AND sales_ttm IS NOT NULL", "x", _HISTORY)
def h12_growth(t):
    return exposures.growth(_panel(t))


@add("SELECT sec, month, -income_sd AS x FROM panel WHERE income_sd IS NOT NULL", "x", _HISTORY, places=2)
def h13_earnings_variability(t):
    return exposures.earnings_variability(_panel(t))


@add("SELECT sec, month, debt / assets AS x FROM panel WHERE assets > 0", "x", _HISTORY)
def h14_leverage(t):
    return exposures.leverage(_panel(t))


@add("SELECT sec, month, dividends / cap AS x FROM panel WHERE cap > 0 AND dividends >= 0", "x", _HISTORY)
def h15_dividend_yield(t):
    return exposures.dividend_yield(_panel(t))


_FX = """
fx AS (SELECT month, p / lag(p) OVER (ORDER BY month) - 1 AS fx_return FROM (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, avg(o_totalprice) AS p FROM orders GROUP BY ALL)),
f AS (SELECT r.sec, r.month, count(*) OVER w AS n, sum(ret) OVER w AS sx, sum(fx_return) OVER w AS sy, sum(ret * fx_return) OVER w AS sxy, sum(fx_return * fx_return) OVER w AS syy
      FROM returns r JOIN fx USING (month) WHERE ret IS NOT NULL AND fx_return IS NOT NULL WINDOW w AS (PARTITION BY r.sec ORDER BY r.mi RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
"""


def _fx(t: Tables) -> DataFrame:
    fx = t.read("orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("month")).agg(F.avg("o_totalprice").alias("p"))
    return fx.select("month", (F.col("p") / F.lag("p").over(Window.orderBy("month")) - 1).alias("fx_return"))  # one row a month


@add("SELECT sec, month, (sxy - sx * sy / n) / (syy - sy * sy / n) AS x FROM f WHERE n >= 24", "x", _FX, places=4)
def h16_currency_sensitivity(t):
    return exposures.currency_sensitivity(_returns(t), _fx(t))


@add("SELECT sec, month, 'sector:' || sector AS factor, 1.0::DOUBLE AS exposure FROM returns JOIN security USING (sec) UNION ALL SELECT sec, month, 'industry:' || industry, 1.0::DOUBLE FROM returns JOIN security USING (sec) UNION ALL SELECT sec, month, 'sub_industry:' || sub_industry, 1.0::DOUBLE FROM returns JOIN security USING (sec)", "exposure")
def h17_industry_exposures(t):
    return exposures.industry(_returns(t), t.security())


@add("SELECT sec, month, 'country:US' AS factor, 1.0::DOUBLE AS exposure FROM returns", "exposure")
def h18_country_exposure(t):
    return exposures.country(_returns(t))


_SLOPE = "(sxy - sx * sy / n) / (syy - sy * sy / n)"
_SOURCES = {
    "size": ("ln(cap)", "returns", "cap > 0"), "beta": (_SLOPE, "b", "n >= 36"), "momentum": ("x", "mom", "true"), "earnings_yield": ("income_ttm / cap", "panel", "cap > 0"),
    "book_to_price": ("ln(book / cap)", "panel", "cap > 0 AND book > 0"), "growth": ("sales_ttm / sales_before - 1", "panel", "sales_before <> 0"), "earnings_variability": ("-income_sd", "panel", "true"),
    "leverage": ("debt / assets", "panel", "assets > 0"), "dividend_yield": ("dividends / cap", "panel", "cap > 0 AND dividends >= 0"), "currency_sensitivity": (_SLOPE, "f", "n >= 24"),
}
_STYLE = _HISTORY.strip() + "," + _BETA.strip() + "," + _FX.strip() + f""",
mom AS (SELECT sec, month, exp(s + l) - 1 AS x FROM (SELECT sec, month, count(*) OVER w AS n, sum(ln(1 + ret)) OVER w AS s, sum(ln(1 + ret)) OVER v AS l FROM returns WHERE ret IS NOT NULL
  WINDOW w AS (PARTITION BY sec ORDER BY mi RANGE BETWEEN 13 PRECEDING AND 2 PRECEDING), v AS (PARTITION BY sec ORDER BY mi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) WHERE n >= 11 AND l IS NOT NULL),
style AS ({" UNION ALL ".join(f"SELECT '{name}' AS factor, * FROM ({_z(*source)})" for name, source in _SOURCES.items())}),
grid AS (SELECT * FROM (SELECT DISTINCT sec, month FROM returns) JOIN (SELECT DISTINCT month, factor FROM style) USING (month) JOIN security USING (sec)),
g AS (SELECT g.sec, g.month, g.factor, g.industry, s.exposure FROM grid g LEFT JOIN style s ON g.sec = s.sec AND g.month = s.month AND g.factor = s.factor),
imp AS (SELECT g.sec, g.month, g.factor, coalesce(g.exposure, i.m, o.m, 0) AS exposure,
        CASE WHEN g.exposure IS NOT NULL THEN NULL WHEN coalesce(i.m, 0) <> 0 THEN 'imputed=industry' ELSE 'imputed=global' END AS flags
        FROM g JOIN (SELECT month, factor, industry, median(exposure) AS m FROM g GROUP BY ALL) i USING (month, factor, industry) JOIN (SELECT month, factor, median(exposure) AS m FROM g GROUP BY ALL) o USING (month, factor))
"""


@add("SELECT sec, month, factor, exposure, flags FROM imp", "exposure", _STYLE)
def h19_imputation(t):
    return _imputed(t)


@add("SELECT factor, count(*) AS total, count(flags) AS imputed, count(flags) / count(*) AS share, count(flags) / count(*) > 0.3 AS warn FROM imp GROUP BY factor", "share", _STYLE)
def h21_style_coverage(t):
    return exposures.coverage(_imputed(t))


@add("SELECT sec, month, factor, exposure FROM style", "exposure", _STYLE, places=4)
def h20_style_exposures(t):
    """All ten factors, clipped and standardised by month."""
    return _ten_styles(t)


_MODEL = _STYLE.strip() + """,
mdl AS (SELECT sec, month, factor, exposure FROM imp UNION ALL SELECT sec, month, 'sector:' || sector, 1.0::DOUBLE FROM returns JOIN security USING (sec) UNION ALL SELECT sec, month, 'industry:' || industry, 1.0::DOUBLE FROM returns JOIN security USING (sec)
  UNION ALL SELECT sec, month, 'sub_industry:' || sub_industry, 1.0::DOUBLE FROM returns JOIN security USING (sec) UNION ALL SELECT sec, month, 'country:US', 1.0::DOUBLE FROM returns)
"""


@add("SELECT sec, month, factor, exposure FROM mdl", "exposure", _MODEL, places=4)
def h57_combined_labels(t):
    """Every exposure of the combined model: imputed styles, industries of three levels, country."""
    return _model(t).select("sec", "month", "factor", "exposure")


@add("SELECT sec, month, sum(w * x) AS x FROM (" + " UNION ALL ".join(f"SELECT sec, month, {w}::DOUBLE AS w, exp(sum(ln(1 + ret)) OVER q) - 1 AS x, count(*) OVER q AS n, {max(1, m - 1)} AS least FROM returns WHERE ret IS NOT NULL WINDOW q AS (PARTITION BY sec ORDER BY mi RANGE BETWEEN {m} PRECEDING AND 1 PRECEDING)" for m, w in ((1, .05), (3, .15), (6, .3), (12, .5))) + ") WHERE n >= least GROUP BY ALL HAVING count(*) = 4", "x")
def k1_blended_momentum(t):
    return exposures.blended_momentum(_returns(t))


@add("""SELECT sec, month, factor, CASE WHEN stddev_pop(r) OVER p > 1e-12 THEN (r - avg(r) OVER p) / stddev_pop(r) OVER p ELSE 0 END AS exposure FROM (
  SELECT s.sec, s.month, s.factor, s.exposure - coalesce(i + k * b.exposure, 0) AS r FROM style s JOIN style b ON s.sec = b.sec AND s.month = b.month AND b.factor = 'size' AND s.factor <> 'size'
  JOIN (SELECT s.month, s.factor, regr_slope(s.exposure, b.exposure) AS k, regr_intercept(s.exposure, b.exposure) AS i FROM style s JOIN style b ON s.sec = b.sec AND s.month = b.month AND b.factor = 'size' AND s.factor <> 'size' GROUP BY ALL) f
  ON s.month = f.month AND s.factor = f.factor) WINDOW p AS (PARTITION BY month, factor)""", "exposure", _STYLE, places=4)
def k3_orthogonalised(t):
    return exposures.orthogonalise(_ten_styles(t))


@add("""SELECT month, a.factor AS fi, b.factor AS fj, sum(w.w * a.exposure * b.exposure) AS value FROM style a JOIN style b USING (sec, month) JOIN
  (SELECT sec, month, cap / sum(cap) OVER (PARTITION BY month) AS w FROM returns WHERE ret IS NOT NULL AND cap > 0) w USING (sec, month) WHERE a.factor <= b.factor AND a.exposure <> 0 AND b.exposure <> 0 GROUP BY ALL""", "value", _STYLE)
def c15_gram_matrix(t):
    return regress.gram(_ten_styles(t), regress.with_weights(_returns(t))).where("fj is not null").select("month", "fi", "fj", "value")


@add()
def h22_cross_section(t):
    return _factor_returns(t)


@add()
def h23_residuals(t):
    return _residuals(t)


@add()
def h23_r_squared(t):
    """Explained share of each month's variance."""
    return regress.r_squared(_residual_rows(t), _returns(t))


@add()
def h24_smoothed_risk(t):
    return _smoothed(t)


@add("SELECT sec, month, ret FROM returns WHERE ret IS NOT NULL", "ret", places=5)
def k6_return_attribution(t):
    """Contributions of all factors and the residual add up to the return."""
    parts = regress.attribution(_model(t), _factor_returns(t), _residuals(t))
    return parts.groupBy("sec", "month").agg(F.sum("contribution").alias("ret"))


_WINDOWED = _SMALL_FACTORS.strip() + """,
pairs AS (SELECT t.month, a.factor AS fi, b.factor AS fj, covar_samp(a.factor_return, b.factor_return) AS cov, count(*) AS n FROM (SELECT DISTINCT month FROM fr) t
  JOIN fr a ON a.month <= t.month AND a.month > last_day(t.month - INTERVAL 60 MONTH) JOIN fr b ON a.month = b.month GROUP BY ALL),
cov AS (SELECT month, fi, fj, cov FROM pairs WHERE n >= 2)
"""


@add("SELECT month, fi, fj, cov FROM cov", "cov", _WINDOWED)
def h25_factor_covariance(t):
    return covariance.factor_covariance(_plain_factors(t))


@add("""SELECT c.month, c.fi, c.fj, c.cov * a.s * b.s AS cov FROM (SELECT month, fi, fj, cov * 1000 AS cov FROM cov) c
  JOIN (SELECT month, fi, CASE WHEN cov * 1000 > 1 THEN sqrt(0.5 / (cov * 1000)) ELSE 1 END AS s FROM cov WHERE fi = fj) a ON c.month = a.month AND c.fi = a.fi
  JOIN (SELECT month, fi, CASE WHEN cov * 1000 > 1 THEN sqrt(0.5 / (cov * 1000)) ELSE 1 END AS s FROM cov WHERE fi = fj) b ON c.month = b.month AND c.fj = b.fi""", "cov", _WINDOWED)
def h56_scale_repair(t):
    return covariance.scale_repair(covariance.factor_covariance(_plain_factors(t)).withColumn("cov", F.col("cov") * 1000))


@add()
def k4_blended_covariance(t):
    return covariance.blend(_plain_factors(t))


_LARGEST = """
big AS (SELECT sec FROM (SELECT sec, row_number() OVER (ORDER BY cap DESC, sec) AS n FROM returns WHERE cap > 0 AND month = (SELECT max(month) FROM returns WHERE cap > 0)) WHERE n <= 100)
"""


def _largest(t: Tables) -> DataFrame:
    """Members of the portfolio of the latest month: the assets of a covariance request."""
    w = risk.cap_weights(_returns(t), 100)
    return w.join(w.agg(F.max("month").alias("month")), "month", "left_semi").select("sec")


@add("""SELECT a.sec AS si, b.sec AS sj, covar_samp(a.ret, b.ret) AS cov, count(*) AS n FROM returns a JOIN returns b USING (month) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND a.sec <= b.sec
  AND a.sec IN (FROM big) AND b.sec IN (FROM big) GROUP BY ALL HAVING count(*) >= 2""", "cov", _LARGEST)
def d14_pairwise_covariance(t):
    return covariance.pairwise_covariance(_returns(t).join(_largest(t), "sec", "left_semi"))


_PORTFOLIO = _STYLE.strip() + """,
top AS (SELECT month, sec, cap / sum(cap) OVER (PARTITION BY month) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY cap DESC, sec) AS n FROM returns WHERE cap > 0) WHERE n <= 100),
x AS (SELECT month, factor, sum(weight * exposure) AS x FROM top JOIN style USING (month, sec) GROUP BY ALL)
"""


@add("SELECT month, factor, x FROM x", "x", _PORTFOLIO)
def h26_portfolio_exposure(t):
    return risk.factor_exposure(risk.cap_weights(_returns(t), 100), _ten_styles(t))


@add("SELECT month, factor, x, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY abs(x) DESC, factor) AS INTEGER) AS rank FROM x) WHERE rank <= 2", "x", _PORTFOLIO)
def h29_top_exposures(t):
    return risk.top_exposures(risk.cap_weights(_returns(t), 100), _ten_styles(t), 2)


def _model_covariance(t: Tables) -> DataFrame:
    return t.keep("covariance", lambda: covariance.factor_covariance(_factor_returns(t).select("month", "factor", "factor_return")))


def _specific(t: Tables) -> DataFrame:
    return covariance.choose_specific(_residuals(t).select("sec", "month", "specific_var"), _smoothed(t))


def _held(t: Tables) -> DataFrame:
    """The portfolio: each month's hundred largest by capitalisation."""
    return t.keep("held", lambda: risk.cap_weights(_returns(t), 100))


def _summary(t: Tables) -> DataFrame:
    held = _held(t)
    return t.keep("summary", lambda: risk.summary(held, _model(t, held), _model_covariance(t), _specific(t)))


@add()
def h26_risk_summary(t):
    return _summary(t)


@add()
def h27_model_risk(t):
    return risk.model_risk(_summary(t))


@add("""SELECT month, item, rank FROM (SELECT month, item, CAST(row_number() OVER (PARTITION BY month ORDER BY variance DESC, item) AS INTEGER) AS rank FROM (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, o_orderpriority AS item, sum(o_totalprice) AS variance FROM orders GROUP BY ALL)) WHERE rank <= 3""")
def h27_top_contributions(t):
    rows = t.read("orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("month"), F.col("o_orderpriority").alias("item")).agg(F.sum("o_totalprice").alias("variance"))
    return risk.top_contributions(rows, 3).select("month", "item", "rank")


@add("""SELECT portfolio, count(*) AS n, stddev_samp(r - market_return) * sqrt(12) AS tracking_error, avg(r - market_return) AS mean_active, sum(ln(1 + r)) AS portfolio_growth, sum(ln(1 + market_return)) AS benchmark_growth FROM (
  SELECT portfolio, month, sum(weight * ret) AS r, count(*) AS c FROM pw JOIN returns USING (sec) WHERE ret IS NOT NULL GROUP BY ALL) JOIN (SELECT portfolio, count(*) AS k FROM pw GROUP BY ALL) USING (portfolio) JOIN market USING (month) WHERE c = k GROUP BY portfolio""",
     "tracking_error mean_active portfolio_growth benchmark_growth", "pw AS (SELECT industry AS portfolio, sec, 1.0::DOUBLE / count(*) OVER (PARTITION BY industry) AS weight FROM security)", places=4)
def h28_realised_tracking_error(t):
    r = _returns(t)
    w = t.security().select(F.col("industry").alias("portfolio"), "sec", (1.0 / F.count("*").over(Window.partitionBy("industry"))).alias("weight"))
    out = risk.realised_tracking_error(w, r, prices.market_returns(r).select("month", F.col("market_return").alias("bench")))
    growth = {f"{c}_growth": F.log1p(f"{c}_return") for c in ("portfolio", "benchmark")}  # compounded over years: compared as logarithms
    return out.withColumns(growth).drop("portfolio_return", "benchmark_return")


@add()
def h53_risk_components(t):
    ids = _held(t).select("month", "sec")
    return risk.risk_components(ids, _model(t, ids), _specific(t), wide.asked(_filled(t)))


@add()
def h54_asset_covariance(t):
    """Covariance of each month's hundred largest."""
    return covariance.asset_covariance(_model(t, _held(t)), _model_covariance(t), _specific(t))


@add()
def h59_ex_ante_tracking_error(t):
    w = risk.cap_weights(_returns(t))
    return risk.ex_ante_tracking_error(risk.cap_weights(_returns(t), 100), w, _model(t), _model_covariance(t))


@add("""SELECT m.month, coalesce(e.x, m.market_return) AS market_return, e.x IS NOT NULL AS external FROM market m LEFT JOIN (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, avg(o_totalprice) / 1e7 AS x FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL) e USING (month)""", "market_return")
def k7_blended_market(t):
    ext = t.read("orders").where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")).groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("month")).agg((F.avg("o_totalprice") / 1e7).alias("market_return"))
    return risk.blended_market(prices.market_returns(_returns(t)), ext)


_PANEL = """
yr AS (SELECT sec, fy, arg_max(book, mi) AS book, sum(income) AS income, arg_max(assets, mi) AS assets FROM quarters GROUP BY sec, fy),
annual AS (SELECT sec, fy, book, CASE WHEN book > 0 THEN income / book END AS op, (assets - lag(assets) OVER p) / lag(assets) OVER p AS inv FROM yr WINDOW p AS (PARTITION BY sec ORDER BY fy)),
rr AS (SELECT sec, month, ret, year(month - INTERVAL 6 MONTH) AS fy FROM returns),
fp AS (SELECT rr.sec, rr.fy, rr.month, rr.ret, exchange, j.cap AS me, a.book / d.cap AS bm, a.op, a.inv FROM rr JOIN returns j ON j.sec = rr.sec AND month(j.month) = 6 AND year(j.month) = rr.fy
       LEFT JOIN returns d ON d.sec = rr.sec AND month(d.month) = 12 AND year(d.month) + 1 = rr.fy LEFT JOIN annual a ON a.sec = rr.sec AND a.fy + 1 = rr.fy JOIN security s ON s.sec = rr.sec),
nm AS (SELECT fy, sec, arg_min(me, month) AS me, arg_min(bm, month) AS bm, arg_min(op, month) AS op, arg_min(inv, month) AS inv FROM fp WHERE exchange = 'N' GROUP BY ALL),
bp AS (SELECT fy, median(me) AS size, quantile_cont(bm, 0.3) FILTER (bm > 0) AS bm_low, quantile_cont(bm, 0.7) FILTER (bm > 0) AS bm_high, quantile_cont(op, 0.3) AS op_low, quantile_cont(op, 0.7) AS op_high,
       quantile_cont(inv, 0.3) AS inv_low, quantile_cont(inv, 0.7) AS inv_high FROM nm GROUP BY fy HAVING count(*) >= 4)
"""


def _formation(t: Tables) -> DataFrame:
    return factors.formation_panel(_returns(t), factors.annual_fundamentals(t.quarters()), t.security())


@add("SELECT sec, fy, month, ret, exchange, me, bm, op, inv FROM fp", "ret me bm op inv", _PANEL)
def h6_formation_panel(t):
    return _formation(t)


@add("SELECT * FROM bp", "size bm_low bm_high op_low op_high inv_low inv_high", _PANEL)
def h30_breakpoints(t):
    return factors.breakpoints(_formation(t), "N", 4)


_CELLS = _PANEL.strip() + """,
cl AS (SELECT month, sort, size_group, band, sum(ret * me) / sum(me) AS ret FROM (
  SELECT month, ret, me, CASE WHEN me <= size THEN 'S' WHEN me IS NOT NULL THEN 'B' END AS size_group, unnest(['bm', 'op', 'inv']) AS sort,
    unnest([CASE WHEN bm <= bm_low THEN 'L' WHEN bm <= bm_high THEN 'M' WHEN bm IS NOT NULL THEN 'H' END, CASE WHEN op <= op_low THEN 'L' WHEN op <= op_high THEN 'M' WHEN op IS NOT NULL THEN 'H' END,
            CASE WHEN inv <= inv_low THEN 'L' WHEN inv <= inv_high THEN 'M' WHEN inv IS NOT NULL THEN 'H' END]) AS band FROM fp JOIN bp USING (fy)) WHERE band IS NOT NULL AND size_group IS NOT NULL AND ret IS NOT NULL GROUP BY ALL)
"""


@add("SELECT * FROM cl", "ret", _CELLS)
def h31_cell_returns(t):
    p = _formation(t)
    return factors.cell_returns(factors.assign(p, factors.breakpoints(p, "N", 4)))


def _cell(sort: str, group: str, band: str) -> str:
    return f"max(CASE WHEN sort = '{sort}' AND size_group = '{group}' AND band = '{band}' THEN ret END)"


def _high_less_low(sort: str) -> str:
    return f"({_cell(sort, 'S', 'H')} + {_cell(sort, 'B', 'H')}) / 2 - ({_cell(sort, 'S', 'L')} + {_cell(sort, 'B', 'L')}) / 2"


def _small_less_big(sort: str) -> str:
    return "(" + " + ".join(f"{_cell(sort, 'S', b)} - {_cell(sort, 'B', b)}" for b in "LMH") + ") / 3"


@add(f"SELECT month, ({' + '.join(_small_less_big(c) for c in ('bm', 'op', 'inv'))}) / 3 AS SMB, {_high_less_low('bm')} AS HML, {_high_less_low('op')} AS RMW, -({_high_less_low('inv')}) AS CMA FROM cl GROUP BY month", "SMB HML RMW CMA", _CELLS)
def h31_factor_returns(t):
    p = _formation(t)
    return factors.factor_returns(factors.cell_returns(factors.assign(p, factors.breakpoints(p, "N", 4))))


@add()
def h33_factor_ols(t):
    """Excess returns on the five factors built here; orders stand in for the riskless rate."""
    p = _formation(t)
    five = factors.factor_returns(factors.cell_returns(factors.assign(p, factors.breakpoints(p, "N", 4))))
    free = t.read("orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("month")).agg((F.avg("o_totalprice") / 1e8).alias("free"))
    series = five.join(prices.market_returns(_returns(t)).select("month", "market_return"), "month").join(free, "month")
    series = t.keep("five", lambda: series.withColumn("MKT", F.col("market_return") - F.col("free")).drop("market_return"))
    excess = _returns(t).join(series.select("month", "free"), "month").select("sec", "month", (F.col("ret") - F.col("free")).alias("ret"))
    return regress.factor_ols(excess, series.drop("free"), ["MKT", "SMB", "HML", "RMW", "CMA"])


@add("""SELECT month, factor, corr(re, rr) AS ic, count(*) AS n FROM (
  SELECT month, factor, rank() OVER (PARTITION BY month, factor ORDER BY exposure) + (count(*) OVER (PARTITION BY month, factor, exposure) - 1) / 2.0 AS re,
         rank() OVER (PARTITION BY month, factor ORDER BY ret) + (count(*) OVER (PARTITION BY month, factor, ret) - 1) / 2.0 AS rr
  FROM style JOIN (SELECT sec, last_day(month - INTERVAL 1 MONTH) AS month, ret FROM returns WHERE ret IS NOT NULL) USING (sec, month)) GROUP BY month, factor""", "ic", _STYLE, places=4)
def k5_information_coefficient(t):
    return wide.information_coefficient(_styles(t))


@add("SELECT sec, fy, fq, sales AS quarter, CASE WHEN count(*) OVER w = 4 THEN sum(sales) OVER w END AS ttm FROM quarters WINDOW w AS (PARTITION BY sec ORDER BY fy, fq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "quarter ttm", places=2)
def h2_quarterly_features(t):
    w = Window.partitionBy("sec", "fy").orderBy("fq").rowsBetween(Window.unboundedPreceding, 0)
    rows = t.quarters().select("sec", "fy", "fq", F.last_day(F.make_date("fy", F.col("fq") * 3, F.lit(1))).alias("d"), F.sum("sales").over(w).alias("ytd"))
    rows = rows.drop("fy", "fq").withColumn("fyr", F.lit(12))
    return fundamentals.quarterly_features(rows).select("sec", "fy", "fq", F.col("quarter"), "ttm")


_SCORES = """
sc AS (SELECT sec, month, exp(s + l) - 1 AS score FROM (SELECT sec, month, count(*) OVER w AS n, sum(ln(1 + ret)) OVER w AS s, sum(ln(1 + ret)) OVER v AS l FROM returns WHERE ret IS NOT NULL
  WINDOW w AS (PARTITION BY sec ORDER BY mi RANGE BETWEEN 13 PRECEDING AND 2 PRECEDING), v AS (PARTITION BY sec ORDER BY mi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) WHERE n >= 11 AND l IS NOT NULL)
"""


def _scores(t: Tables) -> DataFrame:
    return exposures.momentum(_returns(t)).withColumnRenamed("x", "score").where("score is not null")


@add("SELECT sec, month, CAST(ntile(10) OVER (PARTITION BY month ORDER BY round(score, 9) DESC, sec) AS INTEGER) AS decile FROM sc", "", _SCORES)
def f4_deciles(t):
    return backtest.deciles(_scores(t).withColumn("score", F.round("score", 9))).select("sec", "month", "decile")


@add("SELECT month, sec, CASE WHEN a <= 5 THEN 'long' ELSE 'short' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(score, 9) DESC, sec) AS a, row_number() OVER (PARTITION BY month ORDER BY round(score, 9), sec DESC) AS b FROM sc) WHERE a <= 5 OR b <= 5", "", _SCORES)
def f3_long_short_legs(t):
    return backtest.legs(_scores(t).withColumn("score", F.round("score", 9)), 5).drop("score")


def _history(t: Tables) -> DataFrame:
    """Of the two best and the two worst deciles."""
    return t.keep("histories", lambda: backtest.histories(backtest.decile_legs(_scores(t).withColumn("score", F.round("score", 9))), _returns(t)))


@add("""SELECT month, sec, round(score, 9) AS score, side, last_day(r_month) AS at, ret FROM (SELECT l.*, r.month AS r_month, r.ret, count(*) OVER (PARTITION BY l.month, l.sec) AS n FROM
  (SELECT sec, month, score, year(month) * 12 + month(month) - 1 AS mi, CASE WHEN decile <= 2 THEN 'long' WHEN decile >= 9 THEN 'short' END AS side FROM (SELECT *, ntile(10) OVER (PARTITION BY month ORDER BY round(score, 9) DESC, sec) AS decile FROM sc)) l
  JOIN returns r ON r.sec = l.sec AND r.mi BETWEEN l.mi - 36 AND l.mi - 1 WHERE side IS NOT NULL AND ret IS NOT NULL) WHERE n >= 12""", "score ret", _SCORES)
def h36_backtest_histories(t):
    return _history(t).select("month", "sec", "score", "side", "at", "ret")


@add()
def h37a_long_short_weights(t):
    return backtest.long_short_weights(_history(t), bound=0.1)


@add()
def h37b_tilted_weights(t):
    return backtest.tilted_weights(_history(t))


@add()
def h37c_tracking_weights(t):
    bench = prices.market_returns(_returns(t)).select(F.col("month").alias("at"), F.col("market_return").alias("bench"))
    return backtest.tracking_weights(_history(t), bench)


@add()
def h38_strategy_performance(t):
    return backtest.performance(backtest.strategy_returns(backtest.tilted_weights(_history(t)), _returns(t)), "strategy")


@add()
def q1_model_checks(t):
    """Checks of the model itself: its imputed styles, industries, residuals and covariance."""
    r = _returns(t)
    return quality.model_checks(_imputed(t), exposures.industry(r, t.security()), _residuals(t), _model_covariance(t))


_SECTORS = """
fs AS (SELECT month, sector AS factor, avg(ret) AS factor_return FROM returns JOIN security USING (sec) WHERE ret IS NOT NULL GROUP BY ALL),
fr AS (SELECT * FROM fs WHERE month IN (SELECT month FROM fs GROUP BY month HAVING count(*) = (SELECT count(DISTINCT factor) FROM fs))),
cov AS (SELECT month, fi, fj, cov FROM (SELECT t.month, a.factor AS fi, b.factor AS fj, covar_samp(a.factor_return, b.factor_return) AS cov, count(*) AS n FROM (SELECT DISTINCT month FROM fr) t
  JOIN fr a ON a.month <= t.month AND a.month > last_day(t.month - INTERVAL 60 MONTH) JOIN fr b ON a.month = b.month GROUP BY ALL) WHERE n >= 2),
ex AS (SELECT sec, month, sector AS factor, 1.0::DOUBLE AS exposure FROM returns JOIN security USING (sec)),
sp AS (SELECT r.sec, r.month, (ret - factor_return) * (ret - factor_return) AS specific_var FROM returns r JOIN security s USING (sec) JOIN fs ON fs.month = r.month AND fs.factor = s.sector WHERE ret IS NOT NULL),
hw AS (SELECT month, sec, cap / sum(cap) OVER (PARTITION BY month) AS weight FROM (SELECT month, sec, cap, row_number() OVER (PARTITION BY month ORDER BY cap DESC, sec) AS n FROM returns WHERE cap > 0) WHERE n <= 100),
px AS (SELECT month, factor, sum(weight * exposure) AS x FROM hw JOIN ex USING (sec, month) GROUP BY ALL),
pt AS (SELECT a.month, a.factor AS item, a.x AS exposure, a.x * coalesce(sum(c.cov * b.x), 0) AS variance FROM px a LEFT JOIN cov c ON c.month = a.month AND c.fi = a.factor LEFT JOIN px b ON b.month = a.month AND b.factor = c.fj GROUP BY a.month, a.factor, a.x
       UNION ALL SELECT month, 'specific', NULL, sum(weight * weight * specific_var) FROM hw JOIN sp USING (sec, month) GROUP BY month),
su AS (SELECT * FROM pt UNION ALL SELECT month, 'total', NULL, sum(variance) FROM pt GROUP BY month)
"""


def _sector_risk(t: Tables):
    """A risk model that SQL can state as well: sectors as factors, what their mean return leaves as specific risk."""
    r = _returns(t).join(t.security().select("sec", "sector"), "sec")
    series = t.keep("sector_series", lambda: r.where("ret is not null").groupBy("month", F.col("sector").alias("factor")).agg(F.avg("ret").alias("factor_return")))
    own = r.where("ret is not null").join(series.withColumnRenamed("factor", "sector"), ["month", "sector"])
    rest = F.col("ret") - F.col("factor_return")
    exposures_ = r.select("sec", "month", F.col("sector").alias("factor"), F.lit(1.0).alias("exposure"))
    return exposures_, t.keep("sector_covariance", lambda: covariance.factor_covariance(series)), own.select("sec", "month", (rest * rest).alias("specific_var"))


@add("SELECT month, item, exposure, variance FROM su", "exposure variance", _SECTORS)
def h26_sector_risk_summary(t):
    return risk.summary(risk.cap_weights(_returns(t), 100), *_sector_risk(t))


@add("""SELECT month, specific_variance, total_variance, total_variance - coalesce(specific_variance, 0) AS factor_variance, sqrt(greatest(total_variance, 0)) AS monthly_vol, sqrt(greatest(total_variance, 0)) * sqrt(12) AS annual_vol
  FROM (SELECT month, sum(CASE WHEN item = 'specific' THEN variance END) AS specific_variance, sum(CASE WHEN item = 'total' THEN variance END) AS total_variance FROM su GROUP BY month)""", "specific_variance total_variance factor_variance monthly_vol annual_vol", _SECTORS)
def h27_sector_model_risk(t):
    return risk.model_risk(risk.summary(risk.cap_weights(_returns(t), 100), *_sector_risk(t)))


@add("SELECT month, sec, factor, coalesce(e.exposure, 0) AS exposure, coalesce(specific_var, 0.1) AS specific_var FROM hw JOIN (SELECT DISTINCT month, factor FROM ex) USING (month) LEFT JOIN ex e USING (month, sec, factor) LEFT JOIN sp USING (month, sec)", "exposure specific_var", _SECTORS)
def h53_sector_risk_components(t):
    x, _, specific = _sector_risk(t)
    return risk.risk_components(risk.cap_weights(_returns(t), 100).select("month", "sec"), x, specific)


@add("""SELECT a.month, a.sec AS si, b.sec AS sj, c.cov + CASE WHEN a.sec = b.sec THEN coalesce(specific_var, 0) ELSE 0 END AS cov FROM hx a JOIN hx b ON a.month = b.month JOIN cov c ON c.month = a.month AND c.fi = a.factor AND c.fj = b.factor
  LEFT JOIN sp ON sp.sec = a.sec AND sp.month = a.month AND a.sec = b.sec""", "cov", _SECTORS.strip() + ", hx AS (SELECT ex.* FROM ex JOIN hw USING (sec, month))")
def h54_sector_asset_covariance(t):
    """Of each month's hundred largest."""
    x, cov, specific = _sector_risk(t)
    held = risk.cap_weights(_returns(t), 100).select("month", "sec")
    return covariance.asset_covariance(x.join(held, ["month", "sec"], "left_semi"), cov, specific)


@add("SELECT sec, month, CASE WHEN year(month) = 1997 THEN specific_var / 2 ELSE specific_var END AS specific_var FROM sp WHERE year(month) <> 1997 OR sec % 2 = 0", "specific_var", _SECTORS)
def h58_chosen_specific(t):
    """Months of 1997 have smoothed values, for some names only; all other months have raw ones."""
    raw = _sector_risk(t)[2]
    smoothed = raw.where("year(month) = 1997 and sec % 2 = 0").withColumn("specific_var", F.col("specific_var") / 2)
    return covariance.choose_specific(raw, smoothed)


@add("""SELECT month, sqrt(greatest(sum(c.cov * a.x * b.x), 0)) AS tracking_error FROM ax a JOIN cov c ON c.month = a.month AND c.fi = a.factor JOIN ax b ON b.month = a.month AND b.factor = c.fj GROUP BY a.month""".replace("SELECT month,", "SELECT a.month,"), "tracking_error",
     _SECTORS.strip() + """, mw AS (SELECT month, sec, cap / sum(cap) OVER (PARTITION BY month) AS weight FROM returns WHERE cap > 0),
  ax AS (SELECT month, factor, sum(w * exposure) AS x FROM (SELECT month, sec, weight AS w FROM hw UNION ALL SELECT month, sec, -weight FROM mw) JOIN ex USING (sec, month) GROUP BY ALL)""")  # fmt: skip
def h59_sector_tracking_error(t):
    x, cov, _ = _sector_risk(t)
    return risk.ex_ante_tracking_error(risk.cap_weights(_returns(t), 100), risk.cap_weights(_returns(t)), x, cov)
