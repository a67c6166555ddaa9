"""Queries on listings, annual features, fills, ledgers and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import covariance, factors, filings, fundamentals, items, lots, prices, quality, rebalance
from tidemark.plans.accounts import AS_OF, _account_returns, _target, _weights
from tidemark.plans.models import _LARGEST, _PANEL, _WINDOWED, _formation, _largest, _plain_factors, _returns
from tidemark.plans.registry import Registry
from tidemark.plans.standins import Tables

registry = Registry()
add = registry.add
QUERIES, ORACLE_SQL = registry.queries, registry.sql

_ANNUAL = """
an AS (SELECT l_suppkey AS sec, year(CAST(l_shipdate AS DATE)) AS fy, CASE WHEN l_linestatus = 'O' THEN 'STD' ELSE 'SUM' END AS datafmt, CASE WHEN l_returnflag = 'N' THEN 'C' ELSE 'P' END AS consol,
       sum(l_extendedprice) AS sales FROM lineitem GROUP BY ALL),
an1 AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY sec, fy ORDER BY datafmt = 'STD' DESC, consol = 'C' DESC, datafmt, consol) = 1)
"""


def _annual(t: Tables) -> DataFrame:
    d = F.col("l_shipdate").cast("date")
    keys = [F.col("l_suppkey").alias("sec"), F.year(d).alias("fy"), F.when(F.col("l_linestatus") == "O", "STD").otherwise("SUM").alias("datafmt"), F.when(F.col("l_returnflag") == "N", "C").otherwise("P").alias("consol")]
    return t.read("lineitem").groupBy(*keys).agg(F.sum("l_extendedprice").alias("sales"))


@add("SELECT * FROM an1", "sales", _ANNUAL, places=2)
def e3_preferred_source(t):
    return fundamentals.dedup_standard(_annual(t), ["sec", "fy"])


@add("SELECT r.sec, r.month, r.ret, a.datafmt, a.consol, a.sales FROM returns r LEFT JOIN an1 a ON a.sec = r.sec AND a.fy = year(r.month)", "ret sales", _ANNUAL, places=4)
def h1_annual_features(t):
    return fundamentals.annual_features(_returns(t), _annual(t)).select("sec", "month", "ret", "datafmt", "consol", "sales")


_LISTED = """
li AS (SELECT industry AS company, exchange, CAST(sec % 3 AS VARCHAR) AS kind, sec AS issue FROM security),
pl AS (SELECT * FROM li QUALIFY row_number() OVER (PARTITION BY company ORDER BY CASE kind WHEN '0' THEN 0 WHEN '1' THEN 1 ELSE 2 END, CASE WHEN exchange IN ('N', 'A', 'Q') THEN 0 ELSE 1 END, issue) = 1)
"""


def _primary(t: Tables) -> DataFrame:
    s = t.security().select(F.col("industry").alias("company"), "exchange", (F.col("sec") % 3).cast("string").alias("kind"), F.col("sec").alias("issue"))
    return prices.primary_listing(s)


@add("SELECT * FROM pl", "", _LISTED)
def e4_primary_listing(t):
    return _primary(t)


@add("""SELECT company, month, price / lag(price) OVER (PARTITION BY company ORDER BY month) - 1 AS ret FROM (SELECT sec, last_day(d) AS month, arg_max(price, d) AS price FROM daily
  WHERE d BETWEEN DATE '1995-06-01' AND DATE '2000-12-31' AND isodow(d) <= 5 GROUP BY ALL) m JOIN pl ON issue = sec""", "ret", _LISTED)
def h35_listing_returns(t):
    """Monthly returns of each company's primary listing, from weekdays in a range of dates."""
    daily = prices.weekdays(t.daily(), "1995-06-01", "2000-12-31")
    listed = _primary(t).select("company", F.col("issue").alias("sec"))
    return prices.monthly_returns(prices.monthly_prices(daily)).join(listed, "sec").select("company", "month", "ret")


@add("SELECT q.sec, q.d, price FROM (SELECT DISTINCT l_suppkey AS sec, CAST(l_shipdate AS DATE) + 1 AS d FROM lineitem) q LEFT JOIN daily USING (sec, d)", "price")
def c8_price_on_date(t):
    ask = t.read("lineitem").select(F.col("l_suppkey").alias("sec"), F.date_add(F.col("l_shipdate").cast("date"), 1).alias("d")).distinct()
    return prices.on_date(ask, t.daily())


@add("SELECT sector AS benchmark, sec, month AS effective, cap AS weight FROM monthly JOIN security USING (sec) QUALIFY rank() OVER (PARTITION BY sector ORDER BY month DESC) = 1", "weight", places=4)
def c9_benchmark_weights(t):
    rows = prices.monthly_prices(t.daily()).join(t.security(), "sec")
    return rebalance.benchmark_weights(rows.select(F.col("sector").alias("benchmark"), "sec", F.col("month").alias("effective"), F.col("cap").alias("weight")))


@add("SELECT p_partkey AS part, lpad(CAST(p_partkey * 37 % 10000 AS VARCHAR), 4, '0') AS code FROM part WHERE substr(lpad(CAST(p_partkey * 37 % 10000 AS VARCHAR), 4, '0'), 1, 2) NOT BETWEEN '60' AND '69'")
def b4_without_codes(t):
    rows = t.read("part").select(F.col("p_partkey").alias("part"), F.lpad((F.col("p_partkey") * 37 % 10000).cast("string"), 4, "0").alias("code"))
    return fundamentals.without_codes(rows, "code", "60", "69")


@add("SELECT min(fy) AS first, max(fy) AS last FROM fp", "", _PANEL)
def d17_formation_range(t):
    return factors.formation_range(_formation(t))


@add("SELECT sec, max(me) AS me FROM fp GROUP BY sec ORDER BY me DESC NULLS LAST, sec LIMIT 10", "me", _PANEL, places=4)
def f5_largest_names(t):
    return factors.largest_names(_formation(t), 10)


@add("""SELECT a.sec AS si, b.sec AS sj, covar_samp(a.r, b.r) * 252 AS cov FROM f a JOIN f b USING (mi) WHERE a.sec <= b.sec GROUP BY ALL""", "cov",
     _LARGEST.strip() + """, v AS (SELECT sec, mi, ret FROM returns WHERE sec IN (FROM big)),
g AS (SELECT s.sec, m.mi, v.ret FROM (SELECT DISTINCT sec FROM v) s, (SELECT DISTINCT mi FROM v WHERE ret IS NOT NULL) m LEFT JOIN v ON v.sec = s.sec AND v.mi = m.mi),
f AS (SELECT sec, mi, coalesce(last_value(ret IGNORE NULLS) OVER (PARTITION BY sec ORDER BY mi ROWS UNBOUNDED PRECEDING), first_value(ret IGNORE NULLS) OVER (PARTITION BY sec ORDER BY mi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS r FROM g)""", places=4)  # fmt: skip
def h55_historical_covariance(t):
    return covariance.historical_covariance(prices.filled(_returns(t).join(_largest(t), "sec", "left_semi")))


@add("""SELECT sec, fy, sum(rate * w) / sum(w) AS growth, count(*) AS horizons FROM (SELECT a.sec, a.fy, w, power(a.v / b.v, 1.0 / h) - 1 AS rate FROM y a, (VALUES (1, 0.5::DOUBLE), (3, 0.3), (5, 0.2)) t(h, w) JOIN y b ON b.sec = a.sec AND b.fy = a.fy - h
  WHERE a.v > 0 AND b.v > 0) GROUP BY ALL""", "growth", "y AS (SELECT sec, fy, sum(sales) AS v FROM quarters GROUP BY ALL)")
def k2_multi_horizon_growth(t):
    return fundamentals.multi_horizon_growth(t.quarters().groupBy("sec", "fy").agg(F.sum("sales").alias("value")))


@add("SELECT sec, fy, v / b - 1 AS growth FROM (SELECT sec, fy, v, lag(v) OVER w AS b, lag(fy) OVER w AS p FROM (SELECT sec, fy, arg_max(sales, mi) AS v FROM quarters GROUP BY ALL) WINDOW w AS (PARTITION BY sec ORDER BY fy)) WHERE p = fy - 1", "growth")
def e10_annual_growth(t):
    return fundamentals.annual_growth(t.quarters())


@add("SELECT sec, month, price * floor(cap / price) AS me, ret * 100 / 100 AS ret, lag(price * floor(cap / price)) OVER (PARTITION BY sec ORDER BY month) AS me_before FROM returns", "me ret me_before", places=4)
def h4_market_equity(t):
    rows = _returns(t).select("sec", "month", "price", F.floor(F.col("cap") / F.col("price")).alias("shares"), (F.col("ret") * 100).alias("ret_pct"))
    return prices.market_equity(rows)


@add("""SELECT sec, fy, coalesce(seq, ceq + coalesce(pstk, 0), "at" - lt) + coalesce(txditc, 0) - coalesce(pstk, 0) AS book FROM (SELECT sec, fy, "at", lt, CASE WHEN sec % 3 = 0 THEN "at" - lt + 1 END AS seq, CASE WHEN sec % 3 = 1 THEN "at" / 2 END AS ceq,
  CASE WHEN sec % 2 = 0 THEN lt / 10 END AS pstk, CASE WHEN fy % 2 = 0 THEN lt / 20 END AS txditc FROM (SELECT sec, fy, sum(assets) AS "at", sum(debt) AS lt FROM quarters GROUP BY ALL))""", "book", places=3)
def h5_book_equity(t):
    rows = t.quarters().groupBy("sec", "fy").agg(F.sum("assets").alias("at"), F.sum("debt").alias("lt"))
    none = F.lit(None).cast("double")
    rows = rows.withColumns({"seq": F.when(F.col("sec") % 3 == 0, F.col("at") - F.col("lt") + 1), "ceq": F.when(F.col("sec") % 3 == 1, F.col("at") / 2), "pstk": F.when(F.col("sec") % 2 == 0, F.col("lt") / 10), "pstkl": none, "pstkrv": none, "txditc": F.when(F.col("fy") % 2 == 0, F.col("lt") / 20)})
    return fundamentals.book_equity(rows).select("sec", "fy", "book")


@add("SELECT month, fi, fj, cov / CASE WHEN top > 1e4 THEN 1e4 WHEN top > 100 THEN 100 ELSE 1 END AS cov FROM (SELECT month, fi, fj, cov * 1e5 AS cov, max(CASE WHEN fi = fj THEN cov * 1e5 END) OVER (PARTITION BY month) AS top FROM cov)", "cov", _WINDOWED)
def h56_unit_guard(t):
    return covariance.unit_guard(covariance.factor_covariance(_plain_factors(t)).withColumn("cov", F.col("cov") * 1e5))


@add("""SELECT 'f1' AS factor, corr(a1, b1) AS corr FROM j UNION ALL SELECT 'f2', corr(a2, b2) FROM j""", "corr", _WINDOWED.strip() + """,
w AS (SELECT month, max(CASE WHEN factor = '1-URGENT' THEN factor_return END) AS a1, max(CASE WHEN factor = '2-HIGH' THEN factor_return END) AS a2, max(CASE WHEN factor = '3-MEDIUM' THEN factor_return END) AS b1, max(CASE WHEN factor = '5-LOW' THEN factor_return END) AS b2 FROM fr0 GROUP BY month),
j AS (SELECT * FROM w WHERE a1 IS NOT NULL AND a2 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL)""")
def h32_factor_correlations(t):
    wide = _plain_factors(t).groupBy("month").pivot("factor", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]).agg(F.first("factor_return")).toDF("month", "f1", "f2", "g1", "g2")
    ours, official = wide.select("month", "f1", "f2"), wide.select("month", F.col("g1").alias("f1"), F.col("g2").alias("f2"))
    return factors.correlations(factors.combine(ours, official, ["f1", "f2"]), ["f1", "f2"])


_WT = """
pos AS (SELECT acct, sec, sum(CASE WHEN side = 'B' THEN qty ELSE -qty END) AS quantity FROM trades GROUP BY ALL HAVING sum(CASE WHEN side = 'B' THEN qty ELSE -qty END) > 1e-9),
wt AS (SELECT acct, sec, quantity, price, quantity * price AS value FROM pos JOIN last_prices USING (sec)),
tg AS (SELECT acct, sec, sum(value) OVER (PARTITION BY acct) / count(*) OVER (PARTITION BY acct) / price AS want, quantity FROM wt)
"""


@add("SELECT acct, sec, CASE WHEN abs(want - quantity) > 0.01 THEN want ELSE quantity END AS quantity FROM tg", "quantity", _WT, places=4)
def h66_applied_trades(t):
    """Positions once the trades towards the target are booked; short positions are left out."""
    w = _weights(t)
    orders = rebalance.trades(w, _target(t), t.last_prices(), w.groupBy("acct").agg(F.sum("value").alias("total")))
    ledger = t.trades().join(w.select("acct", "sec"), ["acct", "sec"], "left_semi")
    booked = rebalance.apply_trades(ledger, orders.join(t.last_prices(), "sec").withColumn("d", F.lit(AS_OF).cast("date")))
    return lots.positions(booked).select("acct", "sec", "quantity")


@add("SELECT o_custkey AS key, field, ours, theirs, CASE WHEN ours IS NULL AND theirs IS NULL THEN 'both_missing' WHEN ours IS NULL THEN 'missing' WHEN theirs IS NULL THEN 'extra' WHEN abs(ours - theirs) <= 0.01 * abs(theirs) THEN 'match' ELSE 'mismatch' END AS status FROM ("
     "SELECT o_custkey, unnest(['total', 'largest']) AS field, unnest([sum(CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END), max(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END)]) AS ours, unnest([sum(o_totalprice), max(o_totalprice)]) AS theirs FROM orders GROUP BY o_custkey)", "ours theirs", places=2)  # fmt: skip
def q3_company_fields(t):
    o = t.read("orders").withColumnRenamed("o_custkey", "key")
    ours = o.groupBy("key").agg(F.sum(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice"))).alias("total"), F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("largest"))
    return quality.compare_fields(ours, o.groupBy("key").agg(F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("largest")), "key", ["total", "largest"])


@add("""SELECT company, coalesce(a, b + c) AS receivables, coalesce(b, coalesce(a, b + c) - c) AS trade, coalesce(c, coalesce(a, b + c) - coalesce(b, coalesce(a, b + c) - c)) AS other FROM (SELECT o_custkey AS company, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS a,
  sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS b, sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) AS c FROM orders GROUP BY ALL)""", "receivables trade other", places=2)
def j15_breakouts(t):
    wide = t.read("orders").groupBy(F.col("o_custkey").alias("company")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.sum("o_totalprice")).toDF("company", "receivables", "trade", "other")
    return items.breakouts(wide, [("receivables", "trade", "other")])


@add("""SELECT id, tag, context, value FROM (SELECT o_custkey AS id, o_orderpriority AS tag, CASE o_orderkey % 4 WHEN 0 THEN 'FY_Qtr' WHEN 1 THEN 'D2020' WHEN 2 THEN 'cYTD' END AS context, o_totalprice AS value FROM orders)
  QUALIFY row_number() OVER (PARTITION BY id, tag ORDER BY CASE WHEN context IS NULL THEN 3 WHEN context = 'FY_Qtr' THEN 0 WHEN context = 'cYTD' THEN 2 ELSE 1 END, context, abs(value) DESC) = 1""", "value", places=2)
def j5_value_by_context(t):
    k = F.col("o_orderkey") % 4
    context = F.when(k == 0, "FY_Qtr").when(k == 1, "D2020").when(k == 2, "cYTD")
    return filings.choose_by_context(t.read("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("tag"), context.alias("context"), F.col("o_totalprice").alias("value")))
