"""Queries on lots, tax, harvesting, accounts and rebalancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import harvest, lots, prices, rebalance
from tidemark.plans.registry import Registry
from tidemark.plans.standins import Tables

registry = Registry()
add = registry.add
QUERIES, ORACLE_SQL = registry.queries, registry.sql
AS_OF = "2001-12-31"

_LOTS = """
run AS (SELECT *, sum(qty) OVER (PARTITION BY acct, sec, side ORDER BY d, seq ROWS UNBOUNDED PRECEDING) AS hi FROM trades),
b AS (SELECT acct, sec, seq AS lot, d AS bought, qty, price, hi, hi - qty AS lo FROM run WHERE side = 'B'),
s AS (SELECT acct, sec, seq AS sale, d AS sold, qty AS sale_qty, price AS sale_price, hi, hi - qty AS lo FROM run WHERE side = 'S'),
m AS (SELECT b.acct, b.sec, lot, bought, b.price AS cost_price, sale, sold, sale_qty, sale_price, least(b.hi, s.hi) - greatest(b.lo, s.lo) AS used FROM b JOIN s ON b.acct = s.acct AND b.sec = s.sec AND greatest(b.lo, s.lo) < least(b.hi, s.hi)),
op AS (SELECT b.acct, b.sec, lot, bought, least(b.qty, greatest(0, b.hi - coalesce(t.sold, 0))) AS remaining, price FROM b LEFT JOIN (SELECT acct, sec, sum(qty) AS sold FROM trades WHERE side = 'S' GROUP BY ALL) t ON b.acct = t.acct AND b.sec = t.sec),
ol AS (SELECT *, remaining * price AS cost FROM op WHERE remaining > 1e-9),
ben AS (SELECT o.acct, o.sec, lot, bought, CAST(DATE '2001-12-31' - bought AS INTEGER) AS held_days, remaining * (l.price - o.price) AS gain, CASE WHEN DATE '2001-12-31' - bought >= 365 THEN long_rate ELSE short_rate END AS rate,
        CASE WHEN remaining * (l.price - o.price) < 0 THEN -remaining * (l.price - o.price) * CASE WHEN DATE '2001-12-31' - bought >= 365 THEN long_rate ELSE short_rate END ELSE 0 END AS benefit, remaining * l.price AS market_value
        FROM ol o JOIN last_prices l ON o.sec = l.sec JOIN accounts a ON o.acct = a.acct)
"""


def _buys(t: Tables) -> DataFrame:
    return t.ledger().where("side = 'B'")


def _sales(t: Tables) -> DataFrame:
    return t.ledger().where("side = 'S'").select("acct", "sec", "d", F.col("seq").alias("lot"))


def _benefits(t: Tables, near: int | None = None) -> DataFrame:
    """Of the open lots; with ``near``, ``wash`` tells whether another purchase is within so many days of the lot's."""
    open_ = lots.open_lots(t.ledger(), near=near).join(t.last_prices().withColumnRenamed("price", "last"), "sec")
    if near is not None:
        open_ = open_.withColumn("wash", F.col("purchases") > 0)
    return harvest.tax_benefit(open_, t.accounts(), AS_OF)


@add("SELECT acct, sec, lot, sale, used FROM m", "used", _LOTS)
def h39_fifo_matches(t):
    return lots.fifo(t.ledger()).select("acct", "sec", "lot", "sale", "used")


@add("SELECT acct, sec, lot, sale, used FROM m WHERE bought <= sold", "used", _LOTS)
def h39_fifo_causal(t):
    return lots.fifo(t.ledger(), causal=True).select("acct", "sec", "lot", "sale", "used")


@add("SELECT acct, sec, lot, bought, remaining, price, cost FROM ol", "remaining price cost", _LOTS, places=4)
def h39_open_lots(t):
    return lots.open_lots(t.ledger())


@add("""SELECT DISTINCT b.acct, b.sec, b.lot, b.bought FROM b JOIN (SELECT acct, sec, sale, sold FROM m GROUP BY acct, sec, sale, sold, sale_qty, sale_price HAVING sale_qty * sale_price < sum(used * cost_price)) l
  ON b.acct = l.acct AND b.sec = l.sec AND abs(b.bought - l.sold) <= 30""", "", _LOTS)
def h40_loss_sale_flags(t):
    return lots.loss_sale_flags(lots.fifo(t.ledger()), t.ledger())


@add("SELECT acct, sec, lot, CAST(DATE '2001-12-31' - bought AS INTEGER) AS held_days, CASE WHEN DATE '2001-12-31' - bought < 365 THEN 'short' ELSE 'long' END AS term, cost FROM ol", "cost", _LOTS, places=4)
def h41_term_classification(t):
    return lots.classify(lots.open_lots(t.ledger()), AS_OF).select("acct", "sec", "lot", "held_days", "term", "cost")


@add("SELECT acct, sec, sum(CASE WHEN side = 'B' THEN qty ELSE -qty END) AS quantity, count(*) AS trades FROM trades GROUP BY ALL HAVING abs(sum(CASE WHEN side = 'B' THEN qty ELSE -qty END)) > 1e-9", "quantity")
def h42_positions(t):
    return lots.positions(t.trades())


@add("SELECT acct, sec, lot, sale, sold, used, used * (sale_price - cost_price) AS gain, CASE WHEN sold - bought < 365 THEN 'short' ELSE 'long' END AS term FROM m", "used gain", _LOTS, places=4)
def h42_realised_gains(t):
    return lots.realised_gains(lots.fifo(t.ledger()))


@add("SELECT acct, sec, d, seq, side, qty, price FROM trades WHERE d BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND side = 'S'", "qty price")
def h43_filtered_ledger(t):
    return lots.history(t.trades(), "1997-01-01", "1997-06-30", "S")


_WASH = """
sl AS (SELECT acct, sec, d, seq AS lot FROM trades WHERE side = 'S'),
wash AS (SELECT s.acct, s.sec, s.d, s.lot, count(b.seq) AS purchases, count(b.seq) > 0 AS wash FROM sl s LEFT JOIN (SELECT * FROM trades WHERE side = 'B') b ON s.acct = b.acct AND s.sec = b.sec AND abs(b.d - s.d) <= 30 GROUP BY ALL)
"""


@add("SELECT * FROM wash", "", _WASH)
def h44_wash_sales(t):
    return harvest.wash_sales(_sales(t), _buys(t))


@add("""SELECT acct, d, string_agg(sec, ',' ORDER BY sec) AS excluded, count(*) AS n_excluded FROM (SELECT acct, d, sec FROM sl UNION SELECT s.acct, s.d, b.sec FROM sl s JOIN trades b ON s.acct = b.acct AND b.side = 'B' AND abs(b.d - s.d) <= 30) GROUP BY ALL""", "", _WASH)
def h45_wash_exclusions(t):
    return harvest.excluded_securities(_sales(t), _buys(t)).withColumn("excluded", F.array_join("excluded", ","))


@add("SELECT * FROM ben", "gain benefit market_value rate", _LOTS, places=4)
def h46_tax_benefit(t):
    return _benefits(t)


@add("""SELECT *, CASE WHEN short_loss + long_loss > 0 THEN (short_benefit + long_benefit) / (short_loss + long_loss) ELSE 0 END AS effective_rate FROM (SELECT acct, sum(CASE WHEN held_days < 365 AND gain < 0 THEN -gain ELSE 0 END) AS short_loss, sum(CASE WHEN held_days >= 365 AND gain < 0 THEN -gain ELSE 0 END) AS long_loss,
  sum(CASE WHEN held_days < 365 THEN benefit ELSE 0 END) AS short_benefit, sum(CASE WHEN held_days >= 365 THEN benefit ELSE 0 END) AS long_benefit FROM ben GROUP BY acct)""", "short_loss long_loss short_benefit long_benefit effective_rate", _LOTS, places=3)
def h47_portfolio_benefit(t):
    return harvest.portfolio_benefit(_benefits(t))


_CANDIDATES = """
mr AS (SELECT sec, last_day(d) AS month, avg(price) AS p FROM trades GROUP BY ALL),
rt AS (SELECT sec, month, avg(p) OVER (PARTITION BY sec ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS ret FROM mr),
pc AS (SELECT a.sec AS si, b.sec AS sj, corr(a.ret, b.ret) AS corr, count(*) AS n FROM rt a JOIN rt b ON a.month = b.month AND a.sec <> b.sec WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL),
br AS (SELECT p_brand AS sec, substr(p_brand, 1, 7) AS sector, substr(max(p_type), 1, 2) AS industry, CASE WHEN min(p_partkey) % 2 = 0 THEN 'N' ELSE 'A' END AS exchange, CASE WHEN max(p_size) % 7 = 0 THEN 'fund' ELSE 'stock' END AS type FROM part GROUP BY p_brand),
rep AS (SELECT sec, candidate, CAST(row_number() OVER (PARTITION BY sec ORDER BY same DESC, candidate) AS INTEGER) AS rank, similarity FROM (SELECT x.sec, y.sec AS candidate, x.sector = y.sector AS same,
        0.5 * (x.sector = y.sector)::INT::DOUBLE + 0.3 * (x.industry = y.industry)::INT::DOUBLE + 0.1 * (x.exchange = y.exchange)::INT::DOUBLE + 0.1 AS similarity
        FROM br x JOIN br y ON x.sec <> y.sec AND x.type = y.type LEFT JOIN pc ON si = x.sec AND sj = y.sec WHERE n IS NULL OR n < 30 OR abs(corr) >= 0.7) QUALIFY rank <= 5)
"""


def _replacements(t: Tables) -> DataFrame:
    """Of brands, by the correlation of their mean prices of twelve months (monthly price changes of the stand-ins are noise)."""
    monthly = t.ledger().groupBy("sec", F.last_day("d").alias("month")).agg(F.avg("price").alias("p"))
    r = monthly.withColumn("ret", F.avg("p").over(Window.partitionBy("sec").orderBy("month").rowsBetween(-11, 0)))
    a, b = r.select("month", F.col("sec").alias("si"), F.col("ret").alias("x")), r.select("month", F.col("sec").alias("sj"), F.col("ret").alias("y"))
    corr = a.join(b, "month").where("si < sj").groupBy("si", "sj").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n"))
    kind = F.when(F.max("p_size") % 7 == 0, "fund").otherwise("stock")
    brands = t.read("part").groupBy(F.col("p_brand").alias("sec")).agg(F.substring(F.max("p_type"), 1, 2).alias("industry"), F.when(F.min("p_partkey") % 2 == 0, "N").otherwise("A").alias("exchange"), kind.alias("type"))
    return harvest.replacements(brands.withColumn("sector", F.substring("sec", 1, 7)), corr)


@add("SELECT * FROM rep", "similarity", _CANDIDATES)
def h48_replacements(t):
    return _replacements(t)


_FOUND = _LOTS.strip() + "," + _CANDIDATES.strip() + """,
lw AS (SELECT o.acct, o.sec, o.lot, count(b.seq) > 0 AS wash FROM ol o LEFT JOIN trades b ON b.acct = o.acct AND b.sec = o.sec AND b.side = 'B' AND abs(b.d - o.bought) <= 30 AND b.seq <> o.lot GROUP BY ALL),
opp AS (SELECT acct, CAST(row_number() OVER (PARTITION BY acct ORDER BY round(score, 6) DESC, sec, lot) AS INTEGER) AS rank, sec, lot, gain, benefit, wash, score FROM (SELECT n.acct, n.sec, n.lot, gain, benefit, wash,
        CASE WHEN similarity IS NULL THEN benefit * CASE WHEN wash THEN 0.5 ELSE 1 END * 0.7 ELSE benefit * CASE WHEN wash THEN 0.5 ELSE 1 END + benefit * 0.2 * similarity END / -gain * 1000 AS score
        FROM ben n JOIN lw USING (acct, sec, lot) LEFT JOIN (SELECT sec, avg(similarity) AS similarity FROM rep WHERE rank <= 3 GROUP BY sec) r ON n.sec = r.sec WHERE gain <= -100) QUALIFY rank <= 10)
"""


def _opportunities(t: Tables) -> DataFrame:
    return harvest.opportunities(_benefits(t, near=30), None, t.keep("replacements", lambda: _replacements(t)))


@add("SELECT * FROM opp", "gain benefit score", _FOUND, places=4)
def h49_harvest_opportunities(t):
    return _opportunities(t)


@add("SELECT acct, count(*) AS n, count_if(benefit > 500) AS significant, sum(benefit) AS total_benefit, sum(-gain) AS total_loss, avg(score) AS mean_score FROM opp GROUP BY acct", "total_benefit total_loss mean_score", _FOUND, places=3)
def h50_opportunity_summary(t):
    return harvest.opportunity_summary(_opportunities(t))


@add("SELECT acct, sec, coalesce(sum(benefit) / nullif(sum(market_value), 0), 0) AS coefficient FROM ben GROUP BY ALL", "coefficient", _LOTS)
def h61_tax_coefficients(t):
    return harvest.tax_coefficients(_benefits(t))


_WEIGHTS = """
pos AS (SELECT acct, sec, sum(CASE WHEN side = 'B' THEN qty ELSE -qty END) AS quantity FROM trades GROUP BY ALL HAVING sum(CASE WHEN side = 'B' THEN qty ELSE -qty END) > 1e-9),
wt AS (SELECT acct, sec, quantity, price, quantity * price AS value, quantity * price / sum(quantity * price) OVER (PARTITION BY acct) AS weight FROM pos JOIN last_prices USING (sec)),
tg AS (SELECT acct, sec, 1.0::DOUBLE / count(*) OVER (PARTITION BY acct) AS weight FROM wt)
"""


def _weights(t: Tables) -> DataFrame:
    held = lots.positions(t.ledger().select("acct", "sec", "side", "qty").repartition("acct"))  # an account's positions together, as its weights need them
    return rebalance.current_weights(held.where("quantity > 0"), t.last_prices()).drop("trades")


def _kept_weights(t: Tables) -> DataFrame:
    """The weights for a query that reads them more than once."""
    return t.keep("weights", lambda: _weights(t)).repartition("acct")


def _target(t: Tables) -> DataFrame:
    return _kept_weights(t).select("acct", "sec", (1.0 / F.count("*").over(Window.partitionBy("acct"))).alias("weight"))


@add("SELECT acct, sec, quantity, price, value, weight FROM wt", "quantity price value weight", _WEIGHTS, places=4)
def h52_current_weights(t):
    return _weights(t).select("acct", "sec", "quantity", "price", "value", "weight")


@add("SELECT acct, sqrt(sum((w.weight - g.weight) * (w.weight - g.weight))) AS distance FROM wt w JOIN tg g USING (acct, sec) GROUP BY acct", "distance", _WEIGHTS)
def h63_weight_distance(t):
    return rebalance.weight_distance(_kept_weights(t), _target(t))


@add("""SELECT acct, sec, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS kind, abs(d) AS quantity FROM (SELECT w.acct, w.sec, t.total * g.weight / w.price - w.quantity AS d FROM wt w JOIN tg g USING (acct, sec) JOIN (SELECT acct, sum(value) AS total FROM wt GROUP BY acct) t USING (acct)) WHERE abs(d) > 0.01""", "quantity", _WEIGHTS, places=4)
def h64_trades(t):
    w = _kept_weights(t)
    return rebalance.trades(w, _target(t), t.last_prices(), w.groupBy("acct").agg(F.sum("value").alias("total")))


_ORDERS = _FOUND.strip().rstrip(",") + "," + _WEIGHTS.strip() + """,
wn AS (SELECT acct, sec, d FROM (SELECT w.acct, w.sec, t.total * g.weight / w.price - w.quantity AS d FROM wt w JOIN tg g USING (acct, sec) JOIN (SELECT acct, sum(value) AS total FROM wt GROUP BY acct) t USING (acct)) WHERE abs(d) > 0.01),
lq AS (SELECT o.acct, o.sec, o.lot, remaining, -d AS want, sum(remaining) OVER (PARTITION BY o.acct, o.sec ORDER BY p.lot IS NULL, bought, o.lot) - remaining AS before
       FROM ol o JOIN wn ON wn.acct = o.acct AND wn.sec = o.sec AND d < 0 LEFT JOIN opp p ON p.acct = o.acct AND p.sec = o.sec AND p.lot = o.lot),
tk AS (SELECT p.acct, p.sec, p.lot, remaining, benefit, l.price AS price_from, candidate, c.price AS price_to FROM opp p JOIN (SELECT sec, candidate FROM rep WHERE rank = 1) r ON p.sec = r.sec JOIN ol o ON o.acct = p.acct AND o.sec = p.sec AND o.lot = p.lot
       JOIN last_prices l ON l.sec = p.sec LEFT JOIN last_prices c ON c.sec = candidate WHERE NOT wash),
ords AS (SELECT 'optimiser' AS source, 'buy' AS kind, acct, sec, NULL::BIGINT AS lot, d AS quantity, NULL::DOUBLE AS benefit FROM wn WHERE d > 0
  UNION ALL SELECT 'optimiser', 'sell', acct, sec, lot, least(remaining, want - before), NULL FROM lq WHERE want - before > 1e-9
  UNION ALL SELECT 'harvest', 'sell', acct, sec, lot, remaining, benefit FROM tk
  UNION ALL SELECT 'harvest', 'buy', acct, candidate, NULL, remaining * price_from / price_to, NULL FROM tk WHERE price_to IS NOT NULL)
"""


def _lot_orders(t: Tables) -> DataFrame:
    w = _kept_weights(t)
    total = w.groupBy("acct").agg(F.sum("value").alias("total"))
    found, held = t.keep("opportunities", lambda: _opportunities(t)), t.keep("open_lots", lambda: lots.open_lots(t.ledger()))
    held, found = held.repartition("acct"), found.repartition("acct")  # all joins and windows below are an account's
    return rebalance.trades_by_lot(w, _target(t), t.last_prices(), total, held, found, t.keep("replacements", lambda: _replacements(t)))


@add("SELECT acct, source, kind, sec, lot, quantity, price, benefit FROM ords JOIN last_prices USING (sec)", "quantity price benefit", _ORDERS, places=4)
def h64_trades_by_lot(t):
    return _lot_orders(t).drop("order")


@add("""SELECT o.acct, o.sec, o.lot, o.source, o.quantity FROM ords o JOIN (SELECT acct, sec, lot, sum(quantity) AS q FROM ords WHERE kind = 'sell' GROUP BY ALL) s ON s.acct = o.acct AND s.sec = o.sec AND s.lot = o.lot
  JOIN ol ON ol.acct = o.acct AND ol.sec = o.sec AND ol.lot = o.lot WHERE o.kind = 'sell' AND q > remaining + 1e-9""", "quantity", _ORDERS, places=4)
def h67_lots_sold_twice(t):
    """Lots that the optimiser's sales and a harvest sell more of than there is."""
    return rebalance.lot_oversells(_lot_orders(t), t.keep("open_lots", lambda: lots.open_lots(t.ledger()))).select("acct", "sec", "lot", "source", "quantity")


@add("""SELECT acct, sec, lot, bought, lot % 2 = 0 AS harvest, least(remaining, want - before) AS take FROM (SELECT *, coalesce(sum(remaining) OVER (PARTITION BY acct, sec ORDER BY lot % 2, bought, lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(remaining) OVER (PARTITION BY acct, sec) / 2 AS want FROM ol) WHERE want - before > 1e-9""", "take", _LOTS)
def h65_lot_selection(t):
    open_ = lots.open_lots(t.ledger()).withColumn("harvest", F.col("lot") % 2 == 0)
    return lots.select_for_sale(open_, open_.groupBy("acct", "sec").agg((F.sum("remaining") / 2).alias("qty")))


def _orders(t: Tables) -> DataFrame:
    rows = t.trades().where("d >= date '1998-01-01'")
    return rows.select(F.col("seq").alias("order_id"), "acct", "sec", "d", F.when(F.col("side") == "S", "sell").otherwise("buy").alias("kind"), F.col("qty").alias("quantity"), "price")


@add("""SELECT seq AS order_id, 'error' AS severity, 'wash_sale' AS rule FROM o WHERE side = 'S' AND EXISTS (FROM trades b WHERE b.side = 'B' AND b.acct = o.acct AND b.sec = o.sec AND abs(b.d - o.d) <= 30 AND b.d < DATE '1998-01-01')
  UNION ALL SELECT o.seq, 'error', 'oversell' FROM o JOIN (SELECT acct, sec, sum(qty) AS t FROM o WHERE side = 'S' GROUP BY ALL) x USING (acct, sec) LEFT JOIN held h USING (acct, sec) WHERE o.side = 'S' AND x.t > coalesce(h.q, 0) + 1e-9
  UNION ALL SELECT seq, 'warning', 'duplicate' FROM (SELECT seq, count(*) OVER (PARTITION BY acct, sec, d, side) AS n FROM o) WHERE n > 1
  UNION ALL SELECT seq, 'warning', 'no_net_effect' FROM (SELECT seq, count(*) OVER (PARTITION BY acct, sec) AS n, sum(CASE WHEN side = 'B' THEN qty ELSE -qty END) OVER (PARTITION BY acct, sec) AS net FROM o) WHERE n > 1 AND abs(net) < 0.01""", "",
     "o AS (SELECT * FROM trades WHERE d >= DATE '1998-01-01'), held AS (SELECT acct, sec, sum(CASE WHEN side = 'B' THEN qty ELSE -qty END) AS q FROM trades WHERE d < DATE '1998-01-01' GROUP BY ALL)")
def h67_compliance(t):
    before = t.trades().where("d < date '1998-01-01'")
    return rebalance.compliance(_orders(t), lots.positions(before), before.where("side = 'B'"))


@add("""SELECT *, gains - losses AS net, (gains - losses) * 0.7 AS long_estimate, (gains - losses) * 0.3 AS short_estimate FROM (SELECT acct, CAST(year(sold) AS INTEGER) AS year, sum(CASE WHEN g > 0 THEN g ELSE 0 END) AS gains, sum(CASE WHEN g < 0 AND NOT wash THEN -g ELSE 0 END) AS losses,
  sum(CASE WHEN long AND (g > 0 OR NOT wash) THEN g ELSE 0 END) AS long_net, sum(CASE WHEN NOT long AND (g > 0 OR NOT wash) THEN g ELSE 0 END) AS short_net, sum(CASE WHEN g < 0 AND wash THEN -g ELSE 0 END) AS wash_adjustment
  FROM (SELECT m.acct, sold, used * (sale_price - cost_price) AS g, sold - bought >= 365 AS long, w.wash FROM m JOIN wash w ON w.acct = m.acct AND w.sec = m.sec AND w.lot = m.sale) GROUP BY ALL)""",
     "gains losses long_net short_net wash_adjustment net long_estimate short_estimate", _LOTS.strip() + "," + _WASH, places=3)
def h69_tax_report(t):
    return rebalance.tax_report(lots.realised_gains(lots.fifo(t.ledger(), near=30)))


@add("SELECT o.acct, o.sec, sum(remaining) AS quantity, sum(remaining * l.price) AS value, sum(remaining * (l.price - o.price)) AS unrealised, count(*) AS lots FROM ol o JOIN last_prices l ON o.sec = l.sec GROUP BY ALL", "quantity value unrealised", _LOTS, places=3)
def h70_positions_report(t):
    return rebalance.positions_report(lots.open_lots(t.ledger()), t.last_prices())


@add("SELECT l_orderkey, l_linenumber, l_extendedprice / (1 + l_discount) AS acquisition_price FROM lineitem", "acquisition_price", places=5)
def h71_acquisition_price(t):
    li = t.read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("gain"))
    return rebalance.acquisition_price(li, places=9).select("l_orderkey", "l_linenumber", "acquisition_price")


@add("SELECT coalesce(c.c_custkey, o.k) AS key, coalesce(o.total, c.c_acctbal) AS balance, coalesce(nullif(c.c_name, ''), o.name) AS name FROM customer c FULL JOIN (SELECT o_custkey + 10 AS k, sum(o_totalprice) AS total, 'new' AS name FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.k", "balance", places=2)
def h72_upsert(t):
    master = t.read("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    incoming = t.read("orders").groupBy((F.col("o_custkey") + 10).alias("key")).agg(F.sum("o_totalprice").alias("balance")).withColumn("name", F.lit("new"))
    return rebalance.upsert(master, incoming, "key", ["balance"], ["name"])


@add("SELECT acct, event, d, status, rank FROM (SELECT o_custkey AS acct, o_orderkey AS event, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS status, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS INTEGER) AS rank FROM orders) WHERE rank <= 5")
def h73_recent_events(t):
    o = t.read("orders").select(F.col("o_custkey").alias("acct"), F.col("o_orderkey").alias("event"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderstatus").alias("status"))
    return rebalance.recent_events(o, 5)


@add("SELECT ticker, sec FROM (SELECT DISTINCT replace(s_name, '3', '4') AS ticker FROM supplier) LEFT JOIN (SELECT s_name AS ticker, s_suppkey AS sec FROM supplier) USING (ticker)")
def h74_resolve_tickers(t):
    wanted = t.read("supplier").select(F.replace("s_name", F.lit("3"), F.lit("4")).alias("ticker")).distinct()
    return rebalance.resolve(wanted, t.security())


def _account_returns(t: Tables) -> DataFrame:
    monthly = t.ledger().groupBy("sec", F.last_day("d").alias("month")).agg(F.avg("price").alias("price"), F.sum("qty").alias("cap"))
    return t.keep("account_returns", lambda: prices.monthly_returns(monthly))


@add("""SELECT acct, count(*) AS n, stddev_samp(a) * sqrt(12.0) AS tracking_error, avg(a) * 12 / (stddev_samp(a) * sqrt(12.0)) AS information_ratio FROM (SELECT acct, month, sum(weight * ret) - any_value(bench) AS a FROM wt JOIN rt USING (sec) JOIN (SELECT month, avg(ret) AS bench FROM rt WHERE ret IS NOT NULL GROUP BY month) USING (month) WHERE ret IS NOT NULL GROUP BY acct, month) GROUP BY acct HAVING count(*) >= 10""",
     "tracking_error information_ratio", _WEIGHTS.strip() + ", mr AS (SELECT sec, last_day(d) AS month, avg(price) AS p FROM trades GROUP BY ALL), rt AS (SELECT sec, month, p / lag(p) OVER (PARTITION BY sec ORDER BY month) - 1 AS ret FROM mr)", places=4)
def h51_account_tracking_error(t):
    r = _account_returns(t)
    bench = r.where("ret is not null").groupBy("month").agg(F.avg("ret").alias("bench"))
    return rebalance.account_tracking_error(t.keep("weights", lambda: _weights(t)), r, bench)


def _sector_model(t: Tables):
    """Risk of brands by sector: sector returns as factors, what is left as specific risk; (names, exposures, covariance)."""
    r = _account_returns(t).where("ret is not null").select("sec", F.substring("sec", 1, 7).alias("sector"), "month", "ret")
    own = r.withColumn("factor", F.avg("ret").over(Window.partitionBy("sector", "month")))
    names = own.groupBy("sec", "sector").agg(F.coalesce(F.var_samp(F.col("ret") - F.col("factor")), F.lit(0.01)).alias("specific"))
    f = r.groupBy("sector", "month").agg(F.avg("ret").alias("x"))
    pair = f.select("month", F.col("sector").alias("fi"), "x").join(f.select("month", F.col("sector").alias("fj"), F.col("x").alias("y")), "month")
    return names, names.select("sec", F.col("sector").alias("factor"), F.lit(1.0).alias("x")), pair.groupBy("fi", "fj").agg(F.covar_samp("x", "y").alias("cov"))


def _account_problem(t: Tables):
    """Every account against the holdings of its market segment: names that would realise a loss may not be bought back, a
    sector may hold a half, or .15 less than it does."""
    names, exposures, covariance = (t.keep(f"sector{i}", lambda x=x: x) for i, x in enumerate(_sector_model(t)))
    segment = t.read("customer").select(F.col("c_custkey").alias("acct"), F.col("c_mktsegment").alias("benchmark"))
    w = t.keep("segments", lambda: _weights(t).select("acct", "sec", "weight", "value").join(segment, "acct"))
    bench = w.groupBy("benchmark", "sec").agg(F.sum("value").alias("bench"))
    universe = w.select("acct", "benchmark").distinct().join(bench, "benchmark").join(names, "sec").drop("benchmark")
    tax = harvest.tax_coefficients(_benefits(t))
    penalty = _benefits(t).groupBy("acct", "sec").agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("gain") > 0, F.col("gain") * F.col("rate"))), F.sum("market_value")), F.lit(0.0)).alias("penalty"))
    rows = universe.join(w.select("acct", "sec", "weight"), ["acct", "sec"], "left").join(tax, ["acct", "sec"], "left").join(penalty, ["acct", "sec"], "left")
    rows = rows.withColumn("no_buy", F.coalesce(F.col("coefficient") > 0, F.lit(False)))
    caps = rows.groupBy("acct", "sector").agg(F.sum("weight").alias("held")).select("acct", "sector", F.greatest(F.lit(0.5), F.coalesce(F.col("held"), F.lit(0.0)) - 0.15).alias("cap"))
    return rows, exposures, covariance, caps


@add()
def h60_account_solve(t):
    return rebalance.solve_accounts(*_account_problem(t), most_risk=0.5)


_TRACKING = _WEIGHTS.strip() + """,
mret AS (SELECT sec, last_day(d) AS month, avg(price) AS p FROM trades GROUP BY ALL), mr2 AS (SELECT sec, month, p / lag(p) OVER (PARTITION BY sec ORDER BY month) - 1 AS ret FROM mret),
te AS (SELECT acct, count(*) AS n, stddev_samp(a) * sqrt(12.0) AS tracking_error, avg(a) * 12 / (stddev_samp(a) * sqrt(12.0)) AS information_ratio FROM (SELECT acct, month, sum(weight * ret) - any_value(bench) AS a FROM wt JOIN mr2 USING (sec) JOIN (SELECT month, avg(ret) AS bench FROM mr2 WHERE ret IS NOT NULL GROUP BY month) USING (month) WHERE ret IS NOT NULL GROUP BY acct, month) GROUP BY acct HAVING count(*) >= 10)
"""


def _tracking(t: Tables) -> DataFrame:
    r = _account_returns(t)
    bench = r.where("ret is not null").groupBy("month").agg(F.avg("ret").alias("bench"))
    return rebalance.account_tracking_error(t.keep("weights", lambda: _weights(t)), r, bench)


@add("""SELECT coalesce(x.acct, h.acct) AS acct, coalesce(tracking_error > 1.5, false) AS by_tracking_error, coalesce(significant > 0, false) AS by_harvest, coalesce(DATE '2001-12-31' - last >= 30, true) AS by_time, h.acct IS NOT NULL AS by_hand,
  coalesce(tracking_error > 1.5, false) OR coalesce(significant > 0, false) OR coalesce(DATE '2001-12-31' - last >= 30, true) OR h.acct IS NOT NULL AS needed
  FROM (SELECT coalesce(te.acct, s.acct) AS acct, tracking_error, significant FROM te FULL JOIN (SELECT acct, count_if(benefit > 500) AS significant FROM opp GROUP BY acct) s ON te.acct = s.acct) x
  FULL JOIN (SELECT c_custkey AS acct FROM customer WHERE c_acctbal < 0) h ON h.acct = x.acct
  LEFT JOIN (SELECT o_custkey AS acct, max(CAST(o_orderdate AS DATE)) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) e ON e.acct = coalesce(x.acct, h.acct)""", "", _FOUND.strip() + "," + _TRACKING)
def h62_rebalance_triggers(t):
    events = t.read("orders").select(F.col("o_custkey").alias("acct"), F.col("o_orderdate").cast("date").alias("d"), F.when(F.col("o_orderstatus") == "F", "executed").otherwise("open").alias("status"))
    manual = t.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("acct"))
    return rebalance.triggers(_tracking(t), harvest.opportunity_summary(_opportunities(t)), events, AS_OF, limit=1.5, manual=manual)


@add("""SELECT te.acct, n, tracking_error, information_ratio, coalesce(executed_benefit, 0) AS executed_benefit FROM te LEFT JOIN
  (SELECT acct, sum(-g * CASE WHEN long THEN long_rate ELSE short_rate END) AS executed_benefit FROM (SELECT acct, used * (sale_price - cost_price) AS g, sold - bought >= 365 AS long FROM m) JOIN accounts USING (acct) WHERE g < 0 GROUP BY acct) b ON b.acct = te.acct""",
     "tracking_error information_ratio executed_benefit", _LOTS.strip() + "," + _TRACKING, places=3)
def h68_performance_report(t):
    return rebalance.performance_report(_tracking(t), lots.realised_gains(lots.fifo(t.ledger())), t.accounts())
