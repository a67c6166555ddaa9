import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import harvest, lots, rebalance
from tidemark.plans import standins

TRADES = "acct long, sec string, d date, seq long, side string, qty double, price double"


def day(text):
    return dt.date.fromisoformat(text)


def trades(spark, rows):
    return spark.createDataFrame([(1, "A", day(d), i, side, float(q), float(p)) for i, (d, side, q, p) in enumerate(rows)], TRADES)


def test_fifo_splits_lots(spark):
    t = trades(spark, [("2024-01-15", "B", 100, 180), ("2024-02-01", "B", 50, 170), ("2024-03-01", "S", 120, 160), ("2024-04-01", "B", 10, 150)])
    got = sorted((r.lot, r.sale, r.used) for r in lots.fifo(t).collect())
    assert got == [(0, 2, 100.0), (1, 2, 20.0)]
    assert sorted((r.lot, r.remaining, r.cost) for r in lots.open_lots(t).collect()) == [(1, 30.0, 5100.0), (3, 10.0, 1500.0)]
    assert lots.positions(t).first().quantity == 40.0


def test_wash_sale_cases(spark):
    sale = spark.createDataFrame([(1, "A", day("2024-03-01"), 0)], "acct long, sec string, d date, lot long")
    alone = trades(spark, [("2024-01-15", "B", 100, 180)])
    near = trades(spark, [("2024-01-15", "B", 100, 180), ("2024-02-10", "B", 10, 175)])
    assert not harvest.wash_sales(sale, alone).first().wash
    assert harvest.wash_sales(sale, near).first().wash
    assert not harvest.wash_sales(sale.withColumn("d", F.lit("2024-01-20").cast("date")), alone, exclude_own_lot=True).first().wash


def test_tax_benefit_by_term(spark):
    rates = spark.createDataFrame([(1, 0.37, 0.2)], "acct long, short_rate double, long_rate double")
    rows = [(1, "A", 0, day("2024-01-01"), 100.0, 180.0, 160.0), (1, "A", 1, day("2023-01-01"), 100.0, 180.0, 160.0), (1, "A", 2, day("2024-01-01"), 100.0, 100.0, 160.0)]
    held = spark.createDataFrame(rows, "acct long, sec string, lot long, bought date, remaining double, price double, last double")
    got = {r.lot: r.benefit for r in harvest.tax_benefit(held, rates, "2024-03-01").collect()}
    assert got == pytest.approx({0: 740.0, 1: 400.0, 2: 0.0})


def test_lot_selection_prefers_harvest(spark):
    open_ = spark.createDataFrame([(1, "A", 0, day("2020-01-01"), 60.0, False), (1, "A", 1, day("2021-01-01"), 40.0, True)], "acct long, sec string, lot long, bought date, remaining double, harvest boolean")
    want = spark.createDataFrame([(1, "A", 50.0)], "acct long, sec string, qty double")
    assert sorted((r.lot, r.take) for r in lots.select_for_sale(open_, want).collect()) == [(0, 10.0), (1, 40.0)]


def test_compliance_rules(spark):
    orders = spark.createDataFrame([(1, 1, "A", day("2024-03-01"), "sell", 50.0, 10.0), (2, 1, "B", day("2024-03-01"), "sell", 50.0, 10.0), (3, 1, "B", day("2024-03-01"), "sell", 60.0, 10.0), (4, 1, "C", day("2024-03-01"), "buy", 0.0, 10.0)], "order_id long, acct long, sec string, d date, kind string, quantity double, price double")
    held = spark.createDataFrame([(1, "A", 100.0), (1, "B", 100.0)], "acct long, sec string, quantity double")
    buys = spark.createDataFrame([(1, "A", day("2023-11-20"))], "acct long, sec string, d date")
    got = {(r.order_id, r.rule) for r in rebalance.compliance(orders, held, buys).collect()}
    assert got == {(2, "oversell"), (3, "oversell"), (2, "duplicate"), (3, "duplicate"), (4, "bad_quantity_or_price")}


def brute_fifo(rows):
    """Matches by walking through lots and sales; rows are (d, seq, side, qty)."""
    lots_left = [[seq, q] for d, seq, side, q in sorted(rows) if side == "B"]
    out, i = [], 0
    for _, sale, side, q in sorted(rows):
        while side == "S" and q > 1e-9 and i < len(lots_left):
            take = min(q, lots_left[i][1])
            if take > 1e-9:
                out.append((lots_left[i][0], sale, round(take, 6)))
            q, lots_left[i][1] = q - take, lots_left[i][1] - take
            i += lots_left[i][1] <= 1e-9
    return sorted(out)


@pytest.mark.parametrize("swept", [100_000, 7, 1])
def test_fifo_equals_a_walk(spark, monkeypatch, swept):
    """Ties, zero and fractional quantities, more sold than bought, and keys cut into many ranges."""
    rng = random.Random(swept)
    monkeypatch.setattr(lots, "SWEPT", swept)
    rows, want = [], {}
    for acct in range(12):
        own = [(day("2024-01-01") + dt.timedelta(rng.randrange(90)), 100 * acct + i, rng.choice("BBS" if acct % 3 else "BSS"), rng.choice((0.0, 1.0, 2.5, 0.25, 40.0))) for i in range(rng.choice((1, 5, 60)))]
        rows += [(acct, "A", d, seq, side, q, 1.0 + seq % 7) for d, seq, side, q in own]
        want[acct] = brute_fifo(own)
    t = spark.createDataFrame(rows, TRADES)
    got = {}
    for r in lots.fifo(t).collect():
        got.setdefault(r.acct, []).append((r.lot, r.sale, round(r.used, 6)))
    assert {a: sorted(got.get(a, [])) for a in want} == want
    bought = {r[3]: r[5] for r in rows if r[4] == "B"}
    left = {lot: q - sum(u for m in want.values() for x, _, u in m if x == lot) for lot, q in bought.items()}
    assert {r.lot: round(r.remaining, 6) for r in lots.open_lots(t).collect()} == {k: pytest.approx(v) for k, v in left.items() if v > 1e-9}


def test_one_key_with_very_many_trades(spark):
    """A hundred thousand lots and as many sales of one key: their product would be 10^10 rows."""
    n = 100_000
    t = spark.range(2 * n).select(F.lit(1).cast("long").alias("acct"), F.lit("A").alias("sec"), F.expr("date_add(date'2000-01-01', cast(id % 5000 as int))").alias("d"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "B").otherwise("S").alias("side"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(2.0).alias("qty"), F.lit(1.0).alias("price"))
    got = lots.fifo(t).agg(F.count("*").alias("n"), F.sum("used").alias("used"), F.count_distinct("sale").alias("sales")).first()
    assert (got.used, got.sales) == (2.0 * n, n) and n <= got.n <= 2 * n
    near = harvest.wash_sales(t.where("side = 'S'").select("acct", "sec", "d", F.col("seq").alias("lot")), t.where("side = 'B'"))
    assert near.agg(F.sum("purchases")).first()[0] > 10**6 and near.count() == n


def test_days_near_equal_brute_force(spark):
    rng = random.Random(9)
    at = lambda: day("2024-01-01") + dt.timedelta(rng.randrange(200))
    sales = [(rng.randrange(3), rng.choice("AB"), at() if i % 9 else None, i) for i in range(80)]
    buys = [(rng.randrange(3), rng.choice("ABC"), at() if i % 9 else None, i) for i in range(80)]
    s = spark.createDataFrame(sales, "acct long, sec string, d date, lot long")
    b = spark.createDataFrame(buys, "acct long, sec string, d date, seq long")
    near = lambda x, y: x is not None and y is not None and abs((x - y).days) <= 30
    for own in (False, True):
        want = {x: sum(1 for a, sec, e, seq in buys if (a, sec) == (acct, k) and near(d, e) and not (own and seq == x)) for acct, k, d, x in sales}
        assert {r.lot: r.purchases for r in harvest.wash_sales(s, b, exclude_own_lot=own).collect()} == want
    got = {(r.acct, r.d): (r.excluded, r.n_excluded) for r in harvest.excluded_securities(s, b).collect()}
    want = {(a, d): sorted({k for c, k, e, _ in sales if (c, e) == (a, d)} | {k for c, k, e, _ in buys if c == a and near(d, e)}) for a, _, d, _ in sales}
    assert got == {k: (v, len(v)) for k, v in want.items()}


@pytest.mark.parametrize("swept", [100_000, 3])
def test_purchases_near_come_with_lots_and_matches(spark, monkeypatch, swept):
    """What is counted beside the running quantities equals the counts of ``within_days``, also for accounts with many trades."""
    rng = random.Random(swept)
    monkeypatch.setattr(lots, "SWEPT", swept)
    rows = []
    for acct in range(8):
        for i in range(rng.choice((1, 4, 40))):
            at = day("2024-01-01") + dt.timedelta(rng.randrange(200)) if rng.random() > 0.1 else None
            rows.append((acct, rng.choice("AB"), at, 100 * acct + i, rng.choice("BBS"), float(rng.choice((1, 2, 5))), 10.0))
    t = spark.createDataFrame(rows, TRADES)
    near = lambda x, y: x is not None and y is not None and abs((x - y).days) <= 30
    count = {r[3]: sum(near(r[2], b[2]) for b in rows if b[4] == "B" and b[:2] == r[:2] and b[3] != r[3]) for r in rows}
    found = lots.open_lots(t, near=30).collect()
    assert found and {r.lot: r.purchases for r in found} == {r.lot: count[r.lot] for r in found}
    matches = lots.fifo(t, near=30).collect()
    assert matches and all(r.purchases == count[r.sale] for r in matches)
    assert sorted((r.lot, r.sale, r.used) for r in matches) == sorted((r.lot, r.sale, r.used) for r in lots.fifo(t).collect())


@pytest.mark.parametrize("query", ["h64_trades_by_lot", "h67_lots_sold_twice", "h49_harvest_opportunities", "h62_rebalance_triggers"])
def test_trades_are_worked_out_once(spark, monkeypatch, query):
    made, whole = [], standins.Tables.trades
    monkeypatch.setattr(standins.Tables, "trades", lambda self: made.append(1) or whole(self))
    plans.QUERIES[query](spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1


def test_tracking_error_has_tasks_for_its_products(spark, monkeypatch):
    monkeypatch.setattr(rebalance, "PRODUCTS", 50)
    w = spark.range(40).select(F.col("id").alias("acct"), F.lit("A").alias("sec"), F.lit(1.0).alias("weight"))
    r = spark.range(1, 13).select(F.lit("A").alias("sec"), F.expr("last_day(make_date(2024, cast(id as int), 1))").alias("month"), (F.col("id") / 100 * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("ret"))
    sizes = []
    whole = type(w).repartition
    monkeypatch.setattr(type(w), "repartition", lambda self, n, *by: sizes.append(n) or whole(self, n, *by))
    got = rebalance.account_tracking_error(w, r, r.select("month", F.lit(0.0).alias("bench"))).collect()
    assert sizes == [10] and len(got) == 40 and {x.n for x in got} == {12}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trades_are_sorted_once_for_open_lots(spark):
    """Running quantities, purchases near and totals sold follow on one sort; each sort of all trades spills where they are many."""
    t = trades(spark, [("2024-01-15", "B", 100, 180), ("2024-02-01", "S", 50, 170)])
    assert plan_of(lots.open_lots(t, near=30)).count("Sort [") == 1


def test_last_prices_do_not_sort_trades(spark, monkeypatch):
    t = standins.Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(t, "keep", lambda name, make: make())
    rows = t.ledger().collect()
    t._kept["trades"] = ledger = spark.createDataFrame(rows, t.ledger().schema)
    monkeypatch.setattr(t, "ledger", lambda: ledger)
    plan = plan_of(t.last_prices())
    assert "HashAggregate(keys=[sec" in plan and plan.count("SortAggregate") == 2  # of days only
    assert {r.sec: r.price for r in t.last_prices().collect()} == {r.sec: r.price for r in sorted(rows, key=lambda r: (r.d, r.seq))}
