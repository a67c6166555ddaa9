"""Lot accounting over ``trades(acct, sec, d, seq, side, qty, price)``; side is ``B`` or ``S``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: About so many trades of one account and security are swept by one task; more are cut into ranges of running quantity.
SWEPT = 100_000
#: Accounts are dealt into so many buckets to tell those with many trades from the rest.
BUCKETS = 1 << 16
#: Quantities up to this are none.
NOTHING = 1e-9


def _dealt(trades: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``trades`` of ordinary accounts, an account in one partition, and those of buckets of accounts with more than ``SWEPT`` (none: None).

    All windows and joins of an account follow on the one exchange of the first part.
    """
    trades = trades.where("acct is not null and sec is not null")
    bucket = F.pmod(F.xxhash64("acct"), F.lit(BUCKETS))
    many = [r.b for r in trades.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > SWEPT).collect()]
    plain = trades.where(~bucket.isin(many)) if many else trades
    return plain.repartition("acct"), trades.where(bucket.isin(many)) if many else None


def _plain_running(trades: DataFrame, near: int | None) -> DataFrame:
    """Trades with ``hi``, the running quantity of their account, security and side, and ``purchases`` within ``near`` days either way.

    All windows, and those over whole keys behind them, share one order of the rows: account, security, day and ``seq``.
    """
    buy, line = F.col("side") == "B", Window.partitionBy("acct", "sec").orderBy("_day", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("_day", F.unix_date("d"))
    rows = rows.withColumn("hi", F.when(buy, F.sum(F.when(buy, F.col("qty"))).over(line)).otherwise(F.sum(F.when(~buy, F.col("qty"))).over(line)))
    if near is not None:
        days = Window.partitionBy("acct", "sec").orderBy("_day").rangeBetween(-near, near)
        rows = rows.withColumn("purchases", F.when(F.col("d").isNull(), 0).otherwise(F.count_if(buy & F.col("d").isNotNull()).over(days)))
    return rows.drop("_day")


def _running(trades: DataFrame) -> DataFrame:
    """Trades with ``lo`` and ``hi``, their place in the running quantity of their account, security and side, and ``part``, a range of it.

    Totals of months are summed up first, so that a month of a key is all that one task has to put in order.
    """
    key = ["acct", "sec"]
    rows = trades.withColumn("_month", F.coalesce(F.trunc("d", "month"), F.lit("0001-01-01").cast("date")))
    months = rows.groupBy(*key, "side", "_month").agg(F.sum("qty").alias("_q"), F.count("*").alias("_n"))
    before = Window.partitionBy(*key, "side").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    total, whole = F.sum("_q").over(Window.partitionBy(*key, "side")), Window.partitionBy(*key)
    months = months.select(*key, "side", "_month", F.coalesce(F.sum("_q").over(before), F.lit(0.0)).alias("_before"), total.alias("_total"), F.ceil(F.sum("_n").over(whole) / SWEPT).alias("_parts"))
    months = months.withColumn("_width", F.greatest(F.max("_total").over(whole), F.lit(NOTHING)) / F.col("_parts")).drop("_total")
    own = Window.partitionBy(*key, "side", "_month").orderBy("d", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(months, [*key, "side", "_month"]).withColumn("hi", F.col("_before") + F.sum("qty").over(own))
    part = F.least(F.floor(F.col("hi") / F.col("_width")), F.col("_parts") - 1).cast("int")
    return rows.withColumns({"lo": F.col("hi") - F.col("qty"), "part": part}).drop("_month", "_before", "_parts", "_width")


def _ends(rows: DataFrame, *more: str) -> DataFrame:
    """The ends of lots ``l`` and sales ``s`` on the line of running quantities."""
    near = ["purchases"] if "purchases" in rows.columns else []
    lot = F.struct("hi", F.col("d").alias("bought"), F.col("seq").alias("lot"), F.col("qty").alias("lot_qty"), F.col("price").alias("cost_price"))
    sale = F.struct("hi", F.col("d").alias("sold"), F.col("seq").alias("sale"), F.col("qty").alias("sale_qty"), F.col("price").alias("sale_price"), *near)
    return rows.select("acct", "sec", *more, "hi", "d", "seq", "side", F.when(F.col("side") == "B", lot).alias("l"), F.when(F.col("side") == "S", sale).alias("s"))


def fifo(trades: DataFrame, causal: bool = False, near: int | None = None) -> DataFrame:
    """First-in-first-out matches ``(acct, sec, lot, sale, used, …)``: buys and sells as intervals of running quantity.

    The ends of all lots and sales of a key lie on one line; between two neighbouring ends exactly one lot and one sale are
    used: those that end next.  So there are at most as many matches as trades, found by one sort with the next end of either
    kind carried back.  An account with very many trades is cut into ranges of the line that hand on what ends next behind them.

    Lots are consumed in order of purchase even if bought after the sale; ``causal`` keeps matches with earlier lots only.
    ``near`` adds ``purchases``, those of the same key within so many days of the sale.
    """
    key = ["acct", "sec"]
    plain, many = _dealt(trades)
    down = [F.desc("hi"), F.desc("d"), F.desc("seq"), F.desc("side")]
    back = Window.partitionBy(*key).orderBy(*down)
    so_far = back.rowsBetween(Window.unboundedPreceding, 0)
    used = F.col("hi") - F.coalesce(F.lead("hi").over(back), F.lit(0.0))
    rows = _ends(_plain_running(plain, near)).select(*key, F.last("l", True).over(so_far).alias("l"), F.last("s", True).over(so_far).alias("s"), used.alias("used"))
    if many is not None:
        rows = rows.unionByName(_fifo_of_many(many, near, down))
    hit = rows.where((F.col("used") > NOTHING) & F.col("l").isNotNull() & F.col("s").isNotNull())
    sale = ("sale", "sold", "sale_qty", "sale_price", *(["purchases"] if near is not None else []))
    hit = hit.select(*key, *(f"l.{c}" for c in ("lot", "bought", "lot_qty", "cost_price")), *(f"s.{c}" for c in sale), "used")
    return hit.where("bought <= sold") if causal else hit


def _fifo_of_many(trades: DataFrame, near: int | None, down: list) -> DataFrame:
    """``acct, sec, l, s, used`` as in ``fifo``, range by range."""
    key = ["acct", "sec"]
    rows = _running(trades)
    if near is not None:
        rows = within_days(rows, trades.where("side = 'B'"), key, near, "purchases")
    rows = _ends(rows, "part")
    parts = rows.groupBy(*key, "part").agg(F.max("hi").alias("_last"), F.min("l").alias("_lot"), F.min("s").alias("_sale"))
    behind = Window.partitionBy(*key).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *key, "part", F.lag("_last").over(Window.partitionBy(*key).orderBy("part")).alias("_from"),
        F.last("_lot", True).over(behind).alias("_lot"), F.last("_sale", True).over(behind).alias("_sale"),
    )
    back = Window.partitionBy(*key, "part").orderBy(*down)
    so_far = back.rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(parts, [*key, "part"]).select(
        *key, F.coalesce(F.last("l", True).over(so_far), "_lot").alias("l"), F.coalesce(F.last("s", True).over(so_far), "_sale").alias("s"),
        (F.col("hi") - F.coalesce(F.lead("hi").over(back), "_from", F.lit(0.0))).alias("used"),
    )


def open_lots(trades: DataFrame, near: int | None = None) -> DataFrame:
    """What is left of each lot; lots that are used up drop out.  Needs no match: a lot is open above the total sold.

    ``near`` adds ``purchases``, the other ones of the same key within so many days of the lot's.
    """
    key = ["acct", "sec"]
    plain, many = _dealt(trades)
    sold = F.sum(F.when(F.col("side") == "S", F.col("qty"))).over(Window.partitionBy(*key))
    lots = _plain_running(plain, near).withColumn("sold", sold).where("side = 'B'")
    if many is not None:
        of_many = many.where("side = 'S'").groupBy(*key).agg(F.sum("qty").alias("sold"))
        more = _running(many.where("side = 'B'")).join(of_many, key, "left")
        if near is not None:
            more = within_days(more, many.where("side = 'B'"), key, near, "purchases")
        lots = lots.unionByName(more.select(lots.columns))
    left = F.least(F.col("qty"), F.greatest(F.lit(0.0), F.col("hi") - F.coalesce("sold", F.lit(0.0))))
    other = [(F.col("purchases") - F.col("d").isNotNull().cast("long")).alias("purchases")] if near is not None else []
    lots = lots.withColumn("remaining", left).where(F.col("remaining") > NOTHING)
    return lots.select(*key, F.col("seq").alias("lot"), F.col("d").alias("bought"), "remaining", "price", (F.col("remaining") * F.col("price")).alias("cost"), *other)


def within_days(rows: DataFrame, events: DataFrame, key: list[str], days: int, name: str) -> DataFrame:
    """``rows`` with the number of ``events`` of the same key whose date ``d`` is at most ``days`` from theirs, either way.

    Both sides meet as one row a key and day at most, counts summed over a range of days; no pairs are formed, and a key is never
    larger than its days.  A row without a date has none near it.
    """
    per = events.where("d is not null").groupBy(*key, "d").agg(F.count("*").alias("_n"), F.lit(False).alias("_asked"))
    asked = rows.where("d is not null").select(*key, "d").distinct().select(*key, "d", F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asked"))
    near = Window.partitionBy(*key).orderBy(F.unix_date("d")).rangeBetween(-days, days)
    counts = per.unionByName(asked).withColumn(name, F.sum("_n").over(near)).where("_asked").select(*key, "d", name)
    return rows.join(counts, [*key, "d"], "left").select(*rows.columns, F.coalesce(name, F.lit(0)).alias(name))


def loss_sale_flags(matches: DataFrame, trades: DataFrame, days: int = 30) -> DataFrame:
    """Lots bought within ``days`` of a sale whose proceeds were below the cost of what it removed."""
    sale = matches.groupBy("acct", "sec", "sale", "sold", "sale_qty", "sale_price").agg(F.sum(F.col("used") * F.col("cost_price")).alias("cost"))
    loss = sale.where(F.col("sale_qty") * F.col("sale_price") < F.col("cost")).select("acct", "sec", F.col("sold").alias("d"))
    lots = trades.where("side = 'B'").select("acct", "sec", "d", F.col("seq").alias("lot"))
    return within_days(lots, loss, ["acct", "sec"], days, "n").where("n > 0").select("acct", "sec", "lot", F.col("d").alias("bought")).distinct()


def classify(lots: DataFrame, as_of, long_days: int = 365) -> DataFrame:
    held = F.datediff(F.lit(as_of).cast("date"), F.col("bought"))
    return lots.withColumn("held_days", held).withColumn("term", F.when(held < long_days, "short").otherwise("long"))


def positions(trades: DataFrame) -> DataFrame:
    """Signed sum of trades; flat positions drop out."""
    q = F.sum(F.when(F.col("side") == "B", F.col("qty")).otherwise(-F.col("qty")))
    return trades.groupBy("acct", "sec").agg(q.alias("quantity"), F.count("*").alias("trades")).where("abs(quantity) > 1e-9")


def realised_gains(matches: DataFrame) -> DataFrame:
    """Proceeds less pro-rata cost of every match, with its holding term; ``wash`` where the matches count ``purchases`` near the sale."""
    gain = F.col("used") * (F.col("sale_price") - F.col("cost_price"))
    wash = [(F.col("purchases") > 0).alias("wash")] if "purchases" in matches.columns else []
    return matches.select("acct", "sec", "lot", "sale", "sold", "used", gain.alias("gain"), F.when(F.datediff("sold", "bought") < 365, "short").otherwise("long").alias("term"), *wash)


def select_for_sale(lots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lots to sell for ``wanted(acct, sec, qty)``: harvest lots first, then by purchase.  ``lots`` has ``harvest``."""
    w = Window.partitionBy("acct", "sec").orderBy(F.col("harvest").desc(), "bought", "lot").rowsBetween(Window.unboundedPreceding, 0)
    rows = lots.withColumn("hi", F.sum("remaining").over(w)).join(wanted, ["acct", "sec"])
    take = F.greatest(F.lit(0.0), F.least(F.col("remaining"), F.col("qty") - (F.col("hi") - F.col("remaining"))))
    return rows.withColumn("take", take).where("take > 1e-9").select("acct", "sec", "lot", "bought", "harvest", "take")


def history(trades: DataFrame, start, end, side: str | None = None) -> DataFrame:
    rows = trades.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.where(F.col("side") == side) if side else rows
