"""Wash sales, tax benefits and loss-harvest candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lots import within_days


def wash_sales(sales: DataFrame, buys: DataFrame, days: int = 30, exclude_own_lot: bool = False) -> DataFrame:
    """``sales(acct, sec, d[, lot])`` with ``wash`` and the number of purchases within ``days`` either way; ``exclude_own_lot``
    does not count the purchase of the lot that is sold."""
    key = ["acct", "sec"]
    out = within_days(sales, buys, key, days, "purchases")
    if exclude_own_lot:
        own = buys.select(*key, F.col("seq").alias("lot"), F.col("d").alias("_bought"))
        mine = F.coalesce(F.abs(F.datediff("_bought", "d")) <= days, F.lit(False)).cast("long")
        out = out.join(own, [*key, "lot"], "left").withColumn("purchases", F.col("purchases") - mine).select(out.columns)
    return out.withColumn("wash", F.col("purchases") > 0)


def excluded_securities(sales: DataFrame, buys: DataFrame, days: int = 30) -> DataFrame:
    """Per account and sale date the securities that may not be bought back, in order: those sold, and those bought near the sale.

    Days are dealt into bins of ``days`` + 1; a sale looks into the three bins that can hold a day near it.
    """
    width = days + 1
    day = lambda c: F.unix_date(c)
    dates = sales.where("d is not null").select("acct", "d").distinct()
    dates = dates.withColumn("bin", F.explode(F.sequence(F.floor((day("d") - days) / width), F.floor((day("d") + days) / width))))
    bought = buys.select("acct", "sec", F.col("d").alias("bd"), F.floor(day("d") / width).alias("bin")).distinct()
    near = dates.join(bought, ["acct", "bin"]).where(F.abs(F.datediff("bd", "d")) <= days).select("acct", "d", "sec")
    out = near.unionByName(sales.select("acct", "d", "sec")).groupBy("acct", "d").agg(F.sort_array(F.collect_set("sec")).alias("excluded"))
    return out.withColumn("n_excluded", F.size("excluded").cast("long"))


def tax_benefit(lots: DataFrame, accounts: DataFrame, as_of) -> DataFrame:
    """``lots(acct, sec, lot, bought, remaining, price, last)``: loss, rate by holding period and benefit (0 for gains); a column ``wash`` is kept."""
    rows = lots.join(accounts, "acct")
    held = F.datediff(F.lit(as_of).cast("date"), F.col("bought"))
    rate = F.when(held >= 365, F.col("long_rate")).otherwise(F.col("short_rate"))
    gain = F.col("remaining") * (F.col("last") - F.col("price"))
    return rows.select("acct", "sec", "lot", "bought", held.alias("held_days"), gain.alias("gain"), rate.alias("rate"), F.when(gain < 0, -gain * rate).otherwise(0.0).alias("benefit"), (F.col("remaining") * F.col("last")).alias("market_value"), *(c for c in ["wash"] if c in lots.columns))


def portfolio_benefit(benefits: DataFrame) -> DataFrame:
    """Short- and long-term losses and benefits of an account and the effective rate."""
    short, loss = F.col("held_days") < 365, F.when(F.col("gain") < 0, -F.col("gain")).otherwise(0.0)
    part = lambda test, x: F.sum(F.when(test, x).otherwise(0.0))
    out = benefits.groupBy("acct").agg(part(short, loss).alias("short_loss"), part(~short, loss).alias("long_loss"), part(short, F.col("benefit")).alias("short_benefit"), part(~short, F.col("benefit")).alias("long_benefit"))
    return out.withColumn("effective_rate", F.coalesce(F.try_divide(F.col("short_benefit") + F.col("long_benefit"), F.col("short_loss") + F.col("long_loss")), F.lit(0.0)))


def replacements(security: DataFrame, correlation: DataFrame, most: int = 5, least_corr: float = 0.7, least_days: int = 30, exclude: DataFrame | None = None) -> DataFrame:
    """Candidates to replace a security: of the same type, same sector first, then others; correlated enough or of unknown correlation.

    ``security(sec, sector, industry[, exchange, type])``; without these columns all have one exchange and type.
    ``correlation(si, sj, corr, n)`` holds each unordered pair at most once; fewer than ``least_days`` common dates, or no
    row, is unknown.  ``exclude(sec, candidate)`` are pairs that may not be.  A null sector, industry, exchange or type is
    nobody else's.  Similarity: .5 for the sector, .3 industry, .1 exchange, .1 type.
    """
    security = security.withColumns({c: F.lit("") for c in ("exchange", "type") if c not in security.columns})
    both = correlation.where("si <> sj")
    both = both.select("si", "sj", "corr", "n").unionByName(both.select(F.col("sj").alias("si"), F.col("si").alias("sj"), "corr", "n"))
    barred = both.where((F.col("n") >= least_days) & (F.abs("corr") < least_corr)).select(F.col("si").alias("sec"), F.col("sj").alias("candidate"))
    if exclude is not None:
        barred = barred.union(exclude.select("sec", "candidate")).distinct()
    place = F.row_number().over(Window.partitionBy("type").orderBy("sec"))  # one narrow row a security
    b = security.select(F.col("sec").alias("candidate"), F.col("sector").alias("s2"), F.col("industry").alias("i2"), F.col("exchange").alias("e2"), F.col("type").alias("t2"), place.alias("place"))
    peers = F.count("sector").over(Window.partitionBy("sector", "type"))
    a = security.where("type is not null").select("sec", F.col("sector").alias("s1"), F.col("industry").alias("i1"), F.col("exchange").alias("e1"), F.col("type").alias("t1"), peers.alias("peers"))
    same = a.drop("peers").join(b.drop("place"), (F.col("s1") == F.col("s2")) & (F.col("t1") == F.col("t2")))
    # among so many first securities of its type at least ``most`` are neither barred nor of the same sector
    reach = a.join(barred.groupBy("sec").agg(F.count("*").alias("b")), "sec", "left").withColumn("place", F.explode(F.sequence(F.lit(1), (most + 1 + F.col("peers") + F.coalesce("b", F.lit(0))).cast("int"))))
    others = reach.join(b, (reach["place"] == b["place"]) & (F.col("t1") == F.col("t2"))).where(~F.coalesce(F.col("s1") == F.col("s2"), F.lit(False))).select(same.columns)
    pairs = same.unionByName(others).where("sec <> candidate").join(barred, ["sec", "candidate"], "left_anti")
    pairs = pairs.withColumns({"alike": F.coalesce(F.col("s1") == F.col("s2"), F.lit(False)), "close": F.coalesce(F.col("i1") == F.col("i2"), F.lit(False))})
    similar = 0.5 * F.col("alike").cast("double") + 0.3 * F.col("close").cast("double") + 0.1 * F.coalesce(F.col("e1") == F.col("e2"), F.lit(False)).cast("double") + 0.1
    order = Window.partitionBy("sec").orderBy(F.desc("alike"), "candidate")
    return pairs.withColumns({"similarity": similar, "rank": F.row_number().over(order)}).where(F.col("rank") <= most).select("sec", "candidate", "rank", "similarity")


def opportunities(benefits: DataFrame, wash: DataFrame | None, candidates: DataFrame, least_loss: float = 100.0, top: int = 10) -> DataFrame:
    """Open lots with a loss worth taking, scored, the best ``top`` of each account.

    Score: 1000 x (benefit, halved if a wash sale, plus 0.2 x benefit x mean similarity of the three best candidates, or
    times 0.7 without candidates) over the loss; scores equal to six places tie, and go by security and lot.
    ``wash(acct, sec, lot, wash)``, or None if ``benefits`` has a column of that name.
    """
    best = candidates.where("rank <= 3").groupBy("sec").agg(F.avg("similarity").alias("similarity"))
    rows = benefits.where(F.col("gain") <= -least_loss)
    if wash is not None:
        rows = rows.join(wash.select("acct", "sec", "lot", "wash"), ["acct", "sec", "lot"], "left")
    rows = rows.join(best, "sec", "left")
    worth = F.col("benefit") * F.when(F.coalesce("wash", F.lit(False)), 0.5).otherwise(1.0)
    worth = F.when(F.col("similarity").isNull(), worth * 0.7).otherwise(worth + F.col("benefit") * 0.2 * F.col("similarity"))
    rows = rows.withColumn("score", worth / -F.col("gain") * 1000)
    order = Window.partitionBy("acct").orderBy(F.desc(F.round("score", 6)), "sec", "lot")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("acct", "rank", "sec", "lot", "gain", "benefit", F.coalesce("wash", F.lit(False)).alias("wash"), "score")


def opportunity_summary(found: DataFrame, significant: float = 500.0) -> DataFrame:
    return found.groupBy("acct").agg(F.count("*").alias("n"), F.count_if(F.col("benefit") > significant).alias("significant"), F.sum("benefit").alias("total_benefit"), F.sum(-F.col("gain")).alias("total_loss"), F.avg("score").alias("mean_score"))


def tax_coefficients(benefits: DataFrame) -> DataFrame:
    """Benefit per unit of market value of each account and security."""
    out = benefits.groupBy("acct", "sec").agg(F.sum("benefit").alias("b"), F.sum("market_value").alias("v"))
    return out.select("acct", "sec", F.coalesce(F.try_divide("b", "v"), F.lit(0.0)).alias("coefficient"))
