"""The domain tables of the queries, derived from the given tables; the SQL text states the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import month_index
from tidemark.runtime import reachable, settled


class Tables:
    """Domain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._kept = reachable(spark), sf_dir, {}

    def keep(self, name: str, make) -> DataFrame:
        """A table that several parts of one query read: worked out once and settled, which also keeps later plans small."""
        if name not in self._kept:
            self._kept[name] = settled(make(), name)
        return self._kept[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def daily(self) -> DataFrame:
        """(sec, d, price, cap) from line items of a supplier and day."""
        rows = self.read("lineitem").groupBy(F.col("l_suppkey").alias("sec"), F.col("l_shipdate").cast("date").alias("d"))
        return rows.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_extendedprice").alias("cap"))

    def security(self) -> DataFrame:
        s, n, r = self.read("supplier"), self.read("nation"), self.read("region")
        rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
        return rows.select(F.col("s_suppkey").alias("sec"), F.col("s_name").alias("ticker"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"), F.concat_ws("/", "n_name", (F.col("s_suppkey") % 3).cast("string")).alias("sub_industry"), F.when(F.col("s_suppkey") % 2 == 0, "N").otherwise("A").alias("exchange"), F.col("s_acctbal").alias("balance"))

    def quarters(self) -> DataFrame:
        """(sec, d, mi, fy, fq, income, sales, book, assets, debt, dividends): line items of a supplier and quarter."""
        d = F.col("l_shipdate").cast("date")
        rows = self.read("lineitem").groupBy(F.col("l_suppkey").alias("sec"), F.year(d).alias("fy"), F.quarter(d).alias("fq"))
        p = F.col("l_extendedprice")
        rows = rows.agg(F.sum(p).alias("sales"), F.sum(p * (1 - F.col("l_discount") * 5 - F.col("l_tax"))).alias("income"), F.sum(p * F.col("l_tax")).alias("dividends"), F.sum(p * F.col("l_discount")).alias("debt"))
        rows = rows.join(self.security().select("sec", "balance"), "sec")
        rows = rows.withColumns({"mi": F.col("fy") * 12 + F.col("fq") * 3 - 1, "book": F.abs("balance") + F.col("sales"), "assets": F.col("sales") + F.col("debt") + F.abs("balance")})
        return rows.withColumn("d", F.last_day(F.make_date("fy", F.col("fq") * 3, F.lit(1)))).drop("balance")

    def trades(self) -> DataFrame:
        """(acct, sec, d, seq, side, qty, price): line items as trades of a customer in a brand."""
        o, li, p = self.read("orders"), self.read("lineitem"), self.read("part")
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
        li = li.withColumn("_n", F.row_number().over(order))
        rows = o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
        return rows.select(
            F.col("o_custkey").alias("acct"), F.col("p_brand").alias("sec"), F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") * 1000 + F.col("_n")).alias("seq"),
            F.when(F.col("l_returnflag") == "R", "S").otherwise("B").alias("side"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        )

    def ledger(self) -> DataFrame:
        """The trades, worked out once for all parts of a query."""
        return self.keep("trades", self.trades)

    def last_prices(self) -> DataFrame:
        """(sec, price): the latest trade's price of each brand."""
        return self.keep("last_prices", self._last_prices)

    def _last_prices(self) -> DataFrame:
        # by day first: a maximum of numbers is hashed, one of structs would sort all trades
        days = self.ledger().groupBy("sec", "d").agg(F.max("seq").alias("seq"), F.max_by("price", "seq").alias("price"))
        return days.groupBy("sec").agg(F.max_by("price", F.struct("d", "seq")).alias("price"))

    def accounts(self) -> DataFrame:
        rate = F.when(F.col("c_mktsegment") == "BUILDING", 0.37).otherwise(0.32)
        return self.read("customer").select(F.col("c_custkey").alias("acct"), rate.alias("short_rate"), F.lit(0.2).alias("long_rate"))

    def facts(self) -> DataFrame:
        """(company, item, fy, fq, value, period): order totals by customer, priority and quarter, cumulated in the year."""
        d = F.col("o_orderdate").cast("date")
        q = self.read("orders").groupBy(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("item"), F.year(d).alias("fy"), F.quarter(d).cast("int").alias("fq")).agg(F.sum("o_totalprice").alias("own"))
        w = Window.partitionBy("company", "item", "fy").orderBy("fq").rowsBetween(Window.unboundedPreceding, 0)
        period = F.when(F.col("fq") == 1, "QTD").when(F.col("fq") == 2, "YTD_H1").when(F.col("fq") == 3, "YTD_9M").otherwise("YTD_ANNUAL")
        return q.select("company", "item", "fy", "fq", F.sum("own").over(w).alias("value"), period.alias("period"))

    def filings(self) -> DataFrame:
        return self.read("pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("content"))

    def mi(self, c: str):
        return month_index(F.col(c))


#: The same tables as common table expressions.
SQL = """
daily AS (SELECT l_suppkey AS sec, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_extendedprice) AS cap
          FROM lineitem GROUP BY ALL),
security AS (SELECT s_suppkey AS sec, s_name AS ticker, n_name AS industry, r_name AS sector, n_name || '/' || (s_suppkey % 3) AS sub_industry, CASE WHEN s_suppkey % 2 = 0 THEN 'N' ELSE 'A' END AS exchange,
             s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
quarters0 AS (SELECT l_suppkey AS sec, year(CAST(l_shipdate AS DATE)) AS fy, quarter(CAST(l_shipdate AS DATE)) AS fq, sum(l_extendedprice) AS sales,
              sum(l_extendedprice * (1 - l_discount * 5 - l_tax)) AS income, sum(l_extendedprice * l_tax) AS dividends, sum(l_extendedprice * l_discount) AS debt
              FROM lineitem GROUP BY ALL),
quarters AS (SELECT q.*, fy * 12 + fq * 3 - 1 AS mi, abs(balance) + sales AS book, sales + debt + abs(balance) AS assets,
             last_day(make_date(fy, fq * 3, 1)) AS d FROM quarters0 q JOIN security USING (sec)),
trades AS (SELECT o_custkey AS acct, p_brand AS sec, CAST(o_orderdate AS DATE) AS d, o_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS seq,
           CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'B' END AS side, l_quantity AS qty, l_extendedprice / l_quantity AS price
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
last_prices AS (SELECT sec, arg_max(price, (d, seq)) AS price FROM trades GROUP BY sec),
accounts AS (SELECT c_custkey AS acct, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.37 ELSE 0.32 END::DOUBLE AS short_rate, 0.2::DOUBLE AS long_rate FROM customer),
facts AS (SELECT company, item, fy, fq, sum(own) OVER (PARTITION BY company, item, fy ORDER BY fq ROWS UNBOUNDED PRECEDING) AS value,
          CASE fq WHEN 1 THEN 'QTD' WHEN 2 THEN 'YTD_H1' WHEN 3 THEN 'YTD_9M' ELSE 'YTD_ANNUAL' END AS period
          FROM (SELECT o_custkey AS company, o_orderpriority AS item, year(CAST(o_orderdate AS DATE)) AS fy, quarter(CAST(o_orderdate AS DATE)) AS fq, sum(o_totalprice) AS own FROM orders GROUP BY ALL)),
monthly AS (SELECT sec, last_day(d) AS month, max(d) AS month_end_date, arg_max(price, d) AS price, arg_max(cap, d) AS cap, year(max(d)) * 12 + month(max(d)) - 1 AS mi FROM daily GROUP BY sec, last_day(d)),
returns AS (SELECT *, price / lag(price) OVER (PARTITION BY sec ORDER BY month) - 1 AS ret FROM monthly),
market AS (SELECT month, mi, sum(ret * cap) / sum(cap) AS market_return, sum(cap) AS total_cap, count(*) AS n FROM returns WHERE ret IS NOT NULL AND cap > 0 GROUP BY month, mi)
"""
