"""Queries on filing texts, facts, items, comparisons and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.functions import date_before, fiscal_quarter, fiscal_year, number_from_text
from tidemark.operators import filings, fundamentals, items, prices, quality
from tidemark.plans.registry import Registry
from tidemark.plans.standins import Tables
from tidemark.runtime import shared_folder

registry = Registry()
add = registry.add
QUERIES, ORACLE_SQL = registry.queries, registry.sql
KEYS = ["company", "fy", "fq", "item"]

_QUARTER = "qf AS (SELECT company, item, fy, fq, value - coalesce(lag(value) OVER (PARTITION BY company, item, fy ORDER BY fq), 0) AS value FROM facts)"
#: Tags of the stand-in filings and the items they map to: fixed values.
TAGS = (("us-gaap:1-URGENT", "sale"), ("us-gaap:2-HIGH", "cogs"), ("3-MEDIUM", "xsga"), ("ext:4-NOT SPECIFIED", "act"), ("5-LOW", "lct"))


def _mapping(t):
    return t.spark.createDataFrame([(tag, item, n) for n, (tag, item) in enumerate(TAGS)], "tag string, item string, n int")


def _wide(t):
    rows = items.map_tags(t.facts().withColumnRenamed("item", "tag"), _mapping(t))
    return items.widen(rows, ["company", "fy", "fq"], [i for _, i in TAGS])


_WIDE = """
wd AS (SELECT company, fy, fq, max(value) FILTER (item = '1-URGENT') AS sale, max(value) FILTER (item = '2-HIGH') AS cogs, max(value) FILTER (item = '3-MEDIUM') AS xsga,
       max(value) FILTER (item = '4-NOT SPECIFIED') AS act, max(value) FILTER (item = '5-LOW') AS lct FROM facts GROUP BY ALL)
"""


@add("""SELECT CAST(page_id AS BIGINT) AS id, len(regexp_extract_all(html, '<a\\s')) AS links, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, length(html) AS chars, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages""")
def j7_page_structure(t):
    return filings.links(t.filings())


@add("""SELECT o_orderkey AS id, CAST(n AS INTEGER) AS "row", CASE n WHEN 1 THEN 'Total revenue' WHEN 2 THEN 'Net loss' ELSE 'Shares' END AS label, CASE n WHEN 1 THEN round(o_totalprice, 2) WHEN 2 THEN -(o_orderkey % 1000 + 0.5) END AS value FROM orders, (SELECT unnest([1, 2, 3]) AS n) WHERE n < 3 OR o_orderkey % 2 = 0""", "value", places=4)
def j7_table_values(t):
    """A table of each order: heading cells alone, a number behind marks and blanks, a loss in brackets, a row of dashes or of one cell."""
    o = t.read("orders")
    text = F.concat(
        F.lit("<html><TABLE><tr class='h'><th>(in dollars)</th></tr>\n<tr><td><b>Total&nbsp;</b> revenue</td><td> $ </td><td align=right>"), F.format_number("o_totalprice", 2), F.lit("</td><td>9</td></tr><TR><td>Net loss</td><td>("),
        F.format_number(F.pmod("o_orderkey", F.lit(1000)) + F.lit(0.5), 1), F.lit(")</td></TR><tr><td>Shares</td>"), F.when(F.col("o_orderkey") % 2 == 0, "<td>-</td>").otherwise(""), F.lit("</tr></TABLE>"),
    )
    return filings.tables(o.select(F.col("o_orderkey").alias("id"), text.alias("content")))


@add("SELECT o_orderkey, filed, d FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INTEGER) AS filed FROM orders)")
def g9_inferred_year(t):
    """Days without a year, by the date of the filing."""
    d = F.col("o_orderdate").cast("date")
    rows = t.read("orders").select("o_orderkey", F.date_format(d, "MMMM d").alias("text"), F.date_add(d, F.pmod("o_orderkey", F.lit(300)).cast("int")).alias("filed"))
    return rows.select("o_orderkey", "filed", date_before(F.col("text"), F.col("filed")).alias("d"))


def _order_filings(t):
    d = F.date_format("o_orderdate", "yyyyMMdd")
    text = F.concat(F.lit("CONFORMED SUBMISSION TYPE: 10-Q\nFILED AS OF DATE: "), d, F.lit("\nCOMPANY CONFORMED NAME: Customer "), "o_custkey", F.lit("\nCENTRAL INDEX KEY: "), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("\nFISCAL YEAR END: 1231\n"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    context = F.concat(F.lit('<xbrli:context id="c1"><startDate>'), day, F.lit("</startDate><endDate>"), F.date_format(F.date_add("o_orderdate", F.pmod("o_orderkey", F.lit(400)).cast("int")), "yyyy-MM-dd"), F.lit("</endDate></xbrli:context>"))
    fact = F.concat(F.lit('<ix:nonFraction scale="3" contextRef="c1" name="us-gaap:Revenues">('), F.format_number("o_totalprice", 2), F.lit(")</ix:nonFraction>"))
    return t.read("orders").select(F.col("o_orderkey").alias("id"), F.concat(text, context, fact).alias("content"))


@add("SELECT o_orderkey AS id, ltrim(CAST(o_custkey AS VARCHAR), '0') AS cik, 'Customer ' || o_custkey AS name, CAST(o_orderdate AS DATE) AS filed, '10-Q' AS form FROM orders")
def j1_filing_headers(t):
    return filings.header(_order_filings(t))


@add("""SELECT o_orderkey AS id, 'c1' AS context, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS "end",
  CASE WHEN o_orderkey % 400 <= 100 THEN 'QTD' WHEN o_orderkey % 400 <= 200 THEN 'YTD_H1' WHEN o_orderkey % 400 <= 290 THEN 'YTD_9M' ELSE 'YTD_ANNUAL' END AS kind FROM orders""")
def j2_period_contexts(t):
    return filings.contexts(_order_filings(t))


@add("SELECT o_orderkey AS id, 'Revenues' AS tag, 'c1' AS context, -round(o_totalprice, 2) / 1000 AS value FROM orders", "value", places=6)
def j3_inline_facts(t):
    return filings.facts(_order_filings(t))


@add("""SELECT id, tag, kind, value FROM (SELECT o_custkey AS id, o_orderpriority AS tag, CASE WHEN o_orderkey % 3 = 0 THEN 'QTD' WHEN o_orderkey % 3 = 1 THEN 'INSTANT' ELSE 'YTD_H1' END AS kind, o_totalprice AS value FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1)""", "value", places=2)
def j4_value_per_tag(t):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "QTD").when(F.col("o_orderkey") % 3 == 1, "INSTANT").otherwise("YTD_H1")
    return filings.choose(t.read("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("tag"), kind.alias("kind"), F.col("o_totalprice").alias("value")))


@add("SELECT o_orderkey AS id, -round(o_totalprice, 2) AS total FROM orders", "total", places=2)
def j8_text_values(t):
    text = F.concat(F.lit("Total revenue for the period: $("), F.format_number("o_totalprice", 2), F.lit(")\n"))
    return filings.text_values(t.read("orders").select(F.col("o_orderkey").alias("id"), text.alias("content")), {"total": "total revenue"})


@add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS value FROM orders", "value", places=2)
def g8_numbers_from_text(t):
    text = F.format_number("o_totalprice", 2)
    return t.read("orders").select(F.col("o_orderkey").alias("id"), number_from_text(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)).alias("value"))


@add("SELECT o_orderkey AS id, CAST(CASE WHEN m > 6 THEN y + 1 ELSE y END AS INTEGER) AS fy, CAST((m - 7 + 12) % 12 // 3 + 1 AS INTEGER) AS fq, CAST(year(d - INTERVAL 6 MONTH) AS INTEGER) AS formation FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)")
def g4_fiscal_calendar(t):
    d = F.col("o_orderdate").cast("date")
    june = F.lit(6)
    return t.read("orders").select(F.col("o_orderkey").alias("id"), fiscal_year(F.year(d), F.month(d), june).alias("fy"), fiscal_quarter(F.month(d), june).alias("fq"), F.year(F.add_months(d, -6)).alias("formation"))


@add("SELECT company, fy, fq, m.item AS item, value FROM facts f JOIN (VALUES ('1-URGENT', 'sale'), ('2-HIGH', 'cogs'), ('3-MEDIUM', 'xsga'), ('4-NOT SPECIFIED', 'act'), ('5-LOW', 'lct')) m(tag, item) ON f.item = m.tag", "value", places=2)
def j10_tag_mapping(t):
    return items.map_tags(t.facts().withColumnRenamed("item", "tag"), _mapping(t)).select("company", "fy", "fq", "item", "value")


@add("""SELECT tag, coalesce(item, kw) AS item, CASE WHEN item IS NOT NULL THEN 'similar' ELSE 'keywords' END AS how FROM (SELECT tg.tag, kw, (SELECT arg_min(m.item, (m.n, m.item)) FROM mp m WHERE (contains(tg.a, m.b) OR contains(m.b, tg.a))
    AND len(list_intersect(list_distinct(string_split(tg.a, '')), list_distinct(string_split(m.b, '')))) / len(list_distinct(list_concat(string_split(tg.a, ''), string_split(m.b, '')))) > 0.7) AS item FROM tg) WHERE coalesce(item, kw) IS NOT NULL""", "", """
nm AS (SELECT DISTINCT p_name || CASE p_size % 3 WHEN 0 THEN ' Operating Expense' WHEN 1 THEN ' Total' ELSE 'Dividend-Paid' END AS tag FROM part UNION SELECT substr(p_type, 1, 3) FROM part UNION SELECT upper(p_brand) || ':' || p_type FROM part UNION SELECT '--' FROM part),
tg AS (SELECT tag, a, CASE WHEN contains(a, 'operating') AND contains(a, 'expense') THEN 'xopr' WHEN contains(a, 'dividend') AND contains(a, 'paid') THEN 'dvp' END AS kw FROM (SELECT tag, regexp_replace(lower(regexp_replace(tag, '^[^:]*:', '')), '[^a-z0-9]', '', 'g') AS a FROM nm) WHERE a <> ''),
mp AS (SELECT regexp_replace(lower(tag), '[^a-z0-9]', '', 'g') AS b, item, n FROM (SELECT p_type AS tag, arg_min(p_brand, p_partkey) AS item, min(p_partkey) AS n FROM part GROUP BY p_type UNION ALL SELECT p_name, arg_min(p_brand, p_partkey), 1000000 + min(p_partkey) FROM part GROUP BY p_name))
""")
def j11_fuzzy_tags(t):
    """Tags made of part names, types and brands against a dictionary of types and names."""
    p = t.read("part")
    end = F.when(F.col("p_size") % 3 == 0, " Operating Expense").when(F.col("p_size") % 3 == 1, " Total").otherwise("Dividend-Paid")
    tags = p.select(F.concat("p_name", end).alias("tag")).union(p.select(F.substring("p_type", 1, 3))).union(p.select(F.concat(F.upper("p_brand"), F.lit(":"), "p_type"))).union(p.select(F.lit("--"))).distinct()
    entries = lambda c, more: p.groupBy(F.col(c).alias("tag")).agg(F.min_by("p_brand", "p_partkey").alias("item"), (F.min("p_partkey") + more).alias("n"))
    return items.fuzzy(tags, entries("p_type", 0).union(entries("p_name", 1_000_000)))


#: Items of a company and quarter with gaps: each is there in some of the quarters only.
_GAPPED = {
    "sale": "sales", "revt": "CASE WHEN fq = 2 THEN sales * 1.1 END", "cogs": "CASE WHEN fq <> 4 THEN sales * 0.6 END", "dp": "CASE WHEN fq <> 3 THEN dividends END", "oiadp": "CASE WHEN fq < 3 THEN income END", "sellmkt": "CASE WHEN fq = 1 THEN debt END",
    "genadm": "CASE WHEN fq < 3 THEN debt * 2 END", "xrd": "CASE WHEN fq = 2 THEN debt * 3 END", "xsga": "CASE WHEN fq = 4 THEN debt END", "act": "assets", "lct": "CASE WHEN fq <> 1 THEN debt END", "dlc": "debt", "dltt": "CASE WHEN fq > 1 THEN book * 0.1 END",
    "ceq": "CASE WHEN fq <> 2 THEN book END", "at": "CASE WHEN fq <> 3 THEN assets END", "lt": "CASE WHEN fq = 3 THEN debt END", "cshpr": "1000.0 * (fq - 1)", "ni": "income", "ib": "CASE WHEN fq = 4 THEN income * 2 END", "cash": "CASE WHEN fq <> 4 THEN dividends END",
    "sti": "CASE WHEN fq = 2 THEN debt END", "che": "CASE WHEN fq > 2 THEN debt END", "lo": "CASE WHEN fq = 1 THEN debt END", "epspi": "income / 1000",
}


@add("""SELECT sec, fy, fq, coalesce(oiadp + dp, sale - cogs - xs) AS oibdp, coalesce(revt - cogs, sale - cogs) AS gp, act - lct AS wcap, coalesce(ceq + dltt, a2 - lct + dltt) AS icapt, dlc + dltt AS dcom, a2 AS total_assets, coalesce(lt, ta - ceq) AS lt, CASE WHEN cshpr > 0 THEN sale / cshpr END AS spi,
  CASE WHEN cshpr > 0 THEN oiadp / cshpr END AS opeps, CASE WHEN cshpr > 0 THEN oiadp / cshpr END * 4 AS oeps12, xs AS xsga, CASE WHEN coalesce(xs, xrd) IS NOT NULL THEN coalesce(xs, 0) + coalesce(xrd, 0) END AS xoptdp, coalesce(ib, ni) * 4 AS ibadj12, ceq AS teq, greatest(che, CASE WHEN coalesce(cash, 0) > 0 OR coalesce(sti, 0) > 0 THEN coalesce(cash, 0) + coalesce(sti, 0) END) AS che,
  lo * 0.5 AS xacc, dp * 0.8 AS drc, epspi * 4 AS epsf12, cshpr * 4 AS csh12, cogs - coalesce(dp, 0) AS net_cost FROM (SELECT *, coalesce(xsga, CASE WHEN coalesce(sellmkt, genadm, xrd) IS NOT NULL THEN coalesce(sellmkt, 0) + coalesce(genadm, 0) + coalesce(xrd, 0) END) AS xs, coalesce(ta, lt + ceq) AS a2 FROM gp0)""",
     "oibdp gp wcap icapt dcom total_assets lt spi opeps oeps12 xsga xoptdp ibadj12 teq che xacc drc epsf12 csh12 net_cost", "gp0 AS (SELECT sec, fy, fq, " + ", ".join(f"{x} AS {'ta' if c == 'at' else c}" for c, x in _GAPPED.items()) + " FROM quarters)", places=3)
def j13_rule_graph(t):
    """One result of every family of rules, over quarters with gaps."""
    wide = t.quarters().select("sec", "fy", "fq", *(F.expr(x).cast("double").alias(c) for c, x in _GAPPED.items()))
    net = items.cost_less_depreciation(wide).select("sec", "fy", "fq", F.col("cogs").alias("net_cost"))
    wanted = "oibdp gp wcap icapt dcom at lt spi opeps oeps12 xsga xoptdp ibadj12 teq che xacc drc epsf12 csh12".split()
    return items.derive(wide).select("sec", "fy", "fq", *wanted).withColumnRenamed("at", "total_assets").join(net, ["sec", "fy", "fq"])


@add("SELECT * FROM wd", "sale cogs xsga act lct", _WIDE, places=2)
def d11_wide_items(t):
    return _wide(t)


@add("SELECT company, fy, fq, sale, cogs, xsga, act, lct, sale - cogs - xsga AS oibdp, sale - cogs AS gp, act - lct AS wcap FROM wd", "sale cogs xsga act lct oibdp gp wcap", _WIDE, places=2)
def j13_derived_items(t):
    return items.derive(_wide(t)).select("company", "fy", "fq", "sale", "cogs", "xsga", "act", "lct", "oibdp", "gp", "wcap")


@add("SELECT company, fy, fq, CASE WHEN act + coalesce(lct, 0) > 1.1 * act THEN act + coalesce(lct, 0) ELSE act END AS dltt_with_leases, CASE WHEN sale + coalesce(cogs, 0) > 1.1 * sale THEN sale + coalesce(cogs, 0) ELSE sale END AS dlc_with_leases FROM wd", "dltt_with_leases dlc_with_leases", _WIDE, places=2)
def j14_debt_with_leases(t):
    w = _wide(t).select("company", "fy", "fq", F.col("act").alias("dltt"), F.col("lct").alias("lease_noncurrent"), F.col("sale").alias("dlc"), F.col("cogs").alias("lease_current"))
    return items.debt_with_leases(w).select("company", "fy", "fq", "dltt_with_leases", "dlc_with_leases")


@add("""SELECT company AS id, tag, value FROM (SELECT company, item AS tag, max(value) AS value FROM facts WHERE item IN ('5-LOW', '2-HIGH', '1-URGENT') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY company ORDER BY CASE tag WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END) = 1""", "value", places=2)
def j12_preferred_source(t):
    rows = t.facts().groupBy(F.col("company").alias("id"), F.col("item").alias("tag")).agg(F.max("value").alias("value"))
    return items.preferred_source(rows, ["5-LOW", "2-HIGH", "1-URGENT"])


@add("""SELECT company, item, fy, fq, value FROM (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY company, item, fy ORDER BY fq), 0) AS v, row_number() OVER (PARTITION BY company, item, fy ORDER BY fq) AS n FROM facts) x
  JOIN (SELECT company, item, fy, fq, v AS value FROM (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY company, item, fy ORDER BY fq), 0) AS v, row_number() OVER (PARTITION BY company, item, fy ORDER BY fq) AS n FROM facts) WHERE NOT (fq = 4 AND n = 1)) y USING (company, item, fy, fq)""".replace("SELECT company, item, fy, fq, value FROM", "SELECT company, item, fy, fq, y.value AS value FROM", 1), "value", places=2)
def j16_quarter_from_ytd(t):
    return fundamentals.ytd_fold(t.facts())


@add("""SELECT company, fy, fq, item, effective, value FROM (SELECT o_custkey AS company, year(o_orderdate) AS fy, quarter(o_orderdate) AS fq, o_orderpriority AS item, CAST(o_orderdate AS DATE) AS effective, o_totalprice AS value FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), quarter(o_orderdate), o_orderpriority ORDER BY CAST(o_orderdate AS DATE) DESC, o_totalprice DESC) = 1)""", "value", places=2)
def j17_fact_revision(t):
    d = F.col("o_orderdate").cast("date")
    rows = t.read("orders").select(F.col("o_custkey").alias("company"), F.year(d).cast("long").alias("fy"), F.quarter(d).cast("long").alias("fq"), F.col("o_orderpriority").alias("item"), d.alias("effective"), d.alias("through"), F.col("o_totalprice").alias("value"))
    return items.revise(rows).drop("through")


@add("SELECT o_custkey AS company, arg_min(o_orderpriority, o_orderkey) AS priority, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P') AS status FROM orders GROUP BY o_custkey")
def j18_company_table(t):
    rows = t.read("orders").select(F.col("o_custkey").alias("company"), "o_orderkey", F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("status"))
    return items.company_table(rows, "company", ["priority", "status"], "o_orderkey")


@add("SELECT company, fy, fq, item, CASE WHEN r IS NOT NULL AND (v IS NULL OR abs(v - r) > 0.01) THEN r ELSE v END AS value, CASE WHEN r IS NOT NULL AND v IS NULL THEN 'inserted' WHEN r IS NOT NULL AND abs(v - r) > 0.01 THEN 'replaced' ELSE 'kept' END AS action FROM (SELECT company, fy, fq, item, value AS v FROM facts WHERE fq <> 2) FULL JOIN (SELECT company, fy, fq, item, CASE WHEN fq = 3 THEN value * 1.1 ELSE value END AS r FROM facts WHERE fq <> 1) USING (company, fy, fq, item)", "value", places=2)
def j19_gap_fill(t):
    f = t.facts().select(*KEYS, "value")
    ref = f.where("fq <> 1").withColumn("value", F.when(F.col("fq") == 3, F.col("value") * 1.1).otherwise(F.col("value")))
    return items.fill_gaps(f.where("fq <> 2"), ref, KEYS)


@add("SELECT o_custkey AS company, o_orderpriority AS priority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def d9_most_common(t):
    return items.most_common(t.read("orders").select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("priority")), "company", "priority")


@add("""SELECT company, sic, coalesce(code, m, f) AS code FROM (SELECT c_custkey AS company, c_mktsegment AS sic, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey % 4 AS VARCHAR) END AS code FROM customer) LEFT JOIN
  (SELECT sic, code AS m FROM (SELECT c_mktsegment AS sic, CAST(c_nationkey % 4 AS VARCHAR) AS code, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sic ORDER BY n DESC, code) = 1) USING (sic) LEFT JOIN (SELECT 'BUILDING' AS sic, '9' AS f) USING (sic)""")
def j20_industry_codes(t):
    c = t.read("customer").select(F.col("c_custkey").alias("company"), F.col("c_mktsegment").alias("sic"), (F.col("c_nationkey") % 4).cast("string").alias("code"))
    return items.industry_codes(c.select("company", "sic"), c.where("company % 3 = 0").select("company", "code"), t.spark.createDataFrame([("BUILDING", "9")], "sic string, code string"))


@add("SELECT company, fy, fq, unnest(['sale', 'cogs']) AS item, unnest([sale, cogs]) AS value FROM wd WHERE sale > 300000 AND cogs > 300000 UNION ALL SELECT company, fy, fq, 'sale', sale FROM wd WHERE sale > 300000 AND NOT coalesce(cogs > 300000, false) UNION ALL SELECT company, fy, fq, 'cogs', cogs FROM wd WHERE cogs > 300000 AND NOT coalesce(sale > 300000, false)", "value", _WIDE, places=2)
def j21_magnitude_warnings(t):
    return items.warnings(_wide(t).select("company", "fy", "fq", "sale", "cogs"), {"sale": 3e5, "cogs": 3e5})


_OTHER = "other AS (SELECT company, fy, fq, item, CASE WHEN company % 7 = 0 THEN value * 1.05 ELSE value END AS value FROM facts)"


def _other(t):
    return t.facts().select(*KEYS, F.when(F.col("company") % 7 == 0, F.col("value") * 1.05).otherwise(F.col("value")).alias("value"))


@add("SELECT CASE WHEN grouping(item) = 1 THEN 'ALL' ELSE item END AS item, count(*) AS n, count_if(ok) AS matches, max(d) AS largest, count_if(ok) / count(*) AS accuracy FROM (SELECT item, abs(f.value - o.value) AS d, CASE WHEN abs(o.value) < 1 THEN abs(f.value - o.value) <= 0.01 ELSE abs(f.value - o.value) <= 0.01 * abs(o.value) END AS ok FROM facts f JOIN other o USING (company, fy, fq, item)) GROUP BY ROLLUP (item)", "largest accuracy", _OTHER, places=3)
def q4_item_accuracy(t):
    return quality.accuracy(t.facts(), _other(t), KEYS)


@add("SELECT company, fy, fq, item, f.value AS a, o.value AS b, round(abs(f.value - o.value) / abs(o.value) * 100, 6) AS percent FROM facts f JOIN other o USING (company, fy, fq, item) WHERE abs(f.value - o.value) > 1 ORDER BY round(abs(f.value - o.value) / abs(o.value) * 100, 6) DESC, company, fy, fq, item LIMIT 20", "a b percent", _OTHER, places=3)
def q6_discrepancies(t):
    both = quality.discrepancies(t.facts(), _other(t), KEYS, top=1 << 30)
    return both.withColumn("percent", F.round("percent", 6)).orderBy(F.desc("percent"), *KEYS).limit(20)




@add("SELECT unnest(['o_orderkey', 'o_custkey', 'status']) AS \"column\", unnest([count(o_orderkey), count(o_custkey), count(nullif(o_orderstatus, 'P'))]) AS filled, unnest([count(o_orderkey), count(o_custkey), count(nullif(o_orderstatus, 'P'))]) / any_value(n) AS share FROM orders, (SELECT count(*) AS n FROM orders)", "share")
def q7_column_population(t):
    return quality.population(t.read("orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")))


@add("""SELECT c_custkey AS company, 'orders' AS "table", count(o_orderkey) AS rows, CASE WHEN count(o_orderkey) = 0 THEN 'empty' ELSE 'populated' END AS state FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
  UNION ALL SELECT c_custkey, 'notes', 0, 'missing' FROM customer""")
def q8_table_coverage(t):
    return quality.table_coverage(t.read("customer").select(F.col("c_custkey").alias("company")), {"orders": t.read("orders").withColumnRenamed("o_custkey", "company"), "notes": None}, "company")


@add("SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM lineitem) AS right_rows, (SELECT count(*) FROM orders) = (SELECT count(*) FROM lineitem) AS equal, 'o_extra' AS only_left, '' AS only_right, 'flag' AS other_nulls")
def q9_same_tables(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("o_extra"), F.col("o_orderstatus").alias("flag"))
    return quality.same_tables(o, t.read("lineitem").select(F.col("l_orderkey").alias("k"), F.nullif("l_returnflag", F.lit("N")).alias("flag")))


@add("SELECT company, fy, fq, item, left_value, right_value FROM (SELECT company, fy, fq, unnest(['sale', 'cogs']) AS item, unnest([sale, cogs]) AS left_value, unnest([CASE WHEN company % 5 = 0 THEN sale + 1 ELSE sale END, CASE WHEN company % 11 = 0 THEN NULL ELSE cogs END]) AS right_value FROM wd) WHERE abs(left_value - right_value) > 0.1 OR (left_value IS NULL) <> (right_value IS NULL)", "left_value right_value", _WIDE, places=2)
def q5_wide_diff(t):
    a = _wide(t).select("company", "fy", "fq", "sale", "cogs")
    b = a.withColumns({"sale": F.when(F.col("company") % 5 == 0, F.col("sale") + 1).otherwise(F.col("sale")), "cogs": F.when(F.col("company") % 11 != 0, F.col("cogs"))})
    return quality.wide_diff(a, b, ["company", "fy", "fq"], ["sale", "cogs"])


@add("SELECT o_custkey AS key, count(*) AS n, avg(o_totalprice) AS mean FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_custkey ORDER BY n DESC, key LIMIT 100", "mean", places=2)
def q10_top_summary(t):
    rows = t.read("orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    return rows.orderBy(F.desc("n"), "key").limit(100)


_INDEX = """
ix AS (SELECT ltrim(CAST(o_custkey AS VARCHAR), '0') AS cik, CAST(o_custkey AS VARCHAR) AS k, 'Customer ' || o_custkey AS company, CASE WHEN o_orderkey % 2 = 0 THEN '10-Q' ELSE '10-K' END AS form, CAST(o_orderdate AS DATE) AS filed,
       lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || strftime(CAST(o_orderdate AS DATE), '%y') || '-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS accession FROM orders)
"""


def _index_lines(t: Tables) -> DataFrame:
    """Lines of an index file: three kinds of heading, two forms of date."""
    d = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    form = F.when(F.col("o_orderkey") % 2 == 0, "10-Q").otherwise("10-K")
    number = F.concat_ws("-", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.date_format("o_orderdate", "yy"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    rows = t.read("orders").select(F.concat_ws("|", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.concat(F.lit("Customer "), "o_custkey"), form, d, F.concat(F.lit("data/"), "o_custkey", F.lit("/"), number, F.lit(".txt"))).alias("value"))
    heads = t.spark.createDataFrame([("Master Index",), ("CIK|Company Name|Form Type|Date Filed|Filename",), ("-" * 40,)], "value string")
    return heads.union(rows)


@add("SELECT cik, company, form, filed, 'data/' || k || '/' || accession || '.txt' AS path, accession FROM ix WHERE form = '10-Q'", "", _INDEX)
def a4_index_lines(t):
    return sources.index_lines(_index_lines(t), ["10-Q"])


@add("""SELECT cik, company, form, filed, 'data/' || k || '/' || accession || '.txt' AS path, accession, 'filings/' || year(filed) || '/Q' || quarter(filed) || '/' || cik || '/' || form || '_' || accession || '.txt' AS local
  FROM ix WHERE filed BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND cik IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')""", "", _INDEX)
def a17_filing_manifest(t):
    targets = t.read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("cik"))
    return sources.manifest(sources.index_lines(_index_lines(t), None, "1996-01-01", "1997-12-31"), targets, "filings")


@add("""SELECT file, month, f1, CASE WHEN month(month) = 3 THEN NULL ELSE f2 END AS f2 FROM (SELECT o_orderpriority AS file, last_day(CAST(o_orderdate AS DATE)) AS month, round(avg(o_totalprice) / 1e5, 4) / 100 AS f1, round(max(o_totalprice) / 1e5, 4) / 100 AS f2 FROM orders GROUP BY ALL)""", "f1 f2")
def a5_factor_section(t):
    """Files with a heading, the monthly rows, annual rows and another section of monthly rows, of which only the first is wanted."""
    m = t.read("orders").groupBy(F.col("o_orderpriority").alias("file"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice") / 1e5, 4).alias("a"), F.round(F.max("o_totalprice") / 1e5, 4).alias("b"))
    line = F.concat_ws(", ", F.date_format("m", "yyyyMM"), F.col("a").cast("string"), F.when(F.month("m") == 3, "-99.99").otherwise(F.col("b").cast("string")))
    body = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    text = F.concat(F.lit("Made of orders\n\n,f1,f2\n"), body, F.lit("\n\nAnnual\n,f1,f2\n1996, 1.0, 2.0\n\nEqual weighted\n,f1,f2\n"), body)
    return sources.factor_section(m.groupBy("file").agg(text.alias("value")), ["f1", "f2"])


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@add("SELECT CAST(c_custkey AS VARCHAR) AS key, upper(c_name) AS ticker FROM customer")
def a3_mapping_csv(t):
    """Written with headings of another spelling, and read back."""
    path = _folder(t, "mapping")
    t.read("customer").select(F.col("c_custkey").alias("gkey"), F.col("c_name").alias("Symbol"), "c_acctbal").write.option("header", True).csv(path)
    return sources.mapping_csv(t.spark, path)


@add("SELECT sec, month, CASE WHEN year(month) = 1997 THEN price * 2 ELSE price END AS price FROM monthly", "price")
def a8_rewritten_dates(t):
    """A panel by month whose months of 1997 are written again, with other prices; all others stay."""
    path, rows = _folder(t, "panel"), prices.monthly_prices(t.daily()).select("sec", "month", "price")
    sources.write_dates(rows, path)
    sources.write_dates(rows.where("year(month) = 1997").withColumn("price", F.col("price") * 2), path)
    return t.spark.read.parquet(path).select("sec", "month", "price")


@add("SELECT sec, price FROM monthly WHERE month = (SELECT max(month) FROM monthly WHERE month < (SELECT max(month) FROM monthly))", "price")
def a10_latest_release(t):
    """Two releases, the earlier one twice, and a later one that broke off before its manifest: the latest whole one is read."""
    root = _folder(t, "release")
    rows = t.keep("monthly", lambda: prices.monthly_prices(t.daily()).select("sec", "month", "price"))
    earlier, before, last = sorted(r.month for r in rows.select("month").distinct().orderBy(F.desc("month")).limit(3).collect())
    for month in (earlier, before, before):
        own = rows.where(F.col("month") == F.lit(month))
        sources.release(t.spark, {"prices": own.select("sec", "price"), "market": own.agg(F.avg("price").alias("mean"))}, root, str(month))
    sources.export(rows.where(F.col("month") == F.lit(last)), f"{root}/{last}", "prices", ("parquet",))
    return sources.read_release(t.spark, root, "prices")


@add("SELECT CAST(year(q) AS INTEGER) AS year, CAST(quarter(q) AS INTEGER) AS quarter FROM (SELECT CAST(unnest(generate_series(date_trunc('quarter', min(d)), max(d), INTERVAL 3 MONTH)) AS DATE) AS q FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders))")
def a19_quarters(t):
    first, last = t.read("orders").select(F.min(F.col("o_orderdate").cast("date")), F.max(F.col("o_orderdate").cast("date"))).first()
    return sources.quarters_between(t.spark, str(first), str(last))


@add("SELECT max(month) AS month FROM (SELECT month FROM monthly INTERSECT SELECT last_day(CAST(o_orderdate AS DATE)) FROM orders)")
def a14_latest_release(t):
    return sources.latest_release(prices.monthly_prices(t.daily()), t.read("orders").select(F.last_day(F.col("o_orderdate").cast("date")).alias("month")))


@add("SELECT unnest(['orders', 'customer']) AS \"table\", unnest([(SELECT count(*) FROM orders), (SELECT count(*) FROM customer)]) AS rows, unnest([6, 5]) AS columns")
def a15_table_summary(t):
    return sources.table_summary({"orders": t.read("orders"), "customer": t.read("customer")})


@add("SELECT DISTINCT s_name AS s_name FROM supplier UNION SELECT 'SPY'")
def a16_universe(t):
    return sources.universe(t.read("supplier"), "s_name", ["SPY"])


@add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def a18_without_keys(t):
    keys = t.read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return sources.without_keys(t.read("orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@add("SELECT company, fy, fq, item, CASE WHEN value IS NOT NULL THEN value END AS value FROM qf", "value", _QUARTER, places=2)
def e6_lag_in_fiscal_year(t):
    rows = t.facts().withColumn("sec", F.struct("company", "item"))
    return fundamentals.quarter_from_ytd(rows.withColumn("fq", F.col("fq")), "value", "v").select("company", "fy", "fq", "item", F.coalesce("v", "value").alias("value"))
