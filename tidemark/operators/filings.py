"""Facts from filing texts with column expressions: one pass over ``filings(id, content)``, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import number_from_text, parse_date

#: Header labels and the fields they give: fixed values of the filing format.
HEADER = {"cik": r"CENTRAL INDEX KEY:\s*(\d+)", "name": r"COMPANY CONFORMED NAME:\s*([^\n]+)", "filed": r"FILED AS OF DATE:\s*(\d{8})", "form": r"CONFORMED SUBMISSION TYPE:\s*(\S+)"}
#: Tags whose value for one quarter is wanted, rather than a stock.
PERIOD_TAGS = ("revenue", "income", "expense", "cash", "cost", "earnings")


def _get(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def header(filings: DataFrame) -> DataFrame:
    """CIK without leading zeros, name, filing date and form of each filing."""
    c = F.col("content")
    return filings.select("id", F.ltrim(_get(c, HEADER["cik"]), F.lit("0")).alias("cik"), _get(c, HEADER["name"]).alias("name"), parse_date(_get(c, HEADER["filed"]), "yyyyMMdd").alias("filed"), _get(c, HEADER["form"]).alias("form"))


def identifiers(filings: DataFrame) -> DataFrame:
    """Ticker, tax id, phone, zip, fiscal-year end month and industry code, each by its first fitting pattern."""
    c = F.col("content")
    return filings.select(
        "id", F.coalesce(_get(c, r'(?i)TradingSymbol"[^>]*>\s*([A-Za-z.]{1,6})\s*<'), _get(c, r"(?i)trading symbol[:\s]+([A-Z.]{1,6})\b")).alias("ticker"),
        F.coalesce(_get(c, r"IRS NUMBER:\s*(\d{9})"), F.regexp_replace(_get(c, r"\b(\d{2}-\d{7})\b"), "-", "")).alias("ein"),
        _get(c, r"BUSINESS PHONE:\s*([^\n]+)").alias("phone"), _get(c, r"ZIP:\s*(\d{5})").alias("zip"),
        _get(c, r"FISCAL YEAR END:\s*(\d{2})\d{2}").try_cast("int").alias("year_end_month"), _get(c, r"STANDARD INDUSTRIAL CLASSIFICATION:[^\[\n]*\[(\d{4})\]").alias("sic"),
    )


def period_kind(days: Column) -> Column:
    """Kind of a period by its length in days."""
    return F.when(days.isNull(), "INSTANT").when(days <= 100, "QTD").when(days <= 200, "YTD_H1").when(days <= 290, "YTD_9M").otherwise("YTD_ANNUAL")


def contexts(filings: DataFrame) -> DataFrame:
    """``(id, context, start, end, kind)`` of every period context."""
    block = F.explode(F.regexp_extract_all("content", F.lit(r"(?is)(<(?:xbrli:)?context\b.*?</(?:xbrli:)?context>)"), 1)).alias("b")
    rows = filings.select("id", block)
    day = lambda tag: _get(F.col("b"), rf"(?is)<(?:xbrli:)?{tag}>\s*(\d{{4}}-\d{{2}}-\d{{2}})").try_cast("date")
    rows = rows.select("id", _get(F.col("b"), r'(?i)\bid="([^"]+)"').alias("context"), day("startDate").alias("start"), F.coalesce(day("endDate"), day("instant")).alias("end"))
    return rows.withColumn("kind", period_kind(F.datediff("end", "start")))


def facts(filings: DataFrame) -> DataFrame:
    """``(id, tag, context, value)`` of every inline fact; attributes may stand in any order.

    A scale of s makes the value millions times 10^(s - 6); without one the number stands as it is.
    """
    tag = F.explode(F.regexp_extract_all("content", F.lit(r"(?is)(<ix:nonFraction\b[^>]*>.*?</ix:nonFraction>)"), 1)).alias("t")
    rows = filings.select("id", tag)
    attr = lambda name: _get(F.col("t"), rf'(?i)\b{name}="([^"]*)"')
    text = F.regexp_replace(F.col("t"), r"(?s)<[^>]*>", "")
    value = number_from_text(text) * F.when(attr("sign") == "-", -1).otherwise(1)
    scale = attr("scale").try_cast("int")
    # a power of ten below one is not exact in binary, a division by its inverse is
    value = F.when(scale >= 6, value * F.pow(F.lit(10.0), scale - 6)).when(scale.isNotNull(), value / F.pow(F.lit(10.0), 6 - scale)).otherwise(value)
    return rows.select("id", F.regexp_replace(attr("name"), "^[^:]*:", "").alias("tag"), attr("contextRef").alias("context"), value.alias("value")).where("value is not null")


def choose(rows: DataFrame) -> DataFrame:
    """One value per filing and tag from ``(id, tag, kind, value)``: flows prefer a quarter's value, then the larger amount."""
    flow = F.lower("tag").rlike("|".join(PERIOD_TAGS))
    rank = F.when(~flow, 0).when(F.col("kind") == "QTD", 0).when(F.col("kind") == "INSTANT", 1).when(F.coalesce("kind", F.lit("UNKNOWN")) == "UNKNOWN", 2).otherwise(3)
    w = Window.partitionBy("id", "tag").orderBy(rank, F.desc(F.abs("value")), F.desc("value"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def tables(filings: DataFrame) -> DataFrame:
    """``(id, row, label, value)`` of table rows: the first cell and the first number after it."""
    row = F.posexplode(F.regexp_extract_all("content", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("row", "html")
    rows = filings.select("id", row)
    cells = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>|&nbsp;", "")))
    rows = rows.withColumn("cells", cells).where(F.size("cells") > 1)
    numbers = F.filter(F.transform(F.slice("cells", 2, F.size("cells")), number_from_text), lambda v: v.isNotNull())
    return rows.select("id", "row", F.col("cells")[0].alias("label"), F.get(numbers, F.lit(0)).alias("value"))


def text_values(filings: DataFrame, labels: dict[str, str]) -> DataFrame:
    """First number after each label in plain text; ``labels`` maps item names to patterns."""
    number = r"[^\n\d(]{0,40}(\(?\$?[\d,]+(?:\.\d+)?\)?)"
    return filings.select("id", *(number_from_text(_get(F.col("content"), f"(?i){p}{number}")).alias(k) for k, p in labels.items()))


def links(filings: DataFrame) -> DataFrame:
    """Number of links, headings and paragraphs and the title of a page."""
    count = lambda p: F.regexp_count("content", F.lit(p)).cast("long")
    return filings.select("id", count(r"<a\s").alias("links"), count(r"<p[ >]").alias("paragraphs"), F.length("content").cast("long").alias("chars"), _get(F.col("content"), r"<title>([^<]*)</title>").alias("title"))


def choose_by_context(rows: DataFrame) -> DataFrame:
    """One value per filing and element by the name of its context: a quarter, any other name, year to date, none; ties go
    to the first context and the larger amount.  ``rows(id, tag, context, value)``."""
    name = F.lower("context")
    rank = F.when(name.isNull() | (name == ""), 3).when(name.rlike("qtr|quarter|q[1-4]"), 0).when(name.contains("ytd"), 2).otherwise(1)
    w = Window.partitionBy("id", "tag").orderBy(rank, "context", F.desc(F.abs("value")), F.desc("value"))
    return rows.where("value is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
