"""Column expressions used across the analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_index(d: Column) -> Column:
    """Months since year zero."""
    return F.year(d) * 12 + F.month(d) - 1


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number_from_text(text: Column) -> Column:
    """``1,234`` and ``$5`` to numbers, ``(x)`` to -x, dashes and anything else to null."""
    bare = F.regexp_replace(F.trim(text), r"[,$\s ]", "")
    negative = bare.rlike(r"^\(.*\)$")
    value = F.regexp_replace(bare, r"[()]", "").try_cast("double")
    return F.when(negative, -value).otherwise(value)


def parse_date(text: Column, *patterns: str) -> Column:
    """The first pattern that fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("date") for p in patterns))


def date_before(text: Column, filed: Column, pattern: str = "MMMM d") -> Column:
    """The last day on or before ``filed`` that a text without a year, such as ``September 30``, can mean (29 February: in a leap year)."""
    year = F.year(filed)
    day = lambda back: F.try_to_timestamp(F.concat_ws(" ", text, (year - back).cast("string")), F.lit(f"{pattern} yyyy")).cast("date")
    return F.coalesce(*(F.when(day(k) <= filed, day(k)) for k in range(9)))  # leap years are eight years apart at most


def formation_year(d: Column) -> Column:
    return F.year(F.add_months(d, -6))


def fiscal_quarter(month: Column, year_end_month: Column) -> Column:
    """1 to 4, counted from the month after the fiscal year's last."""
    return (F.floor(F.pmod(month - year_end_month - 1, F.lit(12)) / 3) + 1).cast("int")


def fiscal_year(year: Column, month: Column, year_end_month: Column) -> Column:
    """The calendar year in which the fiscal year ends."""
    return F.when(month > year_end_month, year + 1).otherwise(year)


def band(x: Column, low: Column, high: Column, labels=("Low", "Medium", "High")) -> Column:
    """Three bands, closed on the right."""
    return F.when(x <= low, labels[0]).when(x <= high, labels[1]).when(x.isNotNull(), labels[2])


def trailing(df_window, months: int):
    """The last ``months`` months of an ordered window over a month index."""
    return df_window.rangeBetween(-(months - 1), 0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls lowest); one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def preferred(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order of preference."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
