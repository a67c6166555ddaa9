"""Registering queries beside the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.standins import SQL, Tables


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, floats: str = "", ctes: str = "", places: int = 6):
        """Registers ``f(tables)`` with its SQL over the stand-in tables and more common table expressions.

        Double columns (``floats`` in the SQL) are rounded on both sides, since sums differ in order.
        """

        def register(f):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return rounded(f(Tables(spark, sf_dir)), places)

            query.__name__, query.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = query
            if sql is not None:
                fix = ", ".join(f"floor({c} * 1e{places} + 0.5) / 1e{places} AS {c}" for c in floats.split())
                head = SQL.strip() + (",\n" + ctes.strip().rstrip(",") if ctes else "")
                self.sql[f.__name__] = f"WITH {head}\nSELECT *{f' REPLACE ({fix})' if fix else ''} FROM ({sql.strip()})"
            return f

        return register


def rounded(df: DataFrame, places: int) -> DataFrame:
    """Doubles rounded by the same arithmetic as in the SQL (huge values and NaN stay as they are)."""
    unit = 10.0**places
    fix = {c: F.when(F.abs(c) < 9e18 / unit, F.floor(F.col(c) * unit + 0.5) / unit).otherwise(F.col(c)) for c, kind in df.dtypes if kind == "double"}
    return df.withColumns(fix) if fix else df
