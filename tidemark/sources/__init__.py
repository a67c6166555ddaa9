"""Readers and writers of the analytics tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import parse_date, union_all


def as_of(spark: SparkSession, path: str, date, column: str = "month") -> DataFrame:
    """One date of a table partitioned by date; only that partition is read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(date).cast("date"))


def write_dates(df: DataFrame, path: str, column: str = "month") -> None:
    """Replaces the dates that ``df`` has and leaves all others: safe to run again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Appends the rows of one batch; a batch that is written again takes the place of what it wrote before."""
    write_dates(df.withColumn("batch", F.lit(batch)), path, "batch")


def write_table(df: DataFrame, path: str, mode: str = "replace") -> None:
    """``replace`` a table, or ``append`` to it (a run that may repeat itself uses ``append_batch``)."""
    df.write.mode({"replace": "overwrite", "append": "append"}[mode]).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table_info(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(table, present, rows, place, column, type)``: a row for each column of each Parquet table, one for a table that is not there."""
    parts = []
    for name, path in paths.items():
        if not exists(spark, path):
            parts.append(spark.range(1).select(F.lit(name).alias("table"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("rows"), *(F.lit(None).cast(k).alias(c) for c, k in (("place", "int"), ("column", "string"), ("type", "string")))))
            continue
        df = spark.read.parquet(path)
        fields = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("type")) for c, k in df.dtypes))
        rows = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit(True).alias("present"), "rows", F.posexplode(fields))
        parts.append(rows.select("table", "present", "rows", F.col("pos").alias("place"), "col.column", "col.type"))
    return union_all(parts)


def mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(key, ticker)`` from a CSV file whose header may name the columns GVKEY or GKEY, TICKER or SYMBOL."""
    df = spark.read.csv(path, header=True)
    find = lambda *names: next(c for n in names for c in df.columns if c.strip().upper() == n)
    return df.select(F.trim(F.col(find("GVKEY", "GKEY"))).alias("key"), F.upper(F.trim(F.col(find("TICKER", "SYMBOL")))).alias("ticker"))


def index_lines(lines: DataFrame, forms: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Index rows of ``lines(value)``: five fields between bars; heading lines have none that parse."""
    p = F.split("value", r"\|")
    rows = lines.where(F.size(p) == 5).select(F.ltrim(F.trim(p[0]), F.lit("0")).alias("cik"), F.trim(p[1]).alias("company"), F.trim(p[2]).alias("form"), parse_date(F.trim(p[3]), "yyyy-MM-dd", "yyyyMMdd").alias("filed"), F.trim(p[4]).alias("path"))
    rows = rows.where("filed is not null")
    if forms:
        rows = rows.where(F.col("form").isin(forms))
    if start:
        rows = rows.where(F.col("filed").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.withColumn("accession", F.regexp_extract("path", r"(\d{10}-\d{2}-\d{6})", 1))


#: Codes of a missing number in the sectioned files.
MISSING = (-99.99, -999.0)


def factor_section(texts: DataFrame, names: list[str]) -> DataFrame:
    """The monthly section of sectioned CSV files ``texts(file, value)``, each a whole text: (file, month, *names).

    The section begins with the first line of YYYYMM and numbers and ends before the next line that is none, so annual rows
    and later sections stay out.  Percent become fractions; ``MISSING`` codes and what is no number are null.
    """
    rows = texts.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    rows = rows.withColumn("monthly", F.col("value").rlike(r"^\s*\d{6}\s*,"))
    own = Window.partitionBy("file")
    rows = rows.withColumn("first", F.min(F.when(F.col("monthly"), F.col("at"))).over(own))
    rows = rows.withColumn("end", F.min(F.when(~F.col("monthly") & (F.col("at") > F.col("first")), F.col("at"))).over(own))
    rows = rows.where(F.col("monthly") & (F.col("end").isNull() | (F.col("at") < F.col("end"))))
    p = F.split("value", ",")
    x = lambda i: F.trim(F.get(p, F.lit(i))).try_cast("double")
    value = lambda i: F.when(~x(i).isin(*MISSING), x(i) / 100)
    return rows.select("file", F.last_day(F.to_date(F.trim(p[0]), "yyyyMM")).alias("month"), *(value(i + 1).alias(n) for i, n in enumerate(names)))


def factor_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``factor_section`` of every file of a folder."""
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return factor_section(rows, names)


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, form, content)`` of files named FORM_accession.txt anywhere below a folder."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.select(F.regexp_extract(name, r"_(.+)\.txt$", 1).alias("id"), F.regexp_extract(name, r"^([^_]+)_", 1).alias("form"), F.col("value").alias("content"))


def manifest(index: DataFrame, companies: DataFrame, root: str) -> DataFrame:
    """Index rows of the target companies with the local path of each filing."""
    rows = index.join(companies.select("cik"), "cik", "left_semi")
    q = F.concat(F.lit("Q"), F.quarter("filed"))
    return rows.withColumn("local", F.concat_ws("/", F.lit(root), F.year("filed"), q, "cik", F.concat(F.col("form"), F.lit("_"), F.col("accession"), F.lit(".txt"))))


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def quarters_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "quarter"), F.lit(end).cast("date"), F.expr("interval 3 months"))).alias("d"))
    return rows.select(F.year("d").alias("year"), F.quarter("d").alias("quarter"))


def latest_release(*tables: DataFrame, column: str = "month") -> DataFrame:
    """The newest date that every table has."""
    dates = tables[0].select(column).distinct()
    for t in tables[1:]:
        dates = dates.intersect(t.select(column).distinct())
    return dates.agg(F.max(column).alias(column))


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    return union_all([df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")) for n, df in tables.items()])


def export(df: DataFrame, folder: str, name: str, formats=("csv", "parquet")) -> None:
    """Writes a table as CSV with a header, JSON lines or Parquet."""
    for f in formats:
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(f"{folder}/{name}.csv") if f == "csv" else writer.format(f).save(f"{folder}/{name}.{f}")


def release(spark: SparkSession, tables: dict[str, DataFrame], root: str, date: str, formats=("csv",)) -> None:
    """Writes the tables of one date and, last of all, their manifest.

    Each table is worked out once, into Parquet, and copied from there into the other formats.  A run that breaks off leaves no
    manifest, so the release before it stays the latest; a run that is repeated takes the place of its date.
    """
    found = []
    for name, df in tables.items():
        export(df, f"{root}/{date}", name, ("parquet",))
        kept = spark.read.parquet(f"{root}/{date}/{name}.parquet")
        export(kept, f"{root}/{date}", name, formats)
        found.append((date, name, kept.count(), json.dumps(kept.dtypes)))
    manifest = spark.createDataFrame(found, "date string, table string, rows long, columns string").coalesce(1)
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(f"{root}/manifest")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """``(date, table, rows, columns)`` of every whole release."""
    return spark.read.schema("table string, rows long, columns string, date string").json(f"{root}/manifest")


def read_release(spark: SparkSession, root: str, table: str, date: str | None = None) -> DataFrame:
    """A table of the latest whole release, or of that of one date, as the manifest has it."""
    known = manifests(spark, root).where(F.col("table") == table)
    known = known.where(F.col("date") == date) if date else known
    latest = known.agg(F.max("date")).first()[0]
    if latest is None:
        raise ValueError(f"no release of {table}" + (f" for {date}" if date else ""))
    return spark.read.parquet(f"{root}/{latest}/{table}.parquet")


def universe(prices: DataFrame, column: str, forced: list[str]) -> DataFrame:
    extra = prices.sparkSession.createDataFrame([(x,) for x in forced], f"{column} string")
    return prices.select(F.col(column).cast("string")).union(extra).distinct()


def to_database(df: DataFrame, url: str, table: str, batch: int = 10_000, **options) -> None:
    """Truncate and load through JDBC."""
    df.write.format("jdbc").mode("overwrite").option("truncate", True).option("batchsize", batch).options(url=url, dbtable=table, **options).save()
