"""Data-quality checks and table comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import union_all


def check(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    """One row (check, passed, detail) from aggregates."""
    return df.agg(passed.alias("passed"), F.round(detail.cast("double"), 6).alias("detail")).select(F.lit(name).alias("check"), F.coalesce("passed", F.lit(False)).alias("passed"), "detail")


def model_checks(imputed: DataFrame, one_hot: DataFrame, specific: DataFrame, cov: DataFrame) -> DataFrame:
    """The release checks of the risk model, one row each."""
    style = imputed.groupBy("month", "factor").agg(F.avg("exposure").alias("m"), F.stddev_pop("exposure").alias("s"), F.count("*").alias("n"), F.countDistinct("sec").alias("u"))
    hot = one_hot.withColumn("level", F.split("factor", ":")[0]).groupBy("month", "sec", "level").agg(F.sum("exposure").alias("s"))
    flipped = cov.select("month", F.col("fj").alias("fi"), F.col("fi").alias("fj"), F.col("cov").alias("other"))
    sym = cov.join(flipped, ["month", "fi", "fj"], "left")
    square = cov.groupBy("month").agg(F.count("*").alias("n"), F.countDistinct("fi").alias("k"))
    share = F.count_if(F.col("flags").isNotNull()) / F.count("*")
    bad = lambda cond: F.count_if(cond)
    return union_all([
        check(imputed, "rows", F.count("*") > 0, F.count("*")), check(imputed, "no_nulls", bad(F.col("exposure").isNull()) == 0, bad(F.col("exposure").isNull())),
        check(imputed, "imputed_share", share <= 0.3, share), check(hot, "one_hot", bad(F.abs(F.col("s") - 1) > 1e-9) == 0, bad(F.abs(F.col("s") - 1) > 1e-9)),
        check(style, "means", F.max(F.abs("m")) <= 0.15, F.max(F.abs("m"))), check(style, "deviations", bad(~F.col("s").between(0.5, 1.5) & (F.col("s") > 0)) == 0, bad(~F.col("s").between(0.5, 1.5) & (F.col("s") > 0))),
        check(style, "unique", bad(F.col("n") != F.col("u")) == 0, bad(F.col("n") != F.col("u"))), check(specific, "residual_mean", F.abs(F.avg("residual")) <= 0.01, F.avg("residual")),
        check(specific, "variances", bad(F.col("specific_var") < 0) == 0, bad(F.col("specific_var") < 0)), check(square, "square", bad(F.col("n") != F.col("k") * F.col("k")) == 0, bad(F.col("n") != F.col("k") * F.col("k"))),
        check(sym, "symmetric", bad(F.col("other").isNull() | (F.abs(F.col("cov") - F.col("other")) > 1e-12)) == 0, bad(F.col("other").isNull())),
    ])


def accuracy(ours: DataFrame, reference: DataFrame, keys: list[str], percent: float = 0.01, absolute: float = 0.01) -> DataFrame:
    """Per item, and over all (item ``ALL``): matches within a tolerance (absolute below 1, a share above) and the largest difference."""
    both = ours.select(*keys, F.col("value").alias("a")).join(reference.select(*keys, F.col("value").alias("b")), keys)
    d = F.abs(F.col("a") - F.col("b"))
    ok = F.when(F.abs("b") < 1, d <= absolute).otherwise(d <= percent * F.abs("b"))
    both = both.withColumns({"d": d, "ok": ok})
    out = both.rollup("item").agg(F.grouping("item").alias("all"), F.count("*").alias("n"), F.count_if("ok").alias("matches"), F.max("d").alias("largest"), (F.count_if("ok") / F.count("*")).alias("accuracy"))
    return out.withColumn("item", F.when(F.col("all") == 1, "ALL").otherwise(F.col("item"))).drop("all").where("n > 0")


def discrepancies(ours: DataFrame, reference: DataFrame, keys: list[str], least: float = 1.0, top: int = 20) -> DataFrame:
    """The ``top`` largest relative differences whose amount is above ``least``."""
    both = ours.select(*keys, F.col("value").alias("a")).join(reference.select(*keys, F.col("value").alias("b")), keys)
    both = both.where(F.abs(F.col("a") - F.col("b")) > least).withColumn("percent", F.try_divide(F.abs(F.col("a") - F.col("b")), F.abs("b")) * 100)
    return both.orderBy(F.desc_nulls_last("percent"), *keys).limit(top)


def wide_diff(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.1) -> DataFrame:
    """Cells of two wide tables that differ by more than the tolerance, or that only one has."""
    long = lambda df, name: df.unpivot(keys, columns, "item", name)
    both = long(a, "left_value").join(long(b, "right_value"), [*keys, "item"], "full")
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    return both.where((gap > tolerance) | (F.col("left_value").isNull() != F.col("right_value").isNull()))


def population(df: DataFrame) -> DataFrame:
    """Non-null count and share of every column, in one pass."""
    names = df.columns
    row = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in names))
    return row.unpivot(["_n"], names, "column", "filled").select("column", "filled", (F.col("filled") / F.col("_n")).alias("share"))


def type_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column, left_type, right_type)`` of columns whose types differ or that only one table has."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    rows = [(c, left.get(c), right.get(c)) for c in sorted({*left, *right}) if left.get(c) != right.get(c)]
    return a.sparkSession.createDataFrame(rows, "column string, left_type string, right_type string")


def table_coverage(keys: DataFrame, tables: dict[str, DataFrame | None], key: str) -> DataFrame:
    """Whether each table has rows for each key: ``(key, table, rows, state)``; a table given as None is ``missing``."""
    parts, asked = [], keys.select(key).distinct()
    for name, df in tables.items():
        if df is None:
            parts.append(asked.select(key, F.lit(name).alias("table"), F.lit(0).cast("long").alias("rows"), F.lit("missing").alias("state")))
            continue
        n = asked.join(df.groupBy(key).agg(F.count("*").alias("rows")), key, "left")
        state = F.when(F.col("rows").isNull(), "empty").otherwise("populated")
        parts.append(n.select(key, F.lit(name).alias("table"), F.coalesce("rows", F.lit(0)).alias("rows"), state.alias("state")))
    return union_all(parts)


def same_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of two stores, columns that only one has, and common columns whose numbers of nulls differ."""
    only = lambda x, y: ",".join(sorted(set(x.columns) - set(y.columns)))
    common = sorted(set(a.columns) & set(b.columns))
    one = lambda df, side: df.agg(F.count("*").alias("n"), F.array(*(F.count_if(F.col(c).isNull()) for c in common)).cast("array<long>").alias("nulls")).withColumn("side", F.lit(side))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    n = one(a, "left").unionByName(one(b, "right")).agg(of("left", "n").alias("left_rows"), of("right", "n").alias("right_rows"), of("left", "nulls").alias("_l"), of("right", "nulls").alias("_r"))
    differ = F.concat_ws(",", *(F.when(F.col("_l")[i] != F.col("_r")[i], c) for i, c in enumerate(common)))
    n = n.withColumns({"equal": F.col("left_rows") == F.col("right_rows"), "only_left": F.lit(only(a, b)), "only_right": F.lit(only(b, a)), "other_nulls": differ})
    return n.drop("_l", "_r")


def compare_fields(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str], percent: float = 0.01) -> DataFrame:
    """Every field of every key that both have: ``(key, field, ours, theirs, status)``, equal within ``percent``."""
    other = theirs.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("ours"), F.col(f"_{c}").cast("double").alias("theirs")) for c in fields)))
    rows = ours.select(key, *fields).join(other, key).select(key, each)
    near = F.abs(F.col("ours") - F.col("theirs")) <= percent * F.abs("theirs")
    status = F.when(F.col("ours").isNull() & F.col("theirs").isNull(), "both_missing").when(F.col("ours").isNull(), "missing").when(F.col("theirs").isNull(), "extra").when(near, "match").otherwise("mismatch")
    return rows.withColumn("status", status)
