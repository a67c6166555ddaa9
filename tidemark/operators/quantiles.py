"""Exact quantiles of groups of any size.

A built-in exact percentile keeps a group's distinct values in one place.  Here that is left to groups of up to ``LARGE`` rows; in
larger ones the wanted ranks are found by counting: the range of values is cut into bins, a grouped count says which bin holds
a rank, and only that bin's range is cut again, until its values are equal or few enough to be put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import settled

LARGE = 1_000_000
BINS = 4096


def meet(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", condition=None) -> DataFrame:
    """Join on ``by`` where null equals null; the right side's own key columns go."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    on = condition if condition is not None else F.lit(True)
    for c in by:
        on = on & left[c].eqNullSafe(right[f"_r_{c}"])
    return left.join(right, on, how).drop(*(f"_r_{c}" for c in by))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, probabilities: list[float], large: int | None = None, bins: int = BINS) -> DataFrame:
    """``by`` and ``q``, an array of the quantiles, interpolated between neighbouring values.

    Nulls in ``value`` are left out, a group without any value has no row; null keys are a group; equal values count each.
    Results do not depend on ``large``, only memory does: no task holds more than about so many rows of a group.
    """
    large = LARGE if large is None else large
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    built_in = F.percentile("_v", F.array(*(F.lit(float(p)) for p in probabilities))).alias("q")
    sizes = settled(v.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    big = sizes.where(F.col("_n") > large)
    if big.isEmpty():
        return v.groupBy(*by).agg(built_in)
    small = meet(v, big.select(*by), by, "left_anti").groupBy(*by).agg(built_in)
    v = settled(meet(v, big.select(*by), by, "left_semi"), "values")

    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in place))))
    state = big.select(*by, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_n", ranks.alias("_ranks"))
    found = []
    own = [*by, "_lo"]
    while True:
        state = settled(state, "ranges")
        inside = lambda part: meet(v, part, by, "inner", (v["_v"] >= part["_lo"]) & (v["_v"] <= part["_hi"]))
        found.append(state.where("_lo = _hi").select(*by, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_x")))
        few = inside(state.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") <= large)))
        few = few.withColumn("_rank", F.col("_below") + F.row_number().over(Window.partitionBy(*own).orderBy("_v")) - 1)
        found.append(few.where(F.array_contains("_ranks", F.col("_rank"))).select(*by, "_rank", F.col("_v").alias("_x")))
        wide = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > large))
        if wide.isEmpty():
            break
        bin_ = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        cut = inside(wide).withColumn("_bin", bin_).groupBy(*own, "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("_below").alias("_below"), F.first("_ranks").alias("_ranks"))
        before = F.sum("_n").over(Window.partitionBy(*own).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        cut = cut.withColumn("_below", F.col("_below") + F.coalesce(before, F.lit(0)))
        cut = cut.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_n"))))
        state = cut.where(F.size("_ranks") > 0).select(*by, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_below", "_n", "_ranks")

    known = found[0]
    for part in found[1:]:
        known = known.union(part)
    known = known.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))  # two ranks a quantile
    at = lambda r: F.col("_at")[r]
    q = F.array(*(F.when(F.floor(p) == F.ceil(p), at(F.floor(p))).otherwise((F.ceil(p) - p) * at(F.floor(p)) + (p - F.floor(p)) * at(F.ceil(p))) for p in place))
    return small.unionByName(meet(big.select(*by, "_n"), known, by).select(*by, q.alias("q")))
