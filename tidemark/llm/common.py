"""Helpers shared by the corpus operators: settled tables in the shared folder, batch sizes and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import discard, reachable, settled, shared_folder

#: Rows a Python worker gets at once.  Documents can be long, so the session's default of 10,000 rows is too many.
BATCH_ROWS = 512


def session(spark: SparkSession) -> SparkSession:
    """Settings of the corpus queries: small Arrow batches, since texts have no bounded length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return reachable(spark)


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


_held: dict = {}


def held(key, make: Callable):
    """What a worker process keeps from one task to the next, one thing at a time: asking for another forgets it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Frees what earlier tasks have left in this worker process, and gives unused memory back to the machine."""
    _held.clear()
    trim()


def trim() -> None:
    """Returns freed memory: the allocators would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def tidy(spark: SparkSession) -> None:
    """Lets go of what finished jobs have left on the driver: broadcasts, shuffle records and compiled plans go with their last reference,
    which a driver that has little to do of its own would find late."""
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given by its edges.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
    every step is an aggregated minimum and a join, so a vertex with very many neighbours is never gathered in one
    place.  Rounds grow with the logarithm of the graph's size.  Nulls and self loops are ignored.

    Returns ``node`` and ``component`` (the smallest node reachable) for every node of a real edge.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    pairs = settled(pairs, "edges")
    known = _signature(pairs)
    while True:
        both = pairs.union(pairs.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = settled(large, "edges")  # read twice: one small plan each instead of one that holds it twice
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        after = settled(small.union(lowest).distinct(), "edges")
        before, known = known, _signature(after)
        discard(pairs, large)
        if known == before:
            return after.toDF("node", "component").union(after.select("lo", "lo").distinct())
        pairs = after


def _signature(pairs: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())
