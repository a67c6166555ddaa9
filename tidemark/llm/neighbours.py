"""Approximate nearest neighbours by largest inner product: vantage-point trees, one for each shard of the vectors.

An inner product is a distance in disguise: with every vector lengthened by sqrt(M^2 - |v|^2), M the largest norm of all,
and every query by zero, the largest product is the smallest Euclidean distance.  Each shard builds a vantage-point tree
over that metric and a block of queries walks it together; a subtree is left out if the triangle inequality, relaxed by
``factor``, says that it holds nothing nearer than the k-th best so far.  Factor one is exact; smaller factors prune more.

A shard's rows are sorted before the queries that visit it: a task builds the shard's tree once and lets the queries stream
past it batch by batch, so it never holds more than one shard and one batch.

Distances only decide what is looked at; the k nearest are chosen by the inner products themselves, ties by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settled

K = 20
#: Share of the triangle inequality's bound that a subtree must exceed to be left out.
FACTOR = 0.6
SHARD_ROWS = 8192
LEAF = 256


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components and not all zero."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


class VantageTree:
    """Nodes are (vantage row, radius, inside, outside) or an array of rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, square: float, leaf: int = LEAF):
        """``square`` is the largest squared norm of all shards."""
        self.vectors, self.ids, self.leaf, self.largest = vectors, ids, leaf, square
        self.points = points = np.c_[vectors, np.sqrt(np.maximum(square - (vectors * vectors).sum(axis=1), 0))]
        self.square = (points * points).sum(axis=1)
        self.root = self._build(np.arange(len(points)))

    def distances(self, queries: np.ndarray, rows) -> np.ndarray:
        d = (queries * queries).sum(axis=1)[:, None] + self.square[rows][None, :] - 2 * queries @ self.points[rows].T
        return np.sqrt(np.maximum(d, 0))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = rows[:1]
        rest = rows[1:]
        d = self.distances(self.points[vantage], rest)[0]
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():  # nothing but equal distances: no split helps
            return rows
        return vantage, radius, self._build(rest[inside]), self._build(rest[~inside])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows of each query but the one whose id is ``own``: scores and rows, -1 where there are fewer."""
        self._score = np.full((len(queries), k), -np.inf)
        self._far = np.full(len(queries), np.inf)  # distance of the k-th nearest so far
        self._row = np.full((len(queries), k), -1, np.int64)
        self._queries, self._own, self._k, self._factor = queries, own, k, factor
        self._reach = np.sqrt((queries * queries).sum(axis=1) + self.largest)  # distance to a vector at right angles
        self._lifted = np.c_[queries, np.zeros(len(queries))]
        self._visit(self.root, np.arange(len(queries)))
        return self._score, self._row

    def _offer(self, q: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        """Rows at the distances ``d``: those that may be among the k nearest are compared by product and id."""
        slack = 1e-7 * (1 + self._reach[q])
        old = self._row[q]
        limit = np.where(old[:, -1] >= 0, self._far[q], np.inf)
        if len(rows) > self._k + 1:  # one of them may be the query itself
            limit = np.minimum(limit, np.partition(d, self._k, axis=1)[:, self._k])
        at, col = np.nonzero((d <= (limit + slack)[:, None]) & (self.ids[rows][None, :] != self._own[q][:, None]))
        if not len(at):
            return
        hit = rows[col]
        score = np.concatenate([np.einsum("ij,ij->i", self._queries[q[at[i : i + 65536]]], self.vectors[hit[i : i + 65536]]) for i in range(0, len(at), 65536)])
        known, slot = np.nonzero(old >= 0)
        at, hit, score = np.r_[known, at], np.r_[old[known, slot], hit], np.r_[self._score[q][known, slot], score]
        order = np.lexsort((self.ids[hit], -score, at))
        at, hit, score = at[order], hit[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self._k
        at, hit, score, place = at[keep], hit[keep], score[keep], place[keep]
        self._row[q[at], place], self._score[q[at], place] = hit, score
        full = at[place == self._k - 1]
        self._far[q[full]] = np.sqrt(np.maximum(self._reach[q[full]] ** 2 - 2 * self._score[q[full], -1], 0))

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._offer(q, node, self.distances(self._lifted[q], node))
            return
        vantage, radius, inside, outside = node
        d = self.distances(self._lifted[q], vantage)
        self._offer(q, vantage, d)
        gap = d[:, 0] - radius  # how far a query lies outside the ball
        near = gap <= 0
        self._visit(inside, q[near])
        self._visit(outside, q[~near])
        # whatever lies beyond the ball's surface is at least |gap| away
        open_ = np.abs(gap) <= self._far[q] * self._factor + 1e-7 * (1 + self._reach[q])
        self._visit(outside, q[near & open_])
        self._visit(inside, q[~near & open_])


def search(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product with each row of ``queries`` (its own id left out).

    Returns query_id, rank (from 1), vec_id and score, ties going to the smaller id.  Vectors that are null, zero, hold null
    or non-finite components, or have a null id take no part; a query meets the vectors of its own length.  Rows
    that share an id count once each.  Other columns are ignored; an empty side gives an empty result.
    """
    pick = lambda df: df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    base, asked = pick(vectors), pick(queries)
    base, asked = base.withColumn("size", F.size("v")), asked.withColumn("size", F.size("v"))
    stored = base.groupBy("size").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"))
    facts = F.broadcast(settled(stored, "lengths"))  # one row per length

    def walk(batches):
        """Rows sorted by length, shard and kind: a shard's vectors, then the queries that visit it."""
        key, held, tree = None, [], None
        for pdf in batches:
            for (size, shard, asks), part in pdf.groupby(["size", "shard", "asks"], sort=True):
                if (size, shard) != key:
                    key, held, tree = (size, shard), [], None
                if not asks:
                    held.append(part)
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    left = pd.concat(held).sort_values("id")
                    tree, held = VantageTree(np.stack(left["v"].to_numpy()), left["id"].to_numpy(), left["square"].iloc[0]), []
                q, own = np.stack(part["v"].to_numpy()), part["id"].to_numpy()
                score, row = tree.search(q, own, k, factor)
                at, slot = np.nonzero(row >= 0)
                yield pd.DataFrame({"query_id": own[at], "vec_id": tree.ids[row[at, slot]], "score": score[at, slot]})

    shard = F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")
    left = base.join(facts, "size").select("size", shard.alias("shard"), F.lit(False).alias("asks"), "id", "v", "square")
    right = asked.join(facts, "size").select("size", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("asks"), "id", "v", "square")
    met = left.unionByName(right).repartition("size", "shard").sortWithinPartitions("size", "shard", "asks", "id")
    found = met.mapInPandas(walk, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = K) -> float:
    """Share of the exact k nearest that ``found`` has; ``queries`` should be a small set."""
    truth = settled(search(vectors, queries, k, factor=1.0), "truth")
    hits = truth.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, truth.count())
