"""Embedding near-duplicates: exact cosine-threshold links by dual traversal of cover trees.

On unit vectors cosine >= t is Euclidean distance <= sqrt(2 - 2t).  The top of the tree is built in Spark: every label's
vectors go to the nearest of a bounded number of pivots, whose cells have measured covering radii; a vector meets another
cell only if that cell's ball, widened by the threshold, reaches it.  Cells are cut into blocks of bounded size.  Below
that, a task builds the cover tree of a block (nested centres, halving radii) and walks pairs of trees from the top:
a pair of nodes is dropped if their balls are too far apart, taken whole if no two members can be too far apart, and
opened otherwise; only what is left at the bottom is compared vector by vector.

A task returns no pairs: for each vector the number of its links and the smallest id it is connected to there.  So a
group of thousands of near copies costs a row for each vector and block it meets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, settled
from tidemark.llm.neighbours import usable

THRESHOLD = 0.93
BLOCK_ROWS = 2048
MAX_PIVOTS = 256
_SLACK = 1e-7
_FINEST = 2.0**-5


class CoverTree:
    """Levels of nodes over unit vectors: radius bound 2, 1, 1/2, ...  A node's centre is also a centre one level down."""

    def __init__(self, x: np.ndarray):
        self.x = x
        members = [np.arange(len(x))]
        bound, self.levels = 2.0, []
        while True:
            centre = np.array([m[0] for m in members])
            radius = np.array([self._distance(m[0], m).max() for m in members])
            self.levels.append({"centre": centre, "radius": radius, "members": members})
            if bound <= _FINEST or not (radius > 0).any():
                break
            bound /= 2
            split = [self._split(m, r, bound) for m, r in zip(members, radius)]
            self.levels[-1]["child"] = np.cumsum([0] + [len(s) for s in split])
            members = [m for s in split for m in s]

    def _distance(self, a: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.x[rows] @ self.x[a]), 0)) if len(rows) > 1 else np.zeros(1)

    def _split(self, rows: np.ndarray, radius: float, bound: float) -> list[np.ndarray]:
        if radius <= bound:
            return [rows]
        gram = np.sqrt(np.maximum(2 - 2 * (self.x[rows] @ self.x[rows].T), 0))
        free, out = np.ones(len(rows), bool), []
        for i in range(len(rows)):
            if free[i]:
                near = free & (gram[i] <= bound)
                near[i] = True
                free &= ~near
                near[i] = False
                out.append(np.r_[rows[i], rows[near]])
        return out


def links(x: np.ndarray, wx: np.ndarray, y: np.ndarray | None, wy: np.ndarray | None, threshold: float):
    """Weighted link counts of both sides and the labels of connected members, for one pair of blocks (or one block).

    The labels number the rows of x, then those of y; each row's label is the smallest row connected to it.
    """
    same = y is None
    reach = math.sqrt(2 - 2 * threshold)
    a, b = CoverTree(x), None
    b = a if same else CoverTree(y)
    n = len(x)
    nx, ny = np.zeros(n), np.zeros(n if same else len(y))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    shift = 0 if same else n

    def whole(i: np.ndarray, j: np.ndarray, inner: bool) -> None:
        """Every row of i links with every row of j (inner: i is j, each with all others)."""
        total_i, total_j = wx[i].sum(), (wx if same else wy)[j].sum()
        if inner:
            nx[i] += total_i - wx[i]
            edges.append((i[1:], np.full(len(i) - 1, i[0])))
            return
        nx[i] += total_j
        (nx if same else ny)[j] += total_i
        edges.append((i, np.full(len(i), j[0] + shift)))
        edges.append((j + shift, np.full(len(j), i[0])))

    def compare(i: np.ndarray, j: np.ndarray, inner: bool) -> None:
        """The exact test of every pair of two leaves."""
        hit = x[i] @ (x if same else y)[j].T >= threshold
        if inner:
            np.fill_diagonal(hit, False)
        nx[i] += hit @ (wx if same else wy)[j]
        if not inner:
            (nx if same else ny)[j] += wx[i] @ hit
        p, q = np.nonzero(hit)
        edges.append((i[p], j[q] + shift))

    pa, pb = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(len(a.levels), len(b.levels))):
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        bottom_a, bottom_b = level >= len(a.levels) - 1, level >= len(b.levels) - 1
        ua, ia = np.unique(pa, return_inverse=True)
        ub, ib = np.unique(pb, return_inverse=True)
        far = np.sqrt(np.maximum(2 - 2 * (x[la["centre"][ua]] @ (x if same else y)[lb["centre"][ub]].T), 0))
        d, r = far[ia, ib], la["radius"][pa] + lb["radius"][pb]
        keep = d <= r + reach + _SLACK
        full = keep & (d + r <= reach - _SLACK)
        leaf = keep & ~full & ((bottom_a & bottom_b) | (r == 0))
        for test, act in ((full, whole), (leaf, compare)):
            single = test & (r == 0)
            if act is compare and single.any():  # lone vectors, all pairs at once
                self_pair = np.full(len(pa), same) & (pa == pb)
                at = np.flatnonzero(single & ~self_pair)
                i, j = la["centre"][pa[at]], lb["centre"][pb[at]]
                hit = np.einsum("ij,ij->i", x[i], (x if same else y)[j]) >= threshold
                i, j = i[hit], j[hit]
                np.add.at(nx, i, (wx if same else wy)[j])
                np.add.at(nx if same else ny, j, wx[i])
                edges.append((i, j + shift))
                test = test & ~single
            for k in np.flatnonzero(test):
                act(la["members"][pa[k]], lb["members"][pb[k]], same and pa[k] == pb[k])
        more = keep & ~full & ~leaf
        if not more.any():
            break
        pa, pb = _open(pa[more], pb[more], None if bottom_a else la["child"], None if bottom_b else lb["child"], same)
    label = np.arange(n + (0 if same else len(y)))
    if edges:
        u, v = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
        while len(u):
            low = np.minimum(label[u], label[v])
            before = label.copy()
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
            label = label[label]
            if (label == before).all():
                break
    return nx, ny, label


def _open(pa, pb, child_a, child_b, same):
    """Pairs of the children of each pair of nodes; within one tree each unordered pair once."""
    na = np.ones(len(pa), np.int64) if child_a is None else child_a[pa + 1] - child_a[pa]
    nb = np.ones(len(pb), np.int64) if child_b is None else child_b[pb + 1] - child_b[pb]
    n = na * nb
    at = np.repeat(np.arange(len(pa)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    qa = (pa if child_a is None else child_a[pa])[at] + k // nb[at]
    qb = (pb if child_b is None else child_b[pb])[at] + k % nb[at]
    if same:
        once = (pa[at] != pb[at]) | (qa <= qb)
        qa, qb = qa[once], qb[once]
    return qa, qb


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have the same length and their cosine is at least
    ``threshold``.  Vectors that are null, zero, hold null or non-finite components or have no label link with nothing and
    are their own component.  A null vec_id links with nothing: n_links 0, component_id null, kept false.
    Rows that share a vec_id are vectors of their own.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    @F.pandas_udf("array<double>")
    def normal(v: pd.Series) -> pd.Series:
        scaled = (x / np.abs(x).max() for x in v)  # first by the largest part, lest squares overflow
        return pd.Series([x / np.sqrt(x @ x) for x in scaled])

    classes = good.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").cast("double").alias("w"))
    # Equal vectors are one class with a number of its own, since several classes may share an id.  The table is settled, so
    # numbers stay, and no filter on lengths is pushed below the norms.
    classes = settled(classes.withColumns({"id": F.monotonically_increasing_id(), "u": normal("v"), "size": F.size("v")}), "classes")
    unit = classes.select("id", "label", "size", "w", F.col("u").alias("v"))
    key = ["label", "size"]  # every length has pivots and cells of its own
    counts = unit.groupBy(*key).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*key).orderBy(F.xxhash64("id"), "id")
    ranked = unit.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_pivots)
    wanted = F.least(F.lit(max_pivots), F.ceil(F.col("n") / block_rows))
    pivots = ranked.join(counts, key).where(F.col("k") <= wanted).groupBy(*key).agg(F.collect_list("v").alias("pivots"))
    pivots = settled(pivots, "pivots")

    @F.pandas_udf("array<double>")
    def distances(v: pd.Series, pivots: pd.Series) -> pd.Series:
        return pd.Series([np.sqrt(np.maximum(2 - 2 * (np.stack(p) @ x), 0)) for x, p in zip(v, pivots)])

    near = unit.join(pivots, key).withColumn("d", distances("v", "pivots")).drop("pivots")
    near = near.withColumn("own", F.array_min("d")).withColumn("cell", F.array_position("d", F.col("own")).cast("int") - 1)
    near = settled(near, "cells")
    cells = near.groupBy(*key, "cell").agg(F.max("own").alias("radius"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    cells = cells.groupBy(*key).agg(F.collect_list(F.struct("cell", "radius", "blocks")).alias("cells"))  # max_pivots at most
    near = near.join(cells, key)
    reach = math.sqrt(2 - 2 * threshold) + _SLACK
    blocks = F.filter("cells", lambda c: c["cell"] == F.col("cell"))[0]["blocks"]
    near = near.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    open_ = F.filter("cells", lambda c: F.element_at("d", c["cell"] + 1) <= c["radius"] + reach)
    others = F.flatten(F.transform(open_, lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda s: F.struct(c["cell"].alias("cell"), s.alias("block")))))
    own = F.struct("cell", "block")
    met = near.withColumn("own", own).withColumn("other", F.explode(others))
    met = met.select(*key, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("right"), "id", "w", "v")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        left, right = pdf[~pdf["right"]], pdf[pdf["right"]]
        same = pdf["p"].iloc[0] == pdf["q"].iloc[0]
        empty = pd.DataFrame({"id": np.zeros(0, np.int64), "n": np.zeros(0), "root": np.zeros(0, np.int64)})
        if not len(left) or (not same and not len(right)):
            return empty
        x, y = np.stack(left["v"].to_numpy()), None if same else np.stack(right["v"].to_numpy())
        nx, ny, label = links(x, left["w"].to_numpy(), y, None if same else right["w"].to_numpy(), threshold)
        ids = left["id"].to_numpy() if same else np.r_[left["id"].to_numpy(), right["id"].to_numpy()]
        n = nx if same else np.r_[nx, ny]
        hit = n > 0
        return pd.DataFrame({"id": ids[hit], "n": n[hit], "root": ids[label][hit]})

    found = settled(met.groupBy(*key, "p", "q").applyInPandas(task, "id long, n double, root long"), "links")
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.join(totals, "id", "left").join(joined, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id"))
    known = settled(known.select("label", "v", "least", "c", (F.coalesce("n", F.lit(0.0)) + F.col("w") - 1).cast("long").alias("n")), "known")
    names = known.groupBy("c").agg(F.min("least").alias("name"))
    known = known.join(names, "c").select(F.col("label").alias("l"), F.col("v").alias("x"), "n", F.col("name").alias("c"))
    ok = usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    linked = rows.where(ok).join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("x")))
    out = linked.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    rest = rows.where(~ok).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
