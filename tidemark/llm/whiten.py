"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are rows of whole numbers ``x = floor(64 c) + 1000000``; n of them have per-dimension sums S.  Centred rows are
``(n x - S) / n`` with an exact numerator, so nothing is lost before the division.  One pass over the rows is one step of the
bidiagonalisation: it multiplies the centred rows X by a direction (the left vector, one number a row) and X transposed by what
comes out.  A left vector always is X times a known combination of directions, so it is made again in the pass that needs it
and never stored; both sides are orthogonalised against all vectors before them on the driver, which only holds matrices of
dimensions x steps.  The singular values of the small upper triangular matrix (bidiagonal but for rounding and new starts)
give the deviations, its right vectors the components.

Sums leave a task as one row a dimension and are added by a grouped sum, however many tasks there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settled

#: Fixed values of the whole numbers.
SCALE, BASE = 64, 1_000_000
COMPONENTS = 32
#: A direction counts as spent below this share of the largest deviation, and a component with a deviation below it is left out.
SPENT = 1e-11
#: A component has converged when its residual is below this share of the largest deviation.
CONVERGED = 1e-14
SEED = 7
#: Entries beyond this cannot be written as whole numbers of 64 bits.
LARGEST = 2.0**56

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, size and ``x`` (64-bit whole numbers less the base, in binary) of all vectors that can be used.

    Left out: null vectors, null and non-finite entries, and entries beyond ``LARGEST``.
    """
    scale = F.col("embedding").cast("array<double>")
    good = F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))

    def run(batches):
        for batch in batches:
            vec_id, size, v = batch.columns
            x = np.floor(v.flatten().to_numpy() * SCALE).astype("<i8")
            borders = pa.array(np.concatenate([[0], np.cumsum(size.to_numpy(), dtype=np.int64)]) * 8)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(borders.to_numpy().tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([vec_id, size, data.cast(pa.binary())], ["vec_id", "size", "x"])

    rows = vectors.select(F.col("vec_id").cast("long"), scale.alias("v")).where(good)
    return rows.select("vec_id", F.size("v").alias("size"), "v").mapInArrow(run, "vec_id long, size int, x binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The whole numbers of a batch, a row a vector."""
    data = column.buffers()[2]
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(data, "<i8", count=len(column) * size, offset=start).reshape(-1, size)


def _summed(rows: DataFrame, size: int, count: int, kind: str, part) -> np.ndarray:
    """Adds up, over all tasks, the ``count`` numbers that ``part`` makes of each batch's matrix."""
    to = {"long": np.int64, "double": np.float64}[kind]

    def run(batches):
        total = np.zeros(count, to)
        for batch in batches:
            if len(batch):
                total += part(_matrix(batch.column(0), size))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array(total)], ["place", "value"])

    parts = rows.select("x").mapInArrow(run, f"place int, value {kind}")
    out = np.zeros(count, to)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():  # one number for each of the count
        out[r.place] = r.value
    return out


class Centred:
    """Rows of one length, with what is needed to centre them."""

    def __init__(self, rows: DataFrame, size: int, n: int):
        self.rows, self.size, self.n = rows, size, n
        self.sums = _summed(rows, size, size, "long", lambda x: x.sum(0))

    def centre(self):
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums) / n

    def squares(self) -> float:
        centre = self.centre()
        return float(_summed(self.rows, self.size, 1, "double", lambda x: np.array([np.square(centre(x)).sum()]))[0])

    def step(self, direction: np.ndarray) -> tuple[np.ndarray, float]:
        """X transposed times (X times direction), and the squared length of the latter."""
        centre = self.centre()

        def part(x: np.ndarray) -> np.ndarray:
            rows = centre(x)
            left = rows @ direction
            return np.append(left @ rows, left @ left)

        out = _summed(self.rows, self.size, self.size + 1, "double", part)
        return out[:-1], float(out[-1])


def _against(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` less its part in the span of the orthonormal columns of ``basis``, twice."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(x: Centred, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of the centred rows, and their right vectors as columns.

    Where a start is used up or has given all that is wanted, another one is made at random in what is left, so that equal
    singular values are found as well; it ends when a start adds nothing to those wanted, or when nothing is left.
    """
    random = np.random.default_rng(SEED)
    right, ways, back = (np.zeros((x.size, 0)) for _ in range(3))  # directions V; W and XᵀU, where the left vectors are U = X W
    upper = np.zeros((0, 0))  # X V = U B
    rest: dict[int, np.ndarray] = {}  # what is left of XᵀU beyond V, where a start ends, by left vector
    largest, begun, nxt = 0.0, 0, None
    while right.shape[1] < x.size:
        if nxt is None:  # a start in the span of the rows
            begun, start = right.shape[1], _against(random.standard_normal(x.size), right)
            nxt, squared = x.step(start / np.linalg.norm(start))
            if np.sqrt(squared) <= SPENT * largest or squared == 0:
                break
            nxt = _against(nxt / np.linalg.norm(nxt), right)
        v = _against(nxt / np.linalg.norm(nxt), right)
        v = v / np.linalg.norm(v)
        along = back.T @ v  # Uᵀ X v
        way = v - ways @ along
        turned, squared = x.step(way)
        more = ways.T @ turned  # what is left of U in X (v - W along)
        way, along = way - ways @ more, along + more
        length = float(np.sqrt(max(squared - more @ more, 0.0)))
        largest = max(largest, float(np.linalg.norm(np.append(along, length))))
        right = np.column_stack([right, v])
        upper = np.column_stack([upper, along])
        if length <= SPENT * largest:
            nxt = None
            continue
        turned = (turned - back @ more) / length
        ways, back = np.column_stack([ways, way / length]), np.column_stack([back, turned])
        upper = np.vstack([upper, np.append(np.zeros(upper.shape[1] - 1), length)])
        left = _against(turned, right)
        rest = {k: _against(r, right) for k, r in rest.items()} | {upper.shape[0] - 1: left}
        nxt = left if np.linalg.norm(left) > SPENT * largest else None
        if nxt is None or len(right.T) - begun < 2 or right.shape[1] == x.size:
            continue
        # All wanted ones converged: begin anew, unless the present start has nothing among them.
        p, s, q = np.linalg.svd(upper)
        if len(s) < wanted:
            continue
        ahead = sum(np.outer(r, p[k, :wanted]) for k, r in rest.items())
        if np.linalg.norm(ahead, axis=0).max() <= CONVERGED * s[0]:
            if begun and np.abs(q[:wanted, begun:]).max() < 0.5:
                break
            nxt = None
    _, s, q = np.linalg.svd(upper)
    found = [i for i in range(min(wanted, len(s))) if s[i] > SPENT * s[0]]
    return s[found], (right @ q.T)[:, found]


def _whitened(x: Centred, parts: np.ndarray) -> np.ndarray:
    """Largest absolute entry of the covariance of the whitened rows less the identity."""
    centre, k = x.centre(), parts.shape[1]
    mean = _summed(x.rows, x.size, k, "double", lambda r: (centre(r) @ parts).sum(0)) / x.n

    def part(r: np.ndarray) -> np.ndarray:
        w = centre(r) @ parts - mean
        return (w.T @ w).ravel()

    return _summed(x.rows, x.size, k * k, "double", part).reshape(k, k) / x.n - np.eye(k)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component (from 1, by falling eigenvalue): ``RESULT``.

    ``vec_id`` and ``embedding`` are used, other columns ignored.  Vectors of each length are a fit list of their own.  Rows
    that share an id, and null ids, are vectors like any other; there are at most as many components as have a deviation
    above 0 (none for a single vector, equal vectors, or empty ones).  Components with equal eigenvalues may be any basis of
    their space.  deviation is exact; it is null where it does not fit 64 bits.  An empty table gives no rows.
    """
    spark, table = vectors.sparkSession, settled(whole(vectors), "whole")
    out = spark.createDataFrame([], RESULT)
    for r in sorted(table.where("size > 0").groupBy("size").count().collect()):  # a row for each length
        rows = table.where(F.col("size") == r["size"])
        x = Centred(rows, r["size"], r["count"])
        values, parts = bidiagonalise(x, min(components, x.size)) if x.n > 1 else (np.zeros(0), None)
        if not len(values):
            continue
        variance = np.square(values) / x.n
        parts = parts / np.sqrt(variance)
        explained = variance / (x.squares() / x.n)
        error = float(np.abs(_whitened(x, parts)).max())
        out = out.unionByName(_projected(x, parts, explained, error))
    return out


def _projected(x: Centred, parts: np.ndarray, explained: np.ndarray, error: float) -> DataFrame:
    k, n, sums, size, centre = parts.shape[1], x.n, x.sums, x.size, x.centre()

    def exact(row: np.ndarray) -> int | None:
        total = sum((n * c - s) ** 2 for c, s in zip(row.tolist(), sums.tolist()))
        return total if total < 1 << 63 else None

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows = _matrix(batch.column(1), size)
            far = np.abs(n * rows.astype(float) - sums).max()
            fits = far * far * size < 2**62
            deviation = pa.array(np.square(n * rows - sums).sum(1)) if fits else pa.array([exact(row) for row in rows], pa.int64())
            each = pa.array(np.repeat(np.arange(len(rows)), k))
            columns = [
                batch.column(0).take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)), np.full(len(each), n), deviation.take(each),
                (centre(rows) @ parts).ravel(), np.tile(explained, len(rows)), np.full(len(each), error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in RESULT.split(", ")])

    return x.rows.select("vec_id", "x").mapInArrow(run, RESULT)
