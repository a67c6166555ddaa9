import math
import random

import numpy as np

from tidemark.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, size string"


def slow(rows, k=32):
    """By length: n, eigenvalues and projections from the full covariance."""
    good = lambda v: v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)
    out = {}
    for size in {len(v) for _, v in rows if good(v)}:
        own = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if good(v) and len(v) == size]
        x = [[int(math.floor(64 * c)) + 1000000 for c in v] for _, v in own]
        n, sums = len(x), [sum(c) for c in zip(*x)]
        whole = [[n * c - s for c, s in zip(v, sums)] for v in x]
        centred = np.array([[c / n for c in v] for v in whole])
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        order = np.argsort(-values)[:k]
        out[size] = n, [i for i, _ in own], [sum(c * c for c in v) for v in whole], values[order], vectors[:, order], values.sum(), centred
    return out


def check(spark, rows, k=32, distinct=True):
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA)
    found = whiten.whiten(df, k).collect()
    total = 0
    for n, ids, deviation, values, vectors, trace, centred in slow(rows, k).values():
        own = [r for r in found if r.n == n and r.vec_id in set(ids)]
        rank = int(np.sum(values > 1e-12 * max(values.max(), 1e-300)))
        if n == 1:
            continue
        total += n * rank
        assert len(own) == n * rank
        place = {i: j for j, i in enumerate(ids)}
        got, dev = np.zeros((n, rank)), {}
        for r in own:
            got[place[r.vec_id], r.component - 1] = r.whitened
            dev[r.vec_id] = r.deviation
            assert abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * values[r.component - 1] / trace + 1e-15
            assert r.identity_error < 1e-6
        assert [dev[i] for i in ids] == deviation
        for c in range(rank if distinct else 0):
            want = centred @ vectors[:, c] / math.sqrt(values[c])
            assert min(np.abs(got[:, c] - want).max(), np.abs(got[:, c] + want).max()) < 1e-6 * max(1, np.abs(want).max())
        assert np.abs(got.T @ got / n - np.eye(rank)).max() < 1e-6
    assert total == len(found)


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(spark, rows)


def test_spectra(spark):
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    steep = (rng.standard_normal((400, 40)) * 10.0 ** np.linspace(4, 0, 40)) @ turn
    check(spark, [(i, v.tolist()) for i, v in enumerate(steep)])
    check(spark, [(i, v.tolist()) for i, v in enumerate(steep)], k=5)
    low = rng.integers(-90, 90, (300, 4)) @ rng.integers(-3, 4, (4, 20))
    check(spark, [(i, (v / 64).tolist()) for i, v in enumerate(low)])  # four components only
    check(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((9, 30)))])  # fewer rows than dimensions


def test_equal_eigenvalues(spark):
    axes = [(i, [float(s) if j == i % 12 else 0.0 for j in range(12)]) for i, s in enumerate([1, -1] * 60)]
    axes = [(i * 2 + k, [(1.0 if k else -1.0) if j == i % 12 else 0.0 for j in range(12)]) for i in range(24) for k in range(2)]
    check(spark, axes, distinct=False)


def test_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(6)]) for i in range(60)] + [(100 + i, [0.5, -0.25, rng.random()]) for i in range(10)]
    rows += [(200, None), (201, []), (202, [1.0, float("nan")] * 3), (203, [float("inf")] * 6), (204, [1.0, None] * 3), (205, [0.0] * 6), (206, [3.0])]
    check(spark, rows)
    same = spark.createDataFrame([(1, [0.5, 0.5], 1, "", "")] * 4 + [(2, [1e30, 0.0], 1, "", "")], SCHEMA)
    assert whiten.whiten(same).count() == 0 and whiten.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, [0.5, 0.5], 1, "", ""), (1, [0.5, 1.5], 1, "", ""), (None, [0.5, 1.5], 1, "", "")], SCHEMA)
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation) for r in whiten.whiten(twice).collect()) == [(0, 1, 3, 64 * 64), (1, 1, 3, 64 * 64), (1, 1, 3, 4 * 64 * 64)]
    far = spark.createDataFrame([(1, [1e12], 1, "", ""), (2, [-1e12], 1, "", "")], SCHEMA)
    assert [(r.deviation, round(abs(r.whitened), 9)) for r in whiten.whiten(far).collect()] == [(None, 1.0)] * 2
