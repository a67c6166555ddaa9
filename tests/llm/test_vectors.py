import math
import random

import numpy as np

from tidemark.llm import neighbours, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, own string"


def slow(rows, t=0.93):
    good = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)
    keep = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and good(v) and lab is not None]
    n, root = {i: 0 for i, *_ in rows if i is not None}, {i: i for i, *_ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keep)):
        for b in range(a):
            (i, u, x), (j, v, y) = keep[a], keep[b]
            if x == y and len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= t:
                n[i] += 1
                n[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (n[i], find(i)) for i in n}


def cloud(rng, n, labels=2, size=8, spread=0.35):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(max(1, n // 12))]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, **options).where("vec_id is not null").collect()}
    assert got == slow(rows)


def test_links_and_components(spark):
    rng = random.Random(4)
    rows = cloud(rng, 300)
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(20)]
    rows += [(400 + i, [c * (1 + i) + rng.gauss(0, 0.01) for c in rows[9][1]], rows[9][2]) for i in range(60)]
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, block_rows=25, max_pivots=4)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, nan], 1), (5, [1.0, inf], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [3e30, 0.0], 1), (10, [-1.0, 0.0], 1), (11, [-0.0, 1.0], 1), (12, [0.0, 1.0], 1), (13, [1e-30, 0.0], 1)]
    check(spark, rows)
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1, "", ""), (1, [1.0, 0.0], 1, "", ""), (None, [1.0, 0.0], 1, "", "")], SCHEMA)
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in vectors.near_duplicates(twice).collect()) == [(0, 0, False), (1, 1, True), (1, 1, True)]
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_ids_are_vectors_of_their_own(spark):
    rng = random.Random(6)
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [1.0, 0.001], 1), (9, [0.001, 1.0], 1), (1, [1.0, 0.0], 2), (1, [0.0, 1.0], 2), (2, [1.0, 0.001], 2)]
    rows += [(20 + i // 3, v, 3) for i, v, _ in cloud(rng, 90, 1, 2)]
    rng.shuffle(rows)
    numbered = slow([(k, v, lab) for k, (_, v, lab) in enumerate(rows)])
    least = {}
    for k, (i, *_) in enumerate(rows):
        root = numbered[k][1]
        least[root] = min(least.get(root, i), i)
    want = sorted((i, numbered[k][0], least[numbered[k][1]]) for k, (i, *_) in enumerate(rows))
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    for options in ({}, {"block_rows": 10, "max_pivots": 3}):
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df, **options).collect()) == want


def nearest(rows, asked, k):
    good = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
    x = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if good(v)]
    out = {}
    for i, q in x:
        if i in asked:
            order = sorted((-(q @ v), j) for j, v in x if j != i)[:k]
            out.update({(i, r): (j, -s) for r, (s, j) in enumerate(order, 1)})
    return out


def test_exact_search(spark):
    rng = random.Random(2)
    rows = cloud(rng, 400) + [(500 + i, [1.0 * i] * 8, 0) for i in range(3)] + [(600, None, 0), (601, [float("nan")] * 8, 0)]
    rows += [(700 + i, rows[3][1], 0) for i in range(30)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    asked = {i for i, *_ in rows if i % 20 == 0}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.search(df, df.where("vec_id % 20 = 0"), 10, factor=1.0).collect()}
    want = nearest(rows, asked, 10)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    few = df.where("vec_id in (1, 2, 20)")
    assert neighbours.search(few, few.where("vec_id = 20"), 10).count() == 2
    assert neighbours.search(df.limit(0), df, 5).count() == 0


def test_ties_of_identical_vectors(spark):
    """150 equal rows among 700: ranks go by product, then by id, although distances differ in their last bits."""
    rng = np.random.default_rng(3)
    for size in (64, 8):
        x = rng.normal(size=(700, size))
        x[rng.choice(700, 150, replace=False)] = x[0]
        tree = neighbours.VantageTree(x, np.arange(700), (x * x).sum(axis=1).max(), leaf=40)
        _, got = tree.search(x, np.arange(700), 20, 1.0)
        products = np.stack([np.einsum("ij,ij->i", np.repeat(x[i : i + 1], 700, axis=0), x) for i in range(700)])
        for i in range(700):
            order = [j for j in np.lexsort((np.arange(700), -products[i])) if j != i][:20]
            assert got[i].tolist() == order
        rows = [(int(i), [float(c) for c in v], 0, "a", "b") for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell string, own string")
        found = neighbours.search(df, df.where("vec_id % 20 = 0"), 20, factor=1.0).orderBy("query_id", "rank").collect()
        assert [r.vec_id for r in found] == [j for i in range(0, 700, 20) for j in got[i].tolist()]


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0")
    found = neighbours.search(rows, asked)
    assert found.groupBy("query_id").count().where("count <> 20").count() == 0
    assert neighbours.recall(found, rows, asked) >= 0.9


def mixed(rng):
    """Three lengths in both labels; the smallest id has a length that hardly any other has."""
    rows = [(0, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.0, 3.1], 0), (2, [1.0, 1.0], 1)]
    rows += [(10 + i, v, lab) for i, v, lab in cloud(rng, 150)]
    return rows + [(400 + i, v, lab) for i, v, lab in cloud(rng, 100, size=5)]


def test_links_between_vectors_of_mixed_length(spark):
    rows = mixed(random.Random(6))
    check(spark, rows)
    check(spark, rows, block_rows=25, max_pivots=4)


def test_search_among_vectors_of_mixed_length(spark):
    rows = mixed(random.Random(7))
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    asked = {i for i, *_ in rows if i % 10 == 0}
    got = {(r.query_id, r["rank"]): r.vec_id for r in neighbours.search(df, df.where("vec_id % 10 = 0"), 10, factor=1.0).collect()}
    want = {}
    for size in {len(v) for _, v, _ in rows}:
        want |= nearest([r for r in rows if len(r[1]) == size], asked, 10)
    assert got == {k: v[0] for k, v in want.items()}


def test_search_with_shared_ids(spark):
    """Candidate rows that share an id each take a rank; query rows that share one are asked together, neither finds the other."""
    rows = [(20, [1.0, 0.0], 0), (3, [0.9, 0.0], 0), (3, [0.8, 0.0], 0), (7, [0.1, 0.1], 0)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = [(r["rank"], r.vec_id) for r in neighbours.search(df, df.where("vec_id = 20"), 5, factor=1.0).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 3), (3, 7)]
