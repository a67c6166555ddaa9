import random

import numpy as np
import pytest

from tidemark.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("large, bins", [(1_000_000, 4096), (40, 8), (3, 2)])
def test_quantiles_equal_numpy(spark, large, bins):
    """Ties, nulls, null keys, single values, far outliers and one group with most of the rows, at every size limit."""
    rng = random.Random(7)
    rows = [("hot", 1, rng.choice((rng.gauss(0, 1), 0.5, 0.5, 1e9 * rng.random() ** 9))) for _ in range(2000)]
    rows += [("same", 1, 2.5)] * 300 + [("one", 1, -3.0)] + [("none", 1, None)] * 4 + [(None, None, float(i % 7)) for i in range(90)] + [(None, 2, -float(i)) for i in range(50)]
    rows += [(f"g{i % 9}", i % 2, rng.random() if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, j long, x double")
    ps = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    got = {(r.k, r.j): r.q for r in exact_quantiles(df, ["k", "j"], "x", ps, large, bins).collect()}
    groups = {}
    for k, j, x in rows:
        if x is not None:
            groups.setdefault((k, j), []).append(x)
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key] == pytest.approx(list(np.quantile(values, ps)), rel=1e-12)
    assert exact_quantiles(df.limit(0), ["k"], "x", [0.5], large, bins).count() == 0
