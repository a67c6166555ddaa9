from tidemark.operators import harvest


def test_pairs_without_a_common_month_are_candidates(spark):
    rows = [("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "y"), ("f", "z"), ("g", None), ("h", None)]
    security = spark.createDataFrame([(s, k, s) for s, k in rows], "sec string, sector string, industry string")
    corr = {("a", "b"): (0.1, 40), ("a", "d"): (0.2, 40), ("a", "e"): (0.9, 40), ("b", "f"): (0.0, 5), ("d", "e"): (0.1, 40)}
    table = spark.createDataFrame([(*p, *c) for p, c in corr.items()], "si string, sj string, corr double, n long")
    want = {}
    for s, k in rows:
        fit = [(k is None or k != k2, t) for t, k2 in rows if t != s and not (lambda c: c[1] >= 30 and abs(c[0]) < 0.7)(corr.get((min(s, t), max(s, t)), (0, 0)))]
        want.update({(s, i): (t, 0.2 if far else 0.7) for i, (far, t) in enumerate(sorted(fit)[:3], 1)})
    got = {(r.sec, r["rank"]): (r.candidate, r.similarity) for r in harvest.replacements(security, table, most=3).collect()}
    assert got == want
