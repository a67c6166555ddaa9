import random

from tidemark.llm import common


def test_components_and_their_jobs(spark, monkeypatch):
    """Chains, stars and loops; the edges of a round are signed once, not again in the next."""
    rng, seen = random.Random(5), []
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300 + rng.randrange(50), 300 + rng.randrange(50)) for _ in range(40)] + [(7, 7), (None, 3)]
    group = {v: v for e in edges for v in e if v is not None and e[0] != e[1]}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            group[max(a, b)] = min(a, b)
    signed, written = common._signature, common.settled
    monkeypatch.setattr(common, "_signature", lambda pairs: seen.append("signed") or signed(pairs))
    monkeypatch.setattr(common, "settled", lambda df, name: seen.append("written") or written(df, name))
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = {v for a, b in edges if None not in (a, b) and a != b for v in (a, b)}
    assert got == {v: root(v) for v in real}
    rounds = seen.count("signed") - 1
    assert rounds > 1 and seen.count("written") == 1 + 2 * rounds
