import random

import corpus_pipeline

from tidemark.llm import similar

SCHEMA = "doc_id long, text string, n_chars long"


def text(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def rows_of(spark, rows):
    return spark.createDataFrame([(d, None if t is None else " ".join(t), n) for n, (d, t) in enumerate(rows)], SCHEMA)


def test_planted_copies_from_similarity_080(spark):
    """A changed tail of k of 180 shingles gives (180 - k) / (180 + k): 0.8, 0.856, 0.905, 0.957; 0.791 is too little."""
    rng = random.Random(3)
    rows, kept = [], []
    for i in range(0, 300, 10):
        base = text(rng, 184)
        rows.append((i, base))
        kept += [i, i + 9]
        rows += [(i + j, base[: 184 - k] + text(rng, k)) for j, k in ((1, 20), (2, 14), (3, 9), (4, 4), (9, 21))]
    out = corpus_pipeline.simhash_stage(spark, rows_of(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == kept


def test_one_row_per_group(spark):
    rng = random.Random(4)
    a, b, c, d, e = (text(rng, 60) for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (2, a), (2, b), (3, b), (None, a), (None, c), (None, c), (4, d), (4, e), (None, e), (5, None), (None, None), (6, [])]
    out = corpus_pipeline.simhash_stage(spark, rows_of(spark, rows), "")
    assert out.columns == ["doc_id", "text", "n_chars"]
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.where("text is not null").collect())
    assert got == sorted((i, " ".join(t), n) for i, t, n in ((1, a, 0), (2, b, 4), (0, c, 7), (4, d, 9), (4, e, 10)))
    assert [r.doc_id for r in out.where("text is null").collect()] == [5]
    assert corpus_pipeline.simhash_stage(spark, rows_of(spark, rows).limit(0), "").count() == 0


def test_many_edited_copies_against_all_pairs(spark):
    """Copies of a few texts with single words changed, many at the same places: links only between some, found without the band's pairs."""
    rng, rows = random.Random(5), {}
    for k in range(4):
        base = text(rng, 60 + 40 * k)
        spots = [rng.randrange(len(base)) for _ in range(8)]
        for _ in range(90):
            copy = list(base)
            for _ in range(rng.choice((1, 1, 2, 2, 3, 4))):
                copy[rng.choice(spots) if rng.random() < 0.5 else rng.randrange(len(base))] = f"e{rng.randrange(10**6 if rng.random() < 0.7 else 3)}"
            rows[len(rows)] = copy[: len(copy) - rng.choice((0, 0, 0, 5))]
    sets = {d: set(similar.shingles(" ".join(t)).tolist()) for d, t in rows.items()}
    least = {d: d for d in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    links = [(a, b) for a in rows for b in range(a) if 9 * len(sets[a] ^ sets[b]) <= len(sets[a]) + len(sets[b])]
    for a, b in links:
        low, high = sorted((root(a), root(b)))
        least[high] = low
    want = sorted({root(d) for d in rows})
    assert 1000 < len(links) and 20 < len(want) < 340
    out = corpus_pipeline.simhash_stage(spark, rows_of(spark, list(rows.items())), "")
    assert sorted(r.doc_id for r in out.collect()) == want
