import itertools

import pytest
import xxhash

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    ids = {d: d for d, _ in prints}

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for (a, x), (b, y) in itertools.combinations(prints, 2):
        if bin(x ^ y).count("1") <= 4:
            a, b = sorted((root(a), root(b)))
            ids[b] = a
    return {d: root(d) for d in ids}


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = sorted((r.doc_id, slow_fingerprint(r.text)) for r in docs.collect())
    assert {d: f"{x:016x}" for d, x in prints} == {d: r.fingerprint for d, r in got.items()}
    assert slow_groups(prints) == {d: r.component_id for d, r in got.items()}


def test_every_distance_and_chains(spark):
    base = 0x0123456789ABCDEF
    flips = [0, 0b1111, 1 << 63 | 1 << 40 | 1 << 20 | 1, 0b11111 << 30, 0xFF << 50]
    chain = [base ^ f for f in flips] + [~base & (2**64 - 1) ^ (2 ** (4 * i) - 1) for i in range(5)]
    signed = [(i, x - 2**64 if x >> 63 else x) for i, x in enumerate(chain)]
    got = simhash.groups(spark.createDataFrame([(x, i) for i, x in signed], "fp long, doc_id long")).collect()
    assert {r.fp: r.component_id for r in got} == {dict(signed)[i]: c for i, c in slow_groups([(i, x) for i, x in enumerate(chain)]).items()}


def test_odd_rows(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, " \t\n", "x", "y"), (4, "A b", "", ""), (5, "a B", "", ""), (5, "a B", None, None), (None, "a b", "", "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_too_few_segments(spark):
    with pytest.raises(ValueError):
        simhash.groups(spark.createDataFrame([], "fp long, doc_id long"), distance=6)
