import random

from tidemark.llm import substring

SCHEMA = "doc_id long, text string, at string, mask string"


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in substring.digest(df, **options).collect())
    assert got == sorted(substring.brute_force(rows, options.get("window", 13)))
    return got


def test_random_passages(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(6)] + ["ü", "É,"]
    shared = [[rng.choice(words) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += [rng.choice(words) for _ in range(rng.randint(0, 9))] + rng.choice(shared)[rng.randint(0, 6) :]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(parts)))
    rng.shuffle(rows)
    for window, anchor, direct in ((13, 5, 256), (13, 13, 1), (6, 2, 256), (3, 1, 1)):
        check(spark, rows, window=window, anchor=anchor, bucket_bytes=8_000, direct=direct)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], bucket_bytes=100_000)


def test_odd_rows(spark):
    long = " ".join("x%d" % i for i in range(20))
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, "a " * 30), (6, "a " * 12), (7, "a " * 13), (8, "\x1c\x85 " + long), (9, long), (10, long + " y")]
    check(spark, rows)
    same = spark.createDataFrame([(3, long, "", ""), (3, long + " y", "", ""), (None, long, "", "")], SCHEMA)
    assert sorted(r.n_removed for r in substring.digest(same).collect()) == [0, 0, 0]
    assert substring.digest(spark.createDataFrame([], SCHEMA)).count() == 0
