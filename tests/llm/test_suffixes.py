import random

from tidemark.llm import suffixes

SCHEMA = "doc_id long, text string, bucket string, z string"


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in suffixes.digest(df, **options).collect())
    assert got == sorted(suffixes.brute_force(rows, options.get("length", 50)))


def test_random_passages(spark):
    rng = random.Random(7)
    for letters, length, direct in (("ab", 12, 256), ("abcdefgh ", 20, 1), ("é ü", 50, 256)):
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))
        shared = [text(rng.randint(length // 2, 3 * length)) for _ in range(5)]
        rows = []
        for d in range(50):
            rows.append((d, "".join(text(rng.randint(0, 2 * length)) + rng.choice(shared)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 4)))))
        rows.append((60, "a" * 300))
        rows.append((61, "a" * 200))
        rng.shuffle(rows)
        check(spark, rows, length=length, bucket_bytes=8_000, direct=direct)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows, bucket_bytes=100_000)


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(90))
    check(spark, [(1, None), (2, ""), (3, long), (4, long), (5, "x" * 49), (6, "x" * 50), (7, "x" * 51)])
    same = spark.createDataFrame([(3, long, "", ""), (3, long + " y", "", ""), (None, long, "", ""), (3, long, "", "")], SCHEMA)
    assert sorted(r.n_removed for r in suffixes.digest(same).collect()) == [0, 0, 0, 0]
    assert suffixes.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts(spark):
    """Passages shared between texts of several hundred thousand bytes, and one that fills a text of its own."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    shared = text(70_000)
    check(spark, [(1, text(200_000) + shared + text(100_000)), (2, shared[:60_000] + text(90_000)), (3, text(10) + shared[100:]), (4, "z" * 100_000), (5, "z" * 60_000 + shared[:49])], bucket_bytes=150_000)


def test_merge_orders_and_measures():
    rng = random.Random(1)
    for k in (1, 2, 3, 7):
        lists = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))}) for _ in range(k)]
        out = list(suffixes.merge([suffixes.front_code(x) for x in lists]))
        assert [s for s, *_ in out] == sorted(sum(lists, []))
        assert all(lists[r][i] == s for s, _, r, i in out)
        before = b""
        for s, lcp, *_ in out:
            assert lcp == suffixes.shared_prefix(before, s)
            before = s
