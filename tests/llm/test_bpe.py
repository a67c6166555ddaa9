import random

import public_tokenizers

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(df, PATH).collect())
    assert got == sorted((d, *bpe.digest_by_library(PATH, t)) for d, t in rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(spark):
    rng = random.Random(3)
    pool = ["a", "aa", "the", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", " ", "'s", "'ll", "don't", "1", "42", "é", "é", "🙂", "你好", "<|endoftext|>", "_", "!!", "\r\n", "​", "　", "Σ"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, " " * 300), (2003, "a" * 4000), (2004, "ab" * 3000), (2004, "ab" * 3000), (2005, "\n" * 99 + "x")]
    check(spark, rows)
    assert bpe.digest(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_very_long_texts(spark):
    """Texts of some hundred thousand characters, of many words, of one word, and of white space only."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    check(spark, [(1, " ".join(word(rng.randint(1, 12)) for _ in range(60_000))), (2, word(60_000)), (3, " \n" * 50_000), (4, "é🙂" * 20_000)])


def test_random_letters():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(PATH), bpe.PrefixBpe(PATH), random.Random(9)
    for letters in ("ab", "eirsnt", "abcdefghijklmnopqrstuvwxyz", "aàé你", "=-_"):
        for _ in range(400):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
            assert own.piece(word.encode()) == library.encode(word, add_special_tokens=False).ids, word
