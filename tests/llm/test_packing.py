import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, part string, ids string"


def check(spark, rows, window=2048):
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA).repartition(3)
    pieces = packing.pack(df, PATH, window)
    got = pieces.collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(((d if d is not None else -1), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows)
    total = sum(len(x) for _, x in want)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a * window + b == sum(n for _, _, n in places[:i]) for i, (a, b, _) in enumerate(places))
    assert sum(n for *_, n in places) == total and all(b + n <= window for _, b, n in places)
    by_doc = {}
    for r in sorted(got, key=lambda r: (r.doc_id is not None and r.doc_id, r.sequence_id, r.offset)):
        assert zlib.crc32(r.ids) == r.ids_crc32
        by_doc.setdefault(-1 if r.doc_id is None else r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
        assert len(by_doc[-1 if r.doc_id is None else r.doc_id]) - r.length >= r.start
    assert {d: sorted(x) for d, x in by_doc.items()} == {d: sorted(sum((y for e, y in want if e == d), [])) for d, _ in want}
    whole = packing.sequences(pieces, window, 7).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 4 * window for r in whole[:-1])
    last = total % window or window
    if whole:
        assert len(whole[-1].ids) == 4 * (last if last & (last - 1) == 0 else window)
    return got


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = check(spark, rows)
    tokenizer = Tokenizer.from_file(PATH)
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in rows}
    for r in got:
        assert ids[r.doc_id][r.start : r.start + r.length] == np.frombuffer(r.ids, "<u4").tolist()
        assert r.doc_tokens == len(ids[r.doc_id])


def test_odd_rows(spark):
    odd = "ΟΔΟΣ é ́x İ<|endoftext|> it's a b\x1c\x85c ① don't!!!??"
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, odd), (4, odd), (None, "a b"), (6, "z" * 5000), (7, "a b " * 3000)], 64)
    assert check(spark, []) == []


def test_new_words_are_encoded_as_lines():
    """Ids of words do not depend on the words beside them in a line, and a line is one call of the tokenizer."""
    texts = [r + " ΟΔΟΣ é ́x İ it's \x85 a\x85 ①!? <|endoftext|> " + "z" * 300 for r in (" ".join(f"w{i}q{j}" for i in range(700)) for j in range(2))] + [None, "", "ΟΔΟΣ"]
    encoder, calls = packing.WordEncoder(PATH), []
    tokenizer = encoder._tokenizer

    class Counted:
        def encode(self, line, **more):
            calls.append(len(line.split(" ")))
            return tokenizer.encode(line, **more)

    encoder._tokenizer = Counted()
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.each(texts)]
    assert got == [tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert len(calls) == 3 and sum(calls) == len({w for x in texts for w in (x or "").encode().split()})


def test_a_worker_remembers_the_words_of_some_tasks(spark, monkeypatch):
    """Twice 700,000 distinct words: with generations of 250,000 all of them were encoded twice."""
    made, whole = [], packing.token_blocks
    monkeypatch.setattr(packing, "token_blocks", lambda *a: made.append(a) or whole(*a))
    queries.op2_packing(spark, "/root/testdata/sf0.001")
    encoder, new = packing.WordEncoder(PATH, made[0][3]), []
    encoder._new = lambda words: new.append(len(words)) or [b""] * len(words)
    for _ in range(2):
        for at in range(0, 700_000, packing.TOGETHER):
            encoder.each([" ".join(map(str, range(at, at + packing.TOGETHER)))])
    assert sum(new) == 700_000
