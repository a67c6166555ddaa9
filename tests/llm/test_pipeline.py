import hashlib
import itertools

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import similar, substring
from tidemark.llm.common import settled

FOLDER = "/root/testdata/sf0.001"


def slow_groups(texts):
    """Smallest id of each group by brute force over the similarity of shingles."""
    sets, ids = {d: similar.shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
            a, b = sorted((root(a), root(b)))
            ids[b] = a
    return {d: root(d) for d in ids}


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = settled(stage(spark, docs, FOLDER), name)
        seen[name] = ({r.doc_id: r for r in docs.collect()}, out.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == docs.schema and out.columns == columns
        docs = out

    before, after = seen["quality"]
    assert 0.7 * len(before) < len(after) <= len(before) and all(before[r.doc_id] == r for r in after)

    before, after = seen["simhash"]
    assert sorted(r.doc_id for r in after) == sorted(set(slow_groups({d: r.text for d, r in before.items()}).values()))
    assert all(before[r.doc_id] == r for r in after)

    before, after = seen["substring"]
    want = {d: (n, cut, sha) for d, n, cut, sha in substring.brute_force([(d, r.text) for d, r in before.items()])}
    assert sorted(r.doc_id for r in after) == sorted(d for d, (n, cut, _) in want.items() if cut == 0 or cut < n)
    for r in after:
        n, cut, sha = want[r.doc_id]
        assert r.text == before[r.doc_id].text if cut == 0 else hashlib.sha256(r.text.encode()).hexdigest() == sha and r.n_chars == len(r.text)

    before, after = seen["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in after) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.values())


def test_odd_rows_in_every_stage(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names, no n_chars; and empty tables."""
    long = " ".join(f"w{i % 5000} x{i % 77}" for i in range(150_000))
    rows = [(1, None, "en"), (2, "", None), (3, long, "en"), (3, long, "en"), (4, "q " + long, "xx"), (None, long, "de"), (5, "a b", None)]
    docs = spark.createDataFrame([(*r, i, "x", "y", 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, _row int, _key string, kept string, _gone int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == docs.columns
        got = out.collect()
        if name in ("quality", "simhash"):  # what stays is as it came in, clashing columns included
            assert out.schema == docs.schema and set(got) <= set(docs.collect())
        if name == "substring":
            own = {r._row: r for r in docs.collect()}
            assert all(r.asDict() | {"text": own[r._row].text} == own[r._row].asDict() for r in got)
        if name == "simhash":
            assert sorted((r.doc_id or 0) for r in got) == [1, 3, 5]
        elif name == "substring":
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in got) == [(0, len(long)), (1, 0), (2, 0), (3, len(long)), (3, len(long)), (4, 1), (5, 3)]
        elif name == "packing":
            assert {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5} and max(r.sequence_id for r in got) > 100
        else:
            assert {(r.doc_id, r.text) for r in got} >= {(1, None), (2, "")}


def test_simhash_index_gives_candidates(spark, monkeypatch):
    """The stage asks the SimHash index; near copies that its 4 bits reach are found by it, those it groups wrongly do not link."""
    words = [f"w{i * 7919 % 10007}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "other"]), 3: " ".join(f"v{i}" for i in range(300)), 4: " ".join(words)}
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    asked = []
    plain = similar.simhash_candidates

    def seen(classes):
        out = plain(classes)
        asked.append(out.collect())
        return out

    monkeypatch.setattr(similar, "simhash_candidates", seen)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, FOLDER).collect()) == sorted(set(slow_groups(texts).values())) == [1, 3]
    assert [len(x) for x in asked] == [1]
