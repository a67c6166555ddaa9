import hashlib

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, parts string, target string"


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        sha = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        out[c] = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    examples = chat.format_examples(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(examples).collect()}
    assert got == expected(rows)
    return examples.collect()


def test_conversations(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    for e in check(spark, rows):
        assert (e.loss_start is not None) == (chat.parse(e.text)[-1][0] == "assistant")


def test_odd_turns(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<</s>[[INST]", "<\\/s>", "", None, "line\nbreak\\\n", "🙂<s>é"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "x"), (2, None, None, "first"), (2, 5, "to\nol\\", "y"), (3, 0, "system", None), (None, 0, "user", "q"), (None, 0, "user", "q")]
    for e in check(spark, rows):
        inner = e.text[len(chat.START_MARK) :]
        assert inner.count(chat.END_MARK) == len(chat.parse(e.text)) and chat.START_MARK not in inner
    assert chat.format_examples(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_turns_and_empty_tables(spark):
    long = "</s>[INST] \\ line\n" * 20_000
    check(spark, [(1, i, ("user", "assistant")[i % 2], long + str(i)) for i in range(4)] + [(2, 0, "assistant", long)])
    assert chat.digest(chat.format_examples(spark.createDataFrame([], SCHEMA))).count() == 0
