import hashlib
import random
import re

import pytest

from tidemark.llm import fim

SCHEMA = "doc_id long, text string, output string, form string, draws int"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(doc_id, text, rate=50, suffix_first=80):
    text, units = text or "", TOKEN.findall(text or "")
    sha = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA)
    formed = fim.transform(df, **options)
    key = lambda r: (r[0] is not None, r[0] or 0, str(r[1:]))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in formed.collect()), key=key)
    assert got == sorted(((d, *slow(d, x, **options)) for d, x in rows), key=key)
    back = sorted(((r.doc_id, r.text) for r in fim.restore(formed).collect()), key=key)
    assert back == sorted(((d, x or "") for d, x in rows), key=key)


@pytest.fixture
def narrow(monkeypatch):
    """Slices and blocks so small that texts and batches cross their borders (inherited by workers forked later only, so run here)."""
    monkeypatch.setattr(fim, "SLICE_BYTES", 700)
    monkeypatch.setattr(fim, "BLOCK_BYTES", 13)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA)
    want = {d: (*(w := slow(d, x))[:4], sha(w[4]), sha(x or "")) for d, x in rows}
    assert {r.doc_id: tuple(r)[1:] for r in fim.digest(df).collect()} == want


def test_odd_texts(spark):
    odd = [None, "", " ", "\n\t", "a", " a", "a ", " a  b\x0b\x0c\r", "<P>", "x<S", "<S x", "<", "<M", ">", "P>", "<<PP>>", "a<", "<P", "é ü 🙂  x y", "🙂" * 50, "no-spaces" * 40, " " * 100, "a<M>b"]
    rows = [(i, x) for i, x in enumerate(odd * 30)]
    rows += [(None, "null id here"), (None, "null id here"), (-5, "minus five a b c"), (7, "same"), (7, "same"), (9, " ".join(f"w{i} ü" for i in range(200_000)))]
    for rate, first in ((50, 80), (100, 50), (100, 0), (0, 0)):
        check(spark, rows, rate=rate, suffix_first=first)
    empty = spark.createDataFrame([], SCHEMA)
    assert fim.transform(empty).count() == 0 and fim.digest(empty).count() == 0


def test_slices_and_blocks(narrow):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab <PSM>é\n") for _ in range(rng.choice((0, 1, 5, 60, 900)))) for _ in range(300)]
    texts = [re.sub("<[PSM]>", "", re.sub("<[PSM]>", "", x)) for x in texts]
    texts = [x for x in texts if not re.search("<[PSM]>", x)]
    column = pa.array(texts)
    assert [x for a, b in fim._slices(np.array([len(x.encode()) for x in texts])) for x in range(a, b)] == list(range(len(texts)))
    data, borders = fim._bytes(column)
    ends, form, cuts, want = fim.token_ends(data, borders).tolist(), [], [], []
    for i, x in enumerate(texts):
        units = TOKEN.findall(x)
        a, b = sorted((rng.randint(0, len(units)), rng.randint(0, len(units))))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        at = 0
        for u in units:
            at += len(u.encode())
            assert borders[i] + at in ends
        form.append(rng.randint(0, 2))
        cuts.append((len(p.encode()), len((p + m).encode())))
        want.append((x, f"<P>{p}<S>{s}<M>{m}", f"<S>{s}<P>{p}<M>{m}")[form[-1]])
    assert len(ends) == sum(len(TOKEN.findall(x)) for x in texts)
    out, new = fim.scattered(data, borders, np.array(cuts), np.array(form))
    assert fim._strings(out, new).to_pylist() == want
    back, old = fim.gathered(out, new, np.array(form))
    assert fim._strings(back, old).to_pylist() == texts


def test_wrong_outputs_are_refused():
    import numpy as np
    import pyarrow as pa

    for x in ("<P>a<S>b", "<P>a<S>b<M>c<M>", "abc"):
        with pytest.raises(ValueError):
            fim.gathered(*fim._bytes(pa.array([x])), np.array([1]))
