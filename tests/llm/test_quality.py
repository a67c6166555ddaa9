import math
from collections import Counter

import numpy as np

from tidemark.llm import quality


def slow_model(texts, order):
    """Interpolated modified Kneser-Ney by definition."""
    raw = Counter(int(g) for t in texts for g in quality._grams(t, order))
    tables = {order: raw}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g & (1 << 8 * k) - 1 for g in tables[k + 1])

    def p(g, k):
        if k == 0:
            return 1 / 256
        table = tables[k]
        t = [sum(n == i for n in table.values()) for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else None
        d = []
        for i in (1, 2, 3):
            x = i - (i + 1) * y * t[i] / t[i - 1] if y is not None and t[i - 1] else 0.5 + 0.25 * (i - 1)
            d.append(min(max(0.05, x), (0.95, 1.9, 2.85)[i - 1]))
        g &= (1 << 8 * k) - 1
        same = [n for h, n in table.items() if h >> 8 == g >> 8]
        lower = p(g, k - 1)
        if not same:
            return lower
        cut = lambda n: d[min(n, 3) - 1]
        n = table.get(g, 0)
        return (n - cut(n) if n else 0) / sum(same) + sum(map(cut, same)) / sum(same) * lower

    return lambda text: sum(math.log(p(int(g), order)) for g in quality._grams(text, order))


def test_model_against_definition(spark):
    texts = ["the cat sat on the mat", "the cat ate the rat", "a dog sat", "thé dog"]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    scorer = quality.Scorer(*quality.kneser_ney(df, 3), 3)
    slow = slow_model(texts, 3)
    for t in (*texts, "the mat dog", "zzz", "qat ÿ"):
        n, total = scorer.batch(["en"], [t])
        assert n[0] == len(t.encode()) and abs(total[0] - slow(t)) < 1e-5 * max(1, -slow(t)), t
    full = np.array([(97 << 8 | 116) << 8 | x for x in range(256)])
    assert abs(np.exp(scorer.logp("en", full)).sum() - 1) < 1e-5


def test_judgement(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = quality.judge(docs, labels).join(labels, "doc_id").select("quality", "kept").toPandas()
    assert judged.loc[judged.quality == 1, "kept"].mean() > 0.98
    assert judged.loc[judged.quality == 0, "kept"].mean() < 0.25


def test_thresholds_by_brute_force(spark):
    """The quantile of every trusted text outside the sample, long ones too; the same by sent and by sharded tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0 or doc_id < 300")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    long = spark.createDataFrame([(9001, "the tion and " * 3000, "en", "x", 1), (9002, "qq the and", None, "x", 1), (9003, "qq the und", "xx", "x", 1)], docs.schema)
    docs = docs.unionByName(long)
    labels = labels.unionByName(spark.createDataFrame([(9001, 1, 0), (9002, 1, 0)], labels.schema))
    good, sample, chosen = quality.trusted(docs, labels)
    picked = sample.toPandas()
    assert sorted(picked.id) == sorted(r.id for r in chosen.collect())
    assert (picked.text.str.len() <= quality.FIT_CHARS).all() and picked.groupby("lang").size().max() <= quality.FIT_DOCS
    model, limits = quality.fit(docs, labels)
    got = {r.lang: r.threshold for r in limits.collect()}
    rest = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").where("length(text) > 0").toPandas()
    assert set(picked.id) < set(rest.doc_id)
    rest = rest[~rest.doc_id.isin(picked.id)]
    for lang in {"en", "de", quality.POOLED}:
        texts = rest.text if lang == quality.POOLED else rest[rest.lang == lang].text
        n, total = model.scorer.batch([lang] * len(texts), texts.tolist())
        values = np.sort(np.exp(-total / n))
        assert abs(got[lang] - values[math.ceil(quality.QUANTILE * len(values)) - 1]) < 1e-9
    sent, sharded = quality.judge(docs, labels).toPandas(), quality.judge(docs, labels, sent_grams=0).toPandas()
    sent, sharded = (x.sort_values("doc_id").reset_index(drop=True) for x in (sent, sharded))
    assert sent.equals(sharded[sent.columns])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1, 0), (2, "", "en", 2, 0), (3, "abc", None, 3, 0), (4, "abc", "xx", 4, 0), (None, "abc", "en", 5, 0)], "doc_id long, text string, lang string, kept int, _score int")
    labels = spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, quality int")
    for sent in (quality.SENT_GRAMS, -1):
        out = quality.judge(docs, labels, sent_grams=sent)
        assert out.columns == ["doc_id", "text", "lang", "_score", "n_bytes", "perplexity", "threshold", "kept"]
        assert out.where("kept").count() == 5
        assert quality.judge(docs.limit(0), labels, sent_grams=sent).count() == 0
