"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity thresholds by language.

The n-grams are runs of UTF-8 bytes, so a gram is one 64-bit integer: its context is the number shifted right by a byte,
its lower-order gram the number with the leading byte cut off.  Counts, continuation counts, context sums and the
interpolated probabilities of all orders come from grouped counts and joins of those tables, sharded by gram.

Models are fitted on a bounded sample of the labelled rows (``FIT_DOCS`` documents a language, none over ``FIT_CHARS``).  A
language's threshold is a quantile over *all* its other trusted documents.  Documents of no or another language are
judged by a pooled model and its threshold.

Tables of up to ``SENT_GRAMS`` rows go to every worker, and the corpus is read once, in place, without a shuffle.  Beyond
that the tables stay sharded: buckets of texts ask for their distinct grams by joins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settled, spare, trim
from tidemark.llm.exchange import BUCKET_BYTES, buckets_for

ORDER = 5
FIT_DOCS = 1000
FIT_CHARS = 20_000
#: A document is rejected above this quantile of the trusted perplexities of its language.
QUANTILE = 0.995
#: Accuracy of the quantiles: an error of 1 / ACCURACY in rank.
ACCURACY = 20_000
SENT_GRAMS = 8_000_000
#: The language of the pooled model.
POOLED = "\x00"


def _grams(text: str | None, order: int) -> np.ndarray:
    """The gram that ends at each byte of the text, its white space made single spaces, after order - 1 zero bytes."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
    raw = np.frombuffer(b"\0" * (order - 1) + data, np.uint8).astype(np.int64)
    out = np.zeros(len(data), np.int64)
    for i in range(order):
        out = (out << 8) | raw[i : i + len(data)]
    return out


def trusted(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ids ``id`` of trusted documents; ``id, lang, text, h`` of a bounded sample of them to fit on; the sample's ids.

    The sample is dealt by hash: half of a language's documents may be in it, ``fit_docs`` at most.  Only ids are shuffled.
    """
    good = settled(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct(), "trusted")
    text, lang, h = F.col("text").cast("string"), F.col("lang").cast("string"), F.xxhash64(F.col("doc_id").cast("long"))
    may = docs.where((F.length(text) > 0) & (F.length(text) <= FIT_CHARS) & lang.isNotNull() & (F.pmod(h, F.lit(2)) == 0))
    may = settled(may.select(F.col("doc_id").cast("long").alias("id"), lang.alias("lang"), h.alias("h")).join(good, "id", "left_semi"), "candidates")
    # so many of a language's hashes are small enough that hardly more than ``fit_docs`` need sorting
    share = F.least(F.lit(1.0), F.lit(1.3 * fit_docs + 50) / F.count("*"))
    small = may.join(F.broadcast(may.groupBy("lang").agg(share.alias("share"))), "lang").where(F.pmod(F.floor(F.col("h") / 2), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = settled(small.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fit_docs).select("id").distinct(), "sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), lang.alias("lang"), text.alias("text"), h.alias("h"))
    # proven small: languages times ``fit_docs`` ids
    return good, settled(rows.where(F.length("text") > 0).join(F.broadcast(chosen), "id", "left_semi"), "fit"), chosen


def _maybe(ids: DataFrame, bits: int = 20):
    """A test of bounded size that every id of ``ids`` passes, and few others as long as there are few: marked hashes."""
    marks = np.zeros(1 << bits, bool)
    marks[ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).cast("int").alias("m")).distinct().toArrow().column(0).to_numpy()] = True
    shared = ids.sparkSession.sparkContext.broadcast(np.packbits(marks))

    @F.pandas_udf("boolean")
    def test(m: pd.Series) -> pd.Series:
        m = m.to_numpy()
        return pd.Series((shared.value[m >> 3] >> (7 - (m & 7)) & 1).astype(bool))

    return lambda c: test(F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int"))


def _calibration(docs: DataFrame, good: DataFrame, chosen: DataFrame, model: "Model", key: Column) -> DataFrame:
    """``lang, perplexity`` of all trusted documents outside the sample, scored in place; only numbers are shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where((F.length("text") > 0) & F.col("id").isNotNull()).where(_maybe(good)(F.col("id")))
    scored = perplexity(rows, model).select("id", "lang", "perplexity").where("perplexity is not null")
    return scored.join(good, "id", "left_semi").join(chosen, "id", "left_anti")


def _counts(texts: DataFrame, order: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang.setdefault(lang, []).append(_grams(text, order))
            for lang, parts in by_lang.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    rows = texts.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(texts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Probabilities ``(k, lang, gram, logp)`` of every seen gram of order k, and back-off weights
    ``(k, lang, context, logb)`` of every seen context, natural logarithms; from ``texts(lang, text)``."""
    tables = {order: settled(_counts(texts, order), "counts")}
    for k in range(order - 1, 0, -1):  # how many different bytes stand before each shorter gram
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        tables[k] = settled(tables[k + 1].groupBy("lang", shorter).agg(F.count("*").alias("n")), "counts")
    lower, found, weights = None, [], []
    for k in range(1, order + 1):
        table = tables[k]
        t = [F.count_if(F.col("n") == i).cast("double") for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        d = [F.greatest(F.lit(0.05), F.coalesce(i - (i + 1) * y * F.try_divide(t[i], t[i - 1]), F.lit(0.5 + 0.25 * (i - 1)))) for i in (1, 2, 3)]
        discounts = table.groupBy("lang").agg(*(x.alias(f"d{i}") for i, x in enumerate(d, 1)))
        cut = F.when(F.col("n") == 1, F.least("d1", F.lit(0.95))).when(F.col("n") == 2, F.least("d2", F.lit(1.9))).otherwise(F.least("d3", F.lit(2.85)))
        table = table.join(F.broadcast(discounts), "lang").withColumn("cut", cut)
        table = table.withColumn("context", F.shiftright("gram", 8))
        sums = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        table = table.join(sums, ["lang", "context"])
        share = (F.col("n") - F.col("cut")) / F.col("total")
        if lower is None:
            p = share + F.col("freed") / F.col("total") / 256
            table = table.select("lang", "gram", p.alias("p"))
        else:
            below = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
            table = table.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, ["lang", "tail"])
            table = table.select("lang", "gram", (share + F.col("freed") / F.col("total") * F.col("q")).alias("p"))
        lower = settled(table, "probabilities")
        found.append(lower.select(F.lit(k).alias("k"), "lang", "gram", F.log("p").alias("logp")))
        weights.append(sums.select(F.lit(k).alias("k"), "lang", "context", F.log(F.col("freed") / F.col("total")).alias("logb")))
    return reduce(DataFrame.union, found), reduce(DataFrame.union, weights)


class Scorer:
    """The finished tables as sorted arrays, by language and order."""

    def __init__(self, probabilities: DataFrame, weights: DataFrame, order: int):
        self.order = order
        self.p, self.b = self._arrays(probabilities), self._arrays(weights)
        self.languages = sorted({lang for _, lang in self.p})

    @staticmethod
    def _arrays(df: DataFrame) -> dict:
        """Sorted keys and values by order and language; the driver gets bare numbers, a bounded number of them."""
        langs = sorted(r.lang for r in df.select("lang").distinct().collect())
        key, value = df.columns[2], df.columns[3]
        code = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") if langs else F.lit(0)
        table = df.select("k", code.alias("lang"), key, F.col(value).cast("float")).toArrow()
        k, lang, keys, values = (c.to_numpy() for c in table.columns)
        out = {}
        for i, name in enumerate(langs, 1):
            for order in np.unique(k):
                mine = np.flatnonzero((lang == i) & (k == order))
                mine = mine[np.argsort(keys[mine])]
                out[int(order), name] = (keys[mine], values[mine])
        return out

    @staticmethod
    def _find(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at]

    def logp(self, lang: str, gram: np.ndarray) -> np.ndarray:
        """ln P(last byte | bytes before) of each full-order gram."""
        out, open_ = np.zeros(len(gram)), np.ones(len(gram), bool)
        for k in range(self.order, 0, -1):
            part = gram & ((1 << 8 * k) - 1)
            seen, value = self._find(self.p[k, lang], part)
            out += np.where(open_ & seen, value, 0)
            open_ &= ~seen
            if not open_.any():
                return out
            seen, value = self._find(self.b[k, lang], part >> 8)
            out += np.where(open_ & seen, value, 0)
        return out + np.where(open_, -np.log(256), 0)

    def batch(self, langs: list, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and log probability of each text; a language without a model gives NaN."""
        n, total = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
        for lang in set(langs):
            rows = [i for i, x in enumerate(langs) if x == lang]
            parts = [_grams(texts[i], self.order) for i in rows]
            n[rows] = [len(x) for x in parts]
            if lang not in self.languages:
                continue
            gram, back = np.unique(np.concatenate(parts), return_inverse=True)
            each = np.split(self.logp(lang, gram)[back], np.cumsum(n[rows])[:-1])
            total[rows] = [x.sum() for x in each]  # text by text: the sum must not depend on the batch
        return n, total


class Model:
    """Finished tables of all languages; ``known`` lists the languages."""

    def __init__(self, probabilities: DataFrame, weights: DataFrame, order: int, sent_grams: int = SENT_GRAMS):
        self.order = order
        self.tables = tuple(settled(t.withColumn(c, F.col(c).cast("float")), "model") for t, c in ((probabilities, "logp"), (weights, "logb")))
        self.known = sorted(r.lang for r in self.tables[0].select("lang").distinct().collect())
        self.scorer = Scorer(*self.tables, order) if sum(t.count() for t in self.tables) <= sent_grams else None

    def key(self, lang: Column) -> Column:
        """The language to judge a document by."""
        other = F.lit(POOLED if POOLED in self.known else None).cast("string")
        return F.when(lang.cast("string").isin([x for x in self.known if x != POOLED]), lang.cast("string")).otherwise(other)


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``perplexity`` per byte (null without a model for the language, or without text)."""
    rows, key = docs.drop("n_bytes", "perplexity"), model.key(F.col("lang"))
    if model.scorer is None:
        return _by_joins(rows, key, model)
    shared, name = docs.sparkSession.sparkContext.broadcast(model.scorer), spare(docs, "_score")

    @F.pandas_udf("n_bytes long, perplexity double")
    def score(lang: pd.Series, text: pd.Series) -> pd.DataFrame:
        trim()
        return _finished(*shared.value.batch(lang.tolist(), text.tolist()))

    rows = rows.withColumn(name, score(key, F.col("text").cast("string")))
    return rows.select("*", F.col(name)["n_bytes"].alias("n_bytes"), F.col(name)["perplexity"].alias("perplexity")).drop(name)


def _finished(n: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        value = pd.Series(np.where(n > 0, np.exp(-total / n), np.nan)).astype(object)
    return pd.DataFrame({"n_bytes": n, "perplexity": value.where(value.notna(), None)})


def _by_joins(docs: DataFrame, key: Column, model: Model, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``perplexity`` without sending the model: equal texts are scored once, and only their grams meet the tables."""
    mark, order = spare(docs, "_key"), model.order
    docs = docs.withColumn(mark, F.struct(key.alias("lang"), F.sha2(F.col("text").cast("string"), 256).alias("sha")))
    texts = docs.select(F.col(mark)["lang"].alias("lang"), F.col(mark)["sha"].alias("sha"), F.col("text").cast("string").alias("text")).where("sha is not null").dropDuplicates(["lang", "sha"])
    texts = settled(texts, "texts")
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64("lang", "sha"), F.lit(buckets_for(texts, bucket_bytes))).cast("int"))

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for lang, part in pdf[pdf["lang"].notna()].groupby("lang"):
            gram = np.unique(np.concatenate([_grams(x, order) for x in part["text"]]))
            parts.append(pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "lang": lang, "gram": gram}))
        out = pd.concat(parts) if parts else pd.DataFrame({"bucket": [], "lang": [], "gram": []})
        return out.astype({"bucket": "int32", "lang": object, "gram": "int64"})

    asked = texts.groupBy("bucket").applyInPandas(ask, "bucket int, lang string, gram long")
    found = asked.select("lang", "gram").distinct().withColumns({"logp": F.lit(0.0), "open": F.lit(True)})
    probabilities, weights = model.tables
    for k in range(order, 0, -1):
        part = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        p = probabilities.where(F.col("k") == k).select("lang", F.col("gram").alias("part"), F.col("logp").alias("p"))
        b = weights.where(F.col("k") == k).select("lang", F.col("context").alias("before"), F.col("logb").alias("b"))
        found = found.withColumns({"part": part, "before": F.shiftright(part, 8)}).join(p, ["lang", "part"], "left").join(b, ["lang", "before"], "left")
        step = F.when(~F.col("open"), 0.0).when(F.col("p").isNotNull(), F.col("p")).otherwise(F.coalesce("b", F.lit(0.0))).cast("double")
        found = found.select("lang", "gram", (F.col("logp") + step).alias("logp"), (F.col("open") & F.col("p").isNull()).alias("open"))
    found = found.select("lang", "gram", (F.col("logp") + F.when(F.col("open"), -float(np.log(256))).otherwise(0.0)).alias("logp"))
    told = asked.join(found, ["lang", "gram"]).select("bucket", "lang", "gram", "logp")

    def tell(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = {lang: t.sort_values("gram") for lang, t in told.groupby("lang")}
        for lang, sha, text in zip(pdf["lang"], pdf["sha"], pdf["text"]):
            gram, total = _grams(text, order), np.nan
            if lang in known:
                total = known[lang]["logp"].to_numpy()[np.searchsorted(known[lang]["gram"].to_numpy(), gram)].sum()
            out.append((lang, sha, len(gram), total))
        out = pd.DataFrame(out, columns=["lang", "sha", "n", "total"]).astype({"lang": object, "sha": object})
        return pd.concat([out[["lang", "sha"]], _finished(out["n"].to_numpy(np.int64), out["total"].to_numpy(float))], axis=1)

    scored = texts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(tell, "lang string, sha string, n_bytes long, perplexity double")
    scored = scored.select(F.struct("lang", "sha").alias(mark + "2"), "n_bytes", "perplexity")
    out = docs.join(scored, docs[mark].eqNullSafe(scored[mark + "2"]), "left").drop(mark, mark + "2")
    return out.withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)).cast("long"))


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, sent_grams: int = SENT_GRAMS) -> tuple[Model, DataFrame]:
    """The model, and each language's threshold ``lang, threshold``; the pooled ones only if some document needs them."""
    good, sample, chosen = trusted(docs, labels)
    languages = [r.lang for r in sample.select("lang").distinct().collect()]
    strays = docs.where((F.length(F.col("text").cast("string")) > 0) & ~F.coalesce(F.col("lang").cast("string").isin(languages), F.lit(False)))
    pooled = bool(strays.limit(1).count())
    texts = sample.select("lang", "text")
    if pooled:
        texts = texts.unionByName(sample.orderBy("h", "id", "text").limit(FIT_DOCS).select(F.lit(POOLED).alias("lang"), "text"))
    model = Model(*kneser_ney(texts, order), order, sent_grams)
    limit = F.percentile_approx("perplexity", F.lit(QUANTILE), F.lit(ACCURACY)).alias("threshold")
    own = _calibration(docs, good, chosen, model, F.col("lang").cast("string"))
    limits = own.where(F.col("lang").isin(languages)).groupBy("lang").agg(limit)
    if pooled:
        every = _calibration(docs, good, chosen, model, F.lit(None).cast("string"))
        limits = limits.unionByName(every.agg(limit).select(F.lit(POOLED).alias("lang"), "threshold"))
    return model, limits


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, sent_grams: int = SENT_GRAMS) -> DataFrame:
    """``docs`` with n_bytes, perplexity, threshold and ``kept``.

    A document goes if its perplexity is above its language's threshold; one of a null or unlabelled language is judged by
    the pooled model.  Documents without text cannot be judged and stay, as do those of a language with so few trusted texts
    that none is left to set the threshold.  A text of any length is scored whole.  Repeated rows are judged alike; columns
    of those four names are replaced, all others pass through; empty tables give empty results.
    """
    model, limits = fit(docs, labels, order, sent_grams)
    limits = limits.collect()  # a number for each language
    of = F.create_map(*(F.lit(x) for r in limits for x in (r.lang, r.threshold))) if limits else F.lit(None).cast("map<string,double>")
    out = perplexity(docs.drop("threshold", "kept"), model).withColumn("threshold", of[model.key(F.col("lang"))])
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
