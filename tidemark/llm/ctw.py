"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions; each context of 0 to ``DEPTH`` preceding bytes keeps, for every decision node, how
often either way was taken in the training documents.  A node's own estimate is Krichevsky-Trofimov's; the weight between
it and the contexts one byte longer is the one the training data itself gives (node probability against the product of
its children's), so all depths are mixed.  The tree's leaves are the longest contexts seen in training: a context never
seen passes on the estimate of the longest one that was.

A gram is a context and its next byte in one integer, newest context byte first, so the grams of a context of any length are
neighbours.  Every bucket of documents sends its distinct grams with their training counts, once, to shards of the newest
``TOP`` context bytes.  A shard adds up the counts and builds all deeper levels of its part of the tree with sorted arrays;
only the nodes at depth ``TOP`` leave it, a table bounded by 256**TOP contexts whatever the corpus, and Spark sums those up
to the root and carries the mixtures back.  The shard then finishes its levels downwards and answers every bucket with the
log probability of each gram it asked for.  The unigram word base model is looked up in the same exchange.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.llm.common import forget, settled
from tidemark.llm.exchange import DIRECT, RUNS, buckets_for, crossed, cuts, incoming, opened, outgoing, pack, squeezed, unpack, width_for
from tidemark.llm.rolling import _mix

DEPTH = 6
#: Levels deeper than this are built inside one task.
TOP = 3
BUCKET_BYTES = 16 << 20
#: Shards for each bucket: a bucket has far more grams than it has anchors.
SHARDS = 2
_CHUNK = 1 << 21
#: About so many grams of a shard have their levels in memory at once.
SLICE = 1 << 18
_LN2 = 0.6931471805599453


def held_out(doc_id: Column) -> Column:
    """Documents that are not learnt from; a null doc_id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def grams_of(data: bytes, depth: int):
    """Yields, for pieces of a text, one integer for every byte and for the end: its context's bytes, newest first, then
    the byte itself.  The end is the byte 255, which also stands before the first byte; no UTF-8 text holds it."""
    raw = np.frombuffer(b"\xff" * depth + data + b"\xff", np.uint8)
    for at in range(0, len(data) + 1, _CHUNK):
        piece = raw[at : at + _CHUNK + depth].astype(np.uint64)
        out, n = piece[depth:].copy(), len(piece) - depth
        for i in range(1, depth + 1):
            out |= piece[depth - i : depth - i + n] << np.uint64(8 * (depth + 1 - i))
        yield out


def _table(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of some texts and how often each occurs; long lists are counted in pieces."""
    grams, counts, waiting, room = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for piece in (g for data in texts for g in grams_of(data, depth)):
        waiting.append(piece)
        room += len(piece)
        if room > _CHUNK:
            g, n = np.unique(np.concatenate(waiting), return_counts=True)
            grams, counts = _added([grams, g], [counts, n])
            waiting, room = [], 0
    if waiting:
        g, n = np.unique(np.concatenate(waiting), return_counts=True)
        grams, counts = _added([grams, g], [counts, n])
    return grams, counts


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they fit."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def _added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of several lists of grams, and the sums of their counts."""
    g, n = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return g[start], np.add.reduceat(n, start) if len(g) else n


def _slices(grams: np.ndarray, depth: int, top: int):
    """Cuts sorted grams into ranges of about ``SLICE``: those of one context of ``top`` bytes stay together, and share no level below it with others."""
    context, at = grams >> np.uint64(8 * (depth + 1 - top)), 0
    while at < len(grams):
        end = len(grams)
        if at + SLICE < end:
            end = int(np.searchsorted(context, context[at + SLICE]))
            end = end if end > at else int(np.searchsorted(context, context[at], "right"))
        yield slice(at, end)
        at = end


def _sums(texts: list[bytes], depth: int, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the ``values`` of all grams of each text (``grams`` sorted).

    The bits that a gram leaves free tell which text it is from, so some texts are sorted together and ask once for each distinct gram.
    """
    free = 8 * (7 - depth)
    out, shift, mask = np.zeros(len(texts)), np.uint64(free), np.uint64((1 << free) - 1)

    def add(waiting: list[np.ndarray], first: int) -> None:
        keys = np.sort(np.concatenate(waiting))
        own = keys >> shift
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        value = np.repeat(values[np.searchsorted(grams, own[start])], np.diff(np.r_[start, len(own)]))
        part = np.bincount((keys & mask).astype(np.int64), value)
        out[first : first + len(part)] += part

    waiting, room, first = [], 0, 0
    for i, data in enumerate(texts):
        if i - first >= 1 << free:
            add(waiting, first)
            waiting, room, first = [], 0, i
        for piece in grams_of(data, depth):
            waiting.append(piece << shift | np.uint64(i - first))
            room += len(piece)
            if room > _CHUNK:
                add(waiting, first)
                waiting, room = [], 0
        if not waiting:
            first = i + 1
    if waiting:
        add(waiting, first)
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """Steps of a sorted list of 64-bit integers as byte planes: the high ones are nearly all zero and compress to nothing."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _joined(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def log_gamma(z: np.ndarray) -> np.ndarray:
    """ln Gamma for z >= 1/2: Stirling's series after shifting the argument up by eight."""
    low = np.zeros_like(z)
    for i in range(8):
        low += np.log(z + i)
    z = z + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


_HALVES, _WHOLES = log_gamma(np.arange(1 << 16) + 0.5), log_gamma(np.arange(1 << 16) + 1.0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""

    def of(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
        out = table[np.minimum(n, len(table) - 1)]
        large = np.flatnonzero(n >= len(table))
        out[large] = log_gamma(n[large] + shift)
        return out

    return of(_HALVES, a, 0.5) + of(_HALVES, b, 0.5) - of(_WHOLES, a + b, 1.0) - np.log(np.pi)


@F.pandas_udf(DoubleType())
def _log_kt(zeros: pd.Series, ones: pd.Series) -> pd.Series:
    return pd.Series(log_kt(zeros.to_numpy(np.int64), ones.to_numpy(np.int64)))


class Levels:
    """The part of the tree below some contexts of ``top`` bytes: decision nodes of the depths ``top`` to ``depth``.

    At each depth the grams are cut to that context and sorted; the nodes of one bit of the next byte are then runs of
    neighbours.  ``way[d]`` leads from a gram of depth d + 1 to its shorter gram.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        self.own, self.beta, self.seen, self.node, self.way = {}, {}, {}, {}, {}
        below: list[np.ndarray] = []
        first: list[np.ndarray] = []
        for d in range(depth, top - 1, -1):
            if d < depth:
                shorter = (grams >> np.uint64(16)) << np.uint64(8) | grams & np.uint64(255)
                grams, back = np.unique(shorter, return_inverse=True)
                counts = np.bincount(back, counts, len(grams)).astype(np.int64)
                self.way[d] = back.astype(np.int32)
            pw, starts, self.node[d] = [], [], []
            self.own[d], self.beta[d], self.seen[d] = [], [], []
            for bit in range(8):
                node = grams >> np.uint64(8 - bit)
                new = np.r_[True, node[1:] != node[:-1]]
                start, run = np.flatnonzero(new), (np.cumsum(new) - 1).astype(np.int32)
                one = (grams >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64)
                n1 = np.add.reduceat(counts * one, start)
                n0 = np.add.reduceat(counts, start) - n1
                kt = log_kt(n0, n1)
                p = kt if d == depth else np.logaddexp(kt, np.bincount(run[self.way[d][first[bit]]], below[bit], len(start))) - _LN2
                self.own[d].append((n1 + 0.5) / (n0 + n1 + 1))
                self.beta[d].append(np.exp(kt - p - _LN2))
                self.seen[d].append(n0 + n1 > 0)
                self.node[d].append(run)
                pw.append(p)
                starts.append(start)
                if d == top:
                    self.top_rows = [] if bit == 0 else self.top_rows
                    path = node[start] & np.uint64((1 << bit) - 1) | np.uint64(1 << bit)
                    context = node[start] >> np.uint64(bit)
                    self.top_rows.append(((context << np.uint64(8) | path).astype(np.int64), n0, n1, p))
            below, first = pw, starts

    def roots(self) -> pd.DataFrame:
        """The nodes at depth ``top``: context and path, counts and weighted probability."""
        columns = [np.concatenate(x) for x in zip(*self.top_rows)]
        return pd.DataFrame(dict(zip(("node", "n0", "n1", "pw"), columns)))

    def log10(self, grams: np.ndarray, nodes: np.ndarray, total: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 P(byte | context) of the full-depth grams, given what reaches each node at depth ``top``:
        the mixture's sum so far and the weight that is left (``nodes`` sorted)."""
        out = np.zeros(len(grams))
        for bit in range(8):
            at = np.searchsorted(nodes, self.top_rows[bit][0])
            s, w = total[at], rest[at]
            for d in range(self.top, self.depth + 1):
                own, beta, seen = self.own[d][bit], self.beta[d][bit], self.seen[d][bit]
                if d > self.top:
                    run = self.node[d][bit]
                    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                    parent = self.node[d - 1][bit][self.way[d - 1][start]]
                    s, w = np.where(seen, carried[parent], stop[parent]), np.where(seen, left[parent], 0.0)
                stop, carried, left = s + w * own, s + w * beta * own, w * (1 - beta)
            p = stop[self.node[self.depth][bit]]
            one = grams >> np.uint64(7 - bit) & np.uint64(1)
            out += np.log10(np.where(one == 1, p, 1 - p))
        return out


def _upper_levels(roots: DataFrame, top: int) -> DataFrame:
    """``node, sum, rest`` of the nodes at depth ``top``: what the mixtures of the shorter contexts pass down to them."""
    levels = {top: roots}
    for d in range(top - 1, -1, -1):
        up = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255))).alias("node")  # without the oldest byte
        level = levels[d + 1].groupBy(up).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))
        level = level.withColumn("kt", _log_kt("n0", "n1"))
        high = F.greatest("kt", "below")
        levels[d] = settled(level.withColumn("pw", high + F.log(0.5 * F.exp(F.col("kt") - high) + 0.5 * F.exp(F.col("below") - high))), "level")
    above = None
    for d in range(top + 1):
        here = levels[d].withColumn("seen", F.col("n0") + F.col("n1") > 0)
        if above is None:
            here = here.withColumns({"sum": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            parent = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255))).alias("up")
            here = here.select("*", parent).join(above, "up").withColumns({
                "sum": F.when(F.col("seen"), F.col("next")).otherwise(F.col("stop")), "rest": F.when(F.col("seen"), F.col("left")).otherwise(0.0),
            })
        if d == top:
            return here.select("node", "sum", "rest")
        own, beta = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1), F.exp(F.col("kt") - F.col("pw") - _LN2)
        stop, carried = F.col("sum") + F.col("rest") * own, F.col("sum") + F.col("rest") * beta * own
        above = here.select(F.col("node").alias("up"), stop.alias("stop"), carried.alias("next"), (F.col("rest") * (1 - beta)).alias("left"))


def _word_hashes(data: bytes) -> np.ndarray:
    words = data.lower().split()
    return _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def score(docs: DataFrame, depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES, direct: int = DIRECT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``score`` is the log10 probability of the whole text and its end; ``depth`` is 7 bytes at most.  Documents whose
    crc32(doc_id as text) mod 7 is 2 are not learnt from.  A null text is empty and still has its end; a null doc_id is
    learnt from; repeated rows count each time; a text of any length is scored whole, in one task; other columns are
    ignored; an empty table gives an empty result.
    """
    if not 0 <= depth <= 7:
        raise ValueError("a gram of more than 8 bytes does not fit a 64-bit integer")
    top = min(TOP, depth)
    buckets = buckets_for(docs, bucket_bytes)
    shards = SHARDS * buckets
    width = width_for(buckets, shards, direct)
    rows = squeezed(docs, buckets)

    def shard_of(grams: np.ndarray) -> np.ndarray:
        # the newest bytes of a context choose the shard, at every depth of it alike
        return (_mix(grams >> np.uint64(8 * (depth + 1 - top))) % np.uint64(shards)).astype(np.int32)

    def tables(ids: list, texts: list[bytes]):
        """A bucket's distinct grams with training counts, their order by shard and its ends; and its distinct words alike."""
        out = np.array([_is_held_out(i) for i in ids], bool)
        learnt, n = _table([t for t, o in zip(texts, out) if not o], depth)
        other, _ = _table([t for t, o in zip(texts, out) if o], depth)
        grams, n = _added([learnt, other], [n, np.zeros(len(other), np.int64)])
        shard = shard_of(grams)
        order = np.argsort(shard, kind="stable")  # sorted within a shard
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        words = [_word_hashes(t) for t in texts]
        word, back = np.unique(np.concatenate(words), return_inverse=True)
        w = np.bincount(back, np.repeat(~out, [len(x) for x in words]), len(word)).astype(np.int64)
        return out, grams, n, order, ends, words, word, w

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        _, grams, n, order, ends, _, word, w = tables(*opened(pdf))
        grams, n, at = grams[order], n[order], cuts(word, shards)
        runs = {}
        for s in np.flatnonzero((np.diff(ends) > 0) | (np.diff(at) > 0)).tolist():
            a, b, c, d = ends[s], ends[s + 1], at[s], at[s + 1]
            runs[s] = pack(_planes(grams[a:b]), _narrow(n[a:b]), word[c:d], _narrow(w[c:d]))
        return outgoing(int(pdf["bucket"].iloc[0]), runs, width)

    def summed(pdf: pd.DataFrame):
        """A shard's runs: its distinct grams with their counts, and the words' totals."""
        got = [(bucket, unpack(run)) for bucket, run in incoming(pdf, width)]
        asked = [_joined(x[0]) for _, x in got]
        grams, n = _added(asked, [x[1].astype(np.int64) for _, x in got])
        word, total = _added([x[2] for _, x in got], [x[3].astype(np.int64) for _, x in got])
        return got, asked, grams, n, word, total

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        """The shard's nodes at depth ``top``; and a row with node -1: its known words, and their tokens."""
        forget()
        _, _, grams, n, _, total = summed(pdf)
        facts = pd.DataFrame({"node": [-1], "n0": [int((total > 0).sum())], "n1": [int(total.sum())], "pw": [0.0]})
        return pd.concat([*(Levels(grams[x], n[x], depth, top).roots() for x in _slices(grams, depth, top)), facts])

    def answer(asked: pd.DataFrame, mixed: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return outgoing(0, {}, width)
        got, keys, grams, n, word, total = summed(asked)
        mixed = mixed.sort_values("node")
        above = [mixed[c].to_numpy() for c in ("node", "sum", "rest")]
        logp = np.concatenate([np.zeros(0), *(Levels(grams[x], n[x], depth, top).log10(grams[x], *above) for x in _slices(grams, depth, top))])
        runs = {b: pack(logp[np.searchsorted(grams, k)], _narrow(total[np.searchsorted(word, x[2])])) for (b, x), k in zip(got, keys)}
        return outgoing(int(asked["dst"].iloc[0]), runs, width)

    def tell(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, texts = opened(pdf)
        out, grams, _, order, _, words, word, _ = tables(ids, texts)
        got = [unpack(x) for _, x in incoming(told, width)]
        logp = np.zeros(len(grams))
        logp[order] = np.concatenate([x[0] for x in got])
        count = np.concatenate([x[1].astype(np.int64) for x in got])
        rows = []
        for i, o, text, w, total in zip(ids, out, texts, words, _sums(texts, depth, grams, logp)):
            c = count[np.searchsorted(word, w)]
            rows.append((i, bool(o), len(text), len(w), int((c > 0).sum()), float(np.log10(c + 1).sum()), float(total)))
        return pd.DataFrame(rows, columns=["doc_id", "out", "n_bytes", "n_words", "known", "base", "score"]).astype({"doc_id": "Int64"})

    asked = crossed(rows.groupBy("bucket").applyInPandas(ask, RUNS), width)
    roots = settled(asked.groupBy("dst").applyInPandas(learn, "node long, n0 long, n1 long, pw double"), "roots")
    facts = roots.where("node < 0").agg(F.sum("n0").alias("distinct"), F.sum("n1").alias("tokens")).first()
    roots = roots.where("node >= 0")
    learnt = docs.where(~held_out(F.col("doc_id"))).count()
    mixed = _upper_levels(roots, top) if top else roots.select("node", F.lit(0.0).alias("sum"), F.lit(1.0).alias("rest"))

    @F.pandas_udf("int")
    def place(node: pd.Series) -> pd.Series:
        context = node.to_numpy().astype(np.uint64) >> np.uint64(8)
        return pd.Series((_mix(context) % np.uint64(shards)).astype(np.int32))

    mixed = mixed.withColumn("dst", place("node"))
    replies = asked.groupBy("dst").cogroup(mixed.groupBy("dst")).applyInPandas(answer, RUNS)
    replies = crossed(replies, width).withColumnRenamed("dst", "bucket")
    scored = rows.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInPandas(tell, "doc_id long, out boolean, n_bytes long, n_words long, known long, base double, score double")
    tokens, distinct = (facts["tokens"] or 0) + learnt, (facts["distinct"] or 0) + (learnt > 0)
    below, end = float(np.log10(tokens + distinct + 1)), float(np.log10(learnt + 1))
    n = F.col("n_words") + 1
    return scored.select(
        "doc_id", F.col("out").alias("held_out"), n.alias("n_tokens"), (F.col("known") + F.lit(int(learnt > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + end - n * below).alias("base_score"), "score",
        (-F.col("score") * 3.321928094887362 / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
